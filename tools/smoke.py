"""Run every registered query once and print rows / seconds / errors."""
import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from tandem.plans.queries import QUERIES  # noqa: E402
from tandem.session import build_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
only = set(sys.argv[2].split(",")) if len(sys.argv) > 2 else None
spark = build_session()
for name, q in QUERIES.items():
    if only and name not in only:
        continue
    t = time.time()
    try:
        df = q(spark, sf)
        rows = df.collect()
        print(f"OK   {name:28s} rows={len(rows):6d} {time.time() - t:6.2f}s cols={df.columns}"
              f" first={str(rows[0])[:160] if rows else None}", flush=True)
    except Exception as exc:  # noqa: BLE001
        print(f"FAIL {name:28s} {type(exc).__name__}: {str(exc)[:600]}", flush=True)
        traceback.print_exc(limit=3, file=sys.stdout)
