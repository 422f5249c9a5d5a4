"""Local correctness gate: every registered query against its DuckDB oracle.

Compares column names, row counts and order-insensitive values (doubles
rounded to 6 places) at one scale factor. Usage:
    python tools/check_oracle.py [sf_dir] [name,name,...]
"""
import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402

from tandem.plans.oracles import ORACLES  # noqa: E402
from tandem.plans.queries import QUERIES  # noqa: E402
from tandem.session import build_session  # noqa: E402
from tandem.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return ("~",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("f", round(v, 6) + 0.0)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("f", float(v))
    return ("s", str(v))


def rows_of(records):
    return sorted((tuple(norm(x) for x in r) for r in records), key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2].split(",")) if len(sys.argv) > 2 else None
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    spark = build_session()
    bad = 0
    for name, q in QUERIES.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            sdf = q(spark, sf)
            cols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
            t1 = time.time()
            res = con.execute(ORACLES[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
            # compare by sorted column names, like the driver
            order_s = sorted(range(len(cols)), key=lambda i: cols[i])
            order_d = sorted(range(len(dcols)), key=lambda i: dcols[i])
            sc = [cols[i] for i in order_s]
            dc = [dcols[i] for i in order_d]
            a = rows_of([tuple(r[i] for i in order_s) for r in srows])
            b = rows_of([tuple(r[i] for i in order_d) for r in drows])
            ok = sc == dc and a == b
            msg = ""
            if sc != dc:
                msg = f"columns spark={sc} duck={dc}"
            elif len(a) != len(b):
                msg = f"rows spark={len(a)} duck={len(b)}"
            elif a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                msg = f"values differ, e.g. {str(diff)[:600]}"
            bad += not ok
            print(f"{'PASS' if ok else 'FAIL'} {name:26s} rows={len(a):6d} spark={t1 - t0:6.2f}s {msg}", flush=True)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name:26s} {type(exc).__name__}: {str(exc)[:800]}", flush=True)
    print(f"failures: {bad}")


if __name__ == "__main__":
    main()
