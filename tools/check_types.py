"""Compare column types of every registered query with its DuckDB oracle."""
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402

from tandem.plans.oracles import ORACLES  # noqa: E402
from tandem.plans.queries import QUERIES  # noqa: E402
from tandem.session import build_session  # noqa: E402
from tandem.sources.tables import TABLES  # noqa: E402

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "timestamp": "TIMESTAMP", "smallint": "SMALLINT"}
sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
skip = set(sys.argv[2].split(",")) if len(sys.argv) > 2 else set()
con = duckdb.connect()
for t in TABLES:
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
spark = build_session()
for name, q in QUERIES.items():
    if name in skip:
        continue
    s = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in q(spark, sf).schema}
    d = dict(con.execute(f"DESCRIBE {ORACLES[name]}").fetchall() and
             [(r[0], r[1]) for r in con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()])
    diff = {k: (s.get(k), d.get(k)) for k in set(s) | set(d) if s.get(k) != d.get(k)}
    print(f"{'OK  ' if not diff else 'DIFF'} {name:26s} {diff if diff else ''}", flush=True)
