"""Every registered query against its DuckDB twin at sf0.001 (the driver runs
the same comparison at sf0.01)."""
import math

import pytest
from sample_tables import SF001

from tandem.plans.oracles import ORACLES
from tandem.plans.queries import QUERIES


def _norm(v):
    if v is None:
        return ("~",)
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else ("f", round(v, 6) + 0.0)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("f", float(v))
    return ("s", str(v))


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert len(QUERIES) >= 56


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, duck, name):
    con = duck(SF001)
    sdf = QUERIES[name](spark, SF001)
    s_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema}
    d_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
    assert s_types == d_types
    s_cols, s_rows = _canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = con.execute(ORACLES[name])
    d_cols, d_rows = _canon([d[0] for d in res.description], res.fetchall())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows
