"""Native vector expressions over ``array<double>`` columns (higher-order
functions, so they run inside codegen without Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)


def norm(a: Column) -> Column:
    return F.sqrt(sq_norm(a))


def logsumexp(a: Column) -> Column:
    """log(sum(exp(a))) with the max shift; NULL for an empty array."""
    m = F.array_max(a)
    s = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + F.exp(v - m))
    return m + F.log(s)
