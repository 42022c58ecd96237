"""Column functions on vectors held as arrays; all run inside JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The length is bound by a list of one, so it is taken once a vector and not for each component."""
    return F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: F.try_divide(x.cast("double"), n)))[0]


def temporal_weight(i: Column, j: Column, beta: float = 0.95, most: int = 5) -> Column:
    return F.pow(F.lit(beta), F.least(F.abs(i - j), F.lit(most)).cast("double"))
