"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; over the shorter of the two."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Scaled to length 1; a zero vector is left as it is. The norm is bound once, not computed for every value."""
    return F.transform(F.array(F.struct(v.alias("v"), norm(v).alias("n"))), lambda a: F.transform(a.v, lambda x: F.when(a.n == 0, x.cast("double")).otherwise(x.cast("double") / a.n)))[0]


def clip(c: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """c between low and high; null stays null (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def cosine(a: Column, b: Column) -> Column:
    """0 where one of the two is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def mean_vector(v: Column, dim: int) -> Column:
    """Aggregate: the mean of each position, combined before any shuffle."""
    return F.array(*(F.avg(v[i].cast("double")) for i in range(dim)))


def sum_vector(v: Column, dim: int) -> Column:
    return F.array(*(F.sum(v[i].cast("double")) for i in range(dim)))
