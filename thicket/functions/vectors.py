"""Vector expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a vector has no length."""
    na, nb = norm(a), norm(b)
    return F.when((F.size(a) == F.size(b)) & (na > TINY) & (nb > TINY), dot(a, b) / (na * nb)).otherwise(0.0)


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > TINY, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))
