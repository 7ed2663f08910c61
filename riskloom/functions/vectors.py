"""Dense vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    parts = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is all zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(
        F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def unit(a: Column) -> Column:
    """The vector scaled to length one; an all-zero vector stays as it is."""
    size = norm(a)
    return F.transform(a, lambda v: F.when(size > 0, v.cast("double") / size).otherwise(F.lit(0.0)))
