"""Scalar helpers where engines differ in types or conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def weekday_from_sunday(c: Column | str) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return (F.dayofweek(c) - 1).cast("bigint")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of equal length; null where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))
