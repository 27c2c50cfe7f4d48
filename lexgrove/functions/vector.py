"""Column expressions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    return _total(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Dot product over the shorter length by the full norms; NaN if either is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(float("nan"))).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def squared_distance(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    return _total(
        F.zip_with(a, b, lambda x, y: F.coalesce((x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")), F.lit(0.0)))
    )
