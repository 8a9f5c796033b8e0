"""Vectors as arrays (P35). Products accumulate in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_TOLERANCE = 1e-4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def is_unit(v: Column, tolerance: float = NORM_TOLERANCE) -> Column:
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return finite & (F.abs(norm(v) - 1) <= tolerance)
