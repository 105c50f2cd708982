"""Vector expressions over ``array<float>`` columns, summed in double and in index order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is all zeros, null where the lengths differ."""
    scale = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale))


def squared_l2(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, square)))


def unit(v: Column) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / length))
