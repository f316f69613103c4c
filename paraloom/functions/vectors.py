"""Dense vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def angular(cos: Column) -> Column:
    """1 - d/2 with d the distance of the normalised vectors: between 0 and 1, not the cosine."""
    return F.lit(1.0) - F.sqrt(F.lit(2.0) * F.greatest(F.lit(0.0), F.lit(1.0) - cos)) / 2


def correlation_similarity(a: Column, b: Column) -> Column:
    """2 - (1 - cosine), a zero vector counting as distance 1."""
    return F.lit(2.0) - (F.lit(1.0) - cosine(a, b))


def analogy(a: Column, b: Column, c: Column) -> Column:
    """b - a + c."""
    return F.zip_with(F.zip_with(b, a, lambda x, y: x - y), c, lambda x, y: x + y)
