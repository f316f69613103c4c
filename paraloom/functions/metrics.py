"""Distances and similarities of two dense vectors of equal length, as expressions.

Histogram metrics expect values that aren't negative; a term whose denominator is 0 counts 0.
Null vectors give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paraloom.functions import vectors as V


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _terms(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def square_distance(a: Column, b: Column) -> Column:
    return _sum(_terms(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(square_distance(a, b))


def correlation_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - V.cosine(a, b)


def angle(a: Column, b: Column) -> Column:
    """In radians."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.cosine(a, b))))


def city_block(a: Column, b: Column) -> Column:
    return _sum(_terms(a, b, lambda x, y: F.abs(x - y)))


def largest_difference(a: Column, b: Column) -> Column:
    return F.array_max(_terms(a, b, lambda x, y: F.abs(x - y)))


def smallest_difference(a: Column, b: Column) -> Column:
    return F.array_min(_terms(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: float) -> Column:
    return F.pow(_sum(_terms(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1.0 / p))


def weighted_square_distance(a: Column, b: Column, weights: Column) -> Column:
    return V.dot(weights, _terms(a, b, lambda x, y: (x - y) * (x - y)))


def quadratic_form(a: Column, b: Column, q: Column) -> Column:
    """a' Q b with Q as an array of rows."""
    return V.dot(a, F.transform(q, lambda row: V.dot(row, b)))


def quadratic_difference(a: Column, b: Column, q: Column) -> Column:
    d = _terms(a, b, lambda x, y: x - y)
    return quadratic_form(d, d, q)


def hamming(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """The number of places where one exceeds the threshold and the other doesn't."""
    return _sum(_terms(a, b, lambda x, y: F.when((x > threshold) != (y > threshold), 1.0).otherwise(0.0)))


def hamming_share(a: Column, b: Column, threshold: float = 0.0) -> Column:
    return F.try_divide(hamming(a, b, threshold), F.size(a))


def intersection(a: Column, b: Column) -> Column:
    """The sum of the smaller values over the smaller sum; null where that is 0."""
    return F.try_divide(_sum(_terms(a, b, lambda x, y: F.least(x, y))), F.least(_sum(a), _sum(b)))


def intersection_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - intersection(a, b)


def chi_square(a: Column, b: Column) -> Column:
    return _sum(_terms(a, b, lambda x, y: F.coalesce(F.try_divide((x - y) * (x - y), 2 * (x + y)), F.lit(0.0))))


def divergence(a: Column, b: Column) -> Column:
    """Kullback-Leibler; a place where the first is 0 counts 0, one where only the second is 0 makes it infinite."""
    term = lambda x, y: F.when(x <= 0, 0.0).when(y <= 0, float("inf")).otherwise(x * F.ln(F.try_divide(x, y)))
    return _sum(_terms(a, b, term))


def jeffrey(a: Column, b: Column) -> Column:
    mean = _terms(a, b, lambda x, y: (x + y) / 2)
    return divergence(a, mean) + divergence(b, mean)
