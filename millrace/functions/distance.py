"""Distances between numeric array columns, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _pairs(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return _total(_pairs(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared(a: Column, b: Column) -> Column:
    return _total(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _total(_pairs(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity; 1 if either vector is zero."""
    return F.coalesce(1 - F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(1.0))


METRICS = {"manhattan": manhattan, "euclidean": euclidean, "squared": squared, "cosine": cosine}
