"""Column functions on vectors held as ARRAY<DOUBLE>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(values: Column) -> Column:
    return values.cast("array<double>")


def _fold(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda total, t: total + t)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value computed once although f uses it for every element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0.0) | (nb == 0.0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return _once(norm(a), lambda n: F.when(n == 0.0, a).otherwise(F.transform(a, lambda x: x / n)))


def remove_component(a: Column, direction: Column) -> Column:
    """a without its part along ``direction`` (a unit vector)."""
    return _once(dot(a, direction), lambda p: F.zip_with(a, direction, lambda x, w: x - p * w))
