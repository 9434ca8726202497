"""Vectors held as array<double>, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def doubles(v: Column | str) -> Column:
    return (v if isinstance(v, Column) else F.col(v)).cast("array<double>")


def with_value(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once a row: a lambda evaluates what it only refers to for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column, epsilon: float = EPSILON) -> Column:
    return with_value(v, lambda a: with_value(norm(a) + epsilon, lambda n: F.transform(a, lambda x: x / n)))


def cosine(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    return dot(a, b) / ((norm(a) + epsilon) * (norm(b) + epsilon))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Through the expansion a*a - 2ab + b*b, held at zero or over."""
    return F.sqrt(F.greatest(F.lit(0.0), dot(a, a) - 2 * dot(a, b) + dot(b, b)) + EPSILON)


def is_nonzero(v: Column) -> Column:
    return F.exists(v, lambda x: x != 0)


def mean_of(vectors: Column) -> Column:
    """Element-wise mean of an array of vectors."""
    def mean(all_: Column) -> Column:
        n = F.size(all_)
        total = F.aggregate(F.slice(all_, F.lit(2), F.greatest(n - 1, F.lit(0))), F.element_at(all_, 1), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
        return F.when(n > 0, F.transform(total, lambda x: x / n))

    return with_value(vectors, mean)


def strided(vectors: Column, parts: int = 10) -> Column:
    """Every so many-th element, about ``parts`` of them."""
    step = F.greatest(F.lit(1), F.floor(F.size(vectors) / parts).cast("int"))
    return F.filter(vectors, lambda _, i: i % step == 0)
