"""Vectors as ``array<double>`` columns. All stays in the JVM; sums run left to right in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v over its norm; the zero vector stays."""
    return F.when(norm(v) == 0, v).otherwise(F.transform(v, lambda x: x / norm(v)))


def l2_normalise(v: Column) -> Column:
    """v over its norm plus 1e-8, which also covers the zero vector."""
    return F.transform(v, lambda x: x / (norm(v) + F.lit(1e-8)))


def minus_scaled(a: Column, b: Column, weight: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x - F.lit(float(weight)) * y)


def mean_of(v: Column, dim: int) -> Column:
    """Element-wise mean as an aggregate: one partial average an element, no explode."""
    return F.array(*[F.avg(v[i]) for i in range(dim)])


def sum_of(v: Column, dim: int) -> Column:
    return F.array(*[F.sum(v[i]) for i in range(dim)])
