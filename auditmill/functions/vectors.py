"""Vector functions as column expressions, for row-by-row use. Joins use `operators.knn`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null if either vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def vector_or_zero(a: Column, dim: int) -> Column:
    """A missing vector, or one of another width, becomes the zero vector."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return F.when(F.size(a) == dim, a.cast("array<float>")).otherwise(zero)
