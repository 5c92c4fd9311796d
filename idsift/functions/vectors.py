"""Dense-vector functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MIN_NORM = 1e-8


def _finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) < float("inf"))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def invalid_reason(vector: Column) -> Column:
    """Why a vector cannot be used; NULL when it can."""
    return (
        F.when(vector.isNull() | (F.size(vector) == 0), "empty")
        .when(F.exists(vector, lambda v: v.isNull() | ~_finite(v)), "not_finite")
        .when(norm(vector) < MIN_NORM, "zero_length")
    )


def normalize(vector: Column) -> Column:
    """Unit vector, or NULL for an unusable one."""
    length = norm(vector)
    return F.when(invalid_reason(vector).isNull(), F.transform(vector, lambda v: v.cast("double") / length))


def cosine(left: Column, right: Column) -> Column:
    """Cosine clipped to [-1, 1]; NULL when a side is unusable or sizes differ."""
    dot = F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda s, v: s + v,
    )
    usable = (
        invalid_reason(left).isNull()
        & invalid_reason(right).isNull()
        & (F.size(left) == F.size(right))
    )
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (norm(left) * norm(right))))
    return F.when(usable, clipped)
