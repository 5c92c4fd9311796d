"""Typed-table constraints with quarantine, and region checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def in_range(name: str, low: float | None = None, high: float | None = None) -> tuple[str, Column]:
    """A NULL passes; NaN, infinity or a value outside the range does not."""
    v = F.col(name)
    bad = F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))
    if low is not None:
        bad = bad | (v < low)
    if high is not None:
        bad = bad | (v > high)
    return f"{name}_range", bad


def matches(name: str, pattern: str) -> tuple[str, Column]:
    return f"{name}_pattern", ~F.col(name).rlike(rf"^(?:{pattern})\z")


def one_of(name: str, values: list[str]) -> tuple[str, Column]:
    return f"{name}_domain", ~F.col(name).isin(values)


def required(name: str) -> tuple[str, Column]:
    return f"{name}_missing", F.col(name).isNull()


def constraints(df: DataFrame, spec: list[tuple[str, Column]]) -> DataFrame:
    """Add ``violations``, the labels of all broken constraints."""
    labels = [F.when(F.coalesce(bad, F.lit(False)), label) for label, bad in spec]
    return df.withColumn("violations", F.array_compact(F.array(*labels)))


def split(df: DataFrame, spec: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and quarantined rows with their reasons."""
    marked = constraints(df, spec)
    return (
        marked.filter(F.size("violations") == 0).drop("violations"),
        marked.filter(F.size("violations") > 0),
    )


def valid_region(region: Column) -> Column:
    """Four finite numbers ``x, y, w, h`` describing an area in the unit square."""
    finite = F.forall(region, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    at = lambda i: F.get(region, F.lit(i))
    inside = (
        (at(0) >= 0) & (at(1) >= 0) & (at(2) > 0) & (at(3) > 0)
        & (at(0) + at(2) <= 1) & (at(1) + at(3) <= 1)
    )
    return F.coalesce((F.size(region) == 4) & finite & inside, F.lit(False))
