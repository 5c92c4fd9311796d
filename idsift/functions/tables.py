"""Small helpers for nested columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def explode_rows(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row per struct in an array column.

    The outer form plus a filter says the same as a plain explode, but keeps the
    optimizer from pushing a size test on the whole array expression down
    through every projection that built it.
    """
    rows = df.select(*keys, F.explode_outer(column).alias("_row")).filter(F.col("_row").isNotNull())
    return rows.select(*keys, "_row.*")


def explode_texts(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row per text of an array column with its position ``ord``."""
    rows = df.select("doc_id", F.posexplode_outer(column).alias("ord", name))
    return rows.filter(F.col(name).isNotNull())
