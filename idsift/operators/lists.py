"""Reference-list keys, lookups and idempotent upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def document_key(country: Column, number: Column) -> Column:
    """SHA-256 of ``COUNTRY:NUMBER``; NULL when a part is missing."""
    part = lambda c: F.upper(F.trim(c))
    return F.sha2(F.concat(part(country), F.lit(":"), part(number)), 256)


def _join_key(key: Column, row_id: Column) -> Column:
    """Rows without a key get one that matches nothing, so that they spread over
    all tasks instead of meeting in the one that holds NULL."""
    return F.coalesce(key, F.concat(F.lit("none:"), row_id.cast("string")))


def lookup(docs: DataFrame, ref_list: DataFrame | None) -> DataFrame:
    """Blacklist and sighting columns for rows with ``doc_id, country, number``.

    A loaded list answers misses with false and zero; an absent list, issuer or
    number answers nothing at all. The list has one row per key and grows with
    the data, so no broadcast is forced: Spark broadcasts it only below its own
    size limit and otherwise shuffles, splitting skewed keys.
    """
    country, number = F.nullif(F.col("country"), F.lit("")), F.nullif(F.col("number"), F.lit(""))
    if ref_list is None:
        return docs.select(
            "*",
            F.lit(False).alias("database_available"),
            F.lit(None).cast("boolean").alias("blacklist_hit"),
            F.lit(None).cast("int").alias("previously_seen"),
        )
    key = document_key(country, number)
    keyed = docs.withColumn("_usable", key.isNotNull()).withColumn(
        "document_key", _join_key(key, F.col("doc_id"))
    )
    ref = ref_list.select("document_key", "blacklisted", "seen_count")
    joined = keyed.join(ref, "document_key", "left")
    return joined.select(
        *docs.columns,
        F.col("_usable").alias("database_available"),
        F.when(F.col("_usable"), F.coalesce("blacklisted", F.lit(False))).alias("blacklist_hit"),
        F.when(F.col("_usable"), F.coalesce("seen_count", F.lit(0))).alias("previously_seen"),
    )


def insert_missing(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append: new keys only, one per key; stored rows never change."""
    # Aggregates are combined before the shuffle, so a repeated key stays cheap.
    cols = [c for c in incoming.columns if c != "document_key"]
    one = incoming.groupBy("document_key").agg(F.min(F.struct(*cols)).alias("r"))
    fresh = one.join(existing.select("document_key"), "document_key", "left_anti")
    return fresh.select("document_key", "r.*")
