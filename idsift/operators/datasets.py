"""Dataset preparation: splits, leakage guards, label checks, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPLITS = ("train", "val", "test")
DEFAULT_SOURCE = "user-authorized-public-dataset"


def split_of(group: Column) -> Column:
    """Seven tenths train, two val, one test by a hash of the group."""
    tenth = F.conv(F.substring(F.sha2(group, 256), 1, 8), 16, 10).cast("bigint") % 10
    return F.when(tenth < 7, "train").when(tenth < 9, "val").otherwise("test")


def assign_split(df: DataFrame, group: str = "grp") -> DataFrame:
    """An explicit split wins over the hash."""
    return df.withColumn("split", F.coalesce("split", split_of(F.col(group))))


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def _leaks(df: DataFrame, key: str) -> DataFrame:
    """Keys in more than one split; two values per key survive the map side."""
    return (
        df.groupBy(key)
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .filter(F.col("first_split") != F.col("last_split"))
    )


def group_leakage(df: DataFrame, group: str = "grp") -> DataFrame:
    return _leaks(df, group)


def content_leakage(df: DataFrame, content: str = "content") -> DataFrame:
    return _leaks(df.select(content_digest(F.col(content)).alias("digest"), "split"), "digest")


def check_labels(df: DataFrame) -> DataFrame:
    """Add ``problems``: label, mask, group and split inconsistencies.

    ``mask_nonempty`` is NULL when no mask was supplied. With the sizes of image and mask
    (``width, height, mask_width, mask_height``) a mask must be as large as its image.
    """
    sizes = ("width", "height", "mask_width", "mask_height")
    other = F.lit(False)
    if set(sizes) <= set(df.columns):
        other = ~(F.col("width").eqNullSafe(F.col("mask_width")) & F.col("height").eqNullSafe(F.col("mask_height")))
    clean = F.coalesce(F.col("attack") == "clean", F.lit(False))
    no_mask = F.col("mask_nonempty").isNull()
    verified = F.coalesce("verified_clean", F.lit(False)) if "verified_clean" in df.columns else F.lit(False)
    return df.withColumn(
        "problems",
        F.array_compact(
            F.array(
                F.when(F.coalesce(F.trim("grp"), F.lit("")) == "", "blank_group"),
                F.when(~F.col("split").isin(*SPLITS), "unknown_split"),
                F.when(no_mask & ~(clean & verified), "unknown_is_not_clean"),
                F.when(~no_mask & (clean == F.col("mask_nonempty")), "label_disagrees_with_mask"),
                F.when(~no_mask & other, "mask_size_differs"),
            )
        ),
    )


def build_manifest(df: DataFrame) -> DataFrame:
    """Numbered rows with digest and defaulted source.

    The number is the row's own input position ``row_index``, so numbering needs
    no global sort.
    """
    name = F.lpad(F.col("row_index").cast("string"), 7, "0")
    # A longer number keeps all of its digits.
    number = F.when(F.length(F.col("row_index").cast("string")) > 7, F.col("row_index").cast("string")).otherwise(name)
    return df.select(
        F.concat(number, F.lit(".png")).alias("image"),
        F.concat(number, F.lit("_mask.png")).alias("mask"),
        "grp",
        F.coalesce("split", split_of(F.col("grp"))).alias("split"),
        "attack",
        F.coalesce("source", F.lit(DEFAULT_SOURCE)).alias("source"),
        content_digest(F.col("content")).alias("source_sha256"),
    )


def require_domain(df: DataFrame, domain: str) -> DataFrame:
    """One row: foreign rows, and whether every split has rows."""
    foreign = F.count_if(~F.col("source").eqNullSafe(F.lit(domain)))
    out = df.agg(
        foreign.alias("foreign_rows"),
        *[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in SPLITS],
    )
    every = (F.col("train_rows") > 0) & (F.col("val_rows") > 0) & (F.col("test_rows") > 0)
    return out.withColumn("usable", (F.col("foreign_rows") == 0) & every)


def leaked_groups(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """Evaluation groups that already occur in training; must be empty.

    Both sides shrink to one row per group before they meet.
    """
    return evaluation.select("grp").distinct().join(training.select("grp").distinct(), "grp", "left_semi")


def eval_samples(manifest: DataFrame, fresh: DataFrame) -> DataFrame:
    """Test split of the manifest plus a fresh cohort."""
    columns = ["cohort", "grp", "attack", "doc_id"]
    replay = manifest.filter(F.col("split") == "test").withColumn("cohort", F.lit("original_test_replay"))
    new = fresh.withColumn("cohort", F.lit("fresh_groups"))
    return replay.select(*columns).unionByName(new.select(*columns))


def summary(df: DataFrame) -> DataFrame:
    """Rows and groups per split; groups merge before they are counted."""
    per_group = df.groupBy("split", "grp").agg(F.count("*").alias("_n"))
    return per_group.groupBy("split").agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_groups"))
