"""Frame sequences: order checks, blink pattern, continuity, spoof, outcome.

A sequence is valid with at most twelve frames. Positions are an order and may start
anywhere and have gaps, so the twelve smallest of each sequence are kept as an array
and the rest only counted. A sequence of any length stays one bounded row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from idsift.functions import vectors
from idsift.policy import FACE_THRESHOLDS, SEQUENCE_LIMITS as L

FRAME = (
    "struct<idx:int,timestamp_ms:double,face_count:int,eyes:int,usable:boolean,same_face:boolean,"
    "contrast:double,periodic:double,digest:string>"
)


def frame_struct() -> Column:
    """One frame; face evidence counts only with exactly one good face."""
    usable = F.coalesce((F.col("face_count") == 1) & F.col("quality_ok"), F.lit(False))
    return F.struct(
        F.col("idx"), F.col("timestamp_ms"), F.col("face_count").cast("int"),
        F.when(usable, F.col("eyes_visible")).cast("int").alias("eyes"), usable.alias("usable"),
        F.when(usable, F.col("same_face_as_first")).alias("same_face"),
        F.when(usable, F.col("texture_contrast")).alias("contrast"),
        F.when(usable, F.col("periodic_energy_ratio")).alias("periodic"), F.col("digest"),
    ).cast(FRAME)


def gather(frames: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per sequence: ``n`` and ``frames``, the twelve of smallest position.

    Spark limits each sequence to its first rows before the shuffle; the count is an
    aggregate with map-side combine. Both are joined null-safe on the keys.
    """
    keys = keys or ["seq_id"]
    order = Window.partitionBy(*keys).orderBy(F.col("idx").asc_nulls_last(), F.col("timestamp_ms").asc_nulls_last())
    first = (
        frames.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= L["max_frames"])
        .groupBy(*[F.col(k).alias(f"_{k}") for k in keys])
        .agg(F.array_sort(F.collect_list(F.struct("_at", frame_struct().alias("f")))).alias("_f"))
    )
    counted = frames.groupBy(*keys).agg(F.count("*").alias("n"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return counted.join(first, on).select(*keys, "n", F.transform("_f", lambda x: x["f"]).alias("frames"))


def validate(sequences: DataFrame) -> DataFrame:
    """Add ``reason``, NULL for a valid sequence."""
    ts = F.transform("frames", lambda f: f["timestamp_ms"])
    bad_value = F.exists(
        ts, lambda t: t.isNull() | F.isnan(t) | (t < 0) | (t > L["max_timestamp_ms"])
    )
    ordered = F.forall(
        F.zip_with(F.slice(ts, 1, F.greatest(F.size(ts) - 1, F.lit(0))), F.slice(ts, 2, F.greatest(F.size(ts) - 1, F.lit(0))), lambda a, b: b > a),
        lambda ok: ok,
    )
    return sequences.withColumn(
        "reason",
        F.when(F.col("n") > L["max_frames"], "too_many_frames")
        .when(
            F.exists("frames", lambda f: f["idx"].isNull())
            | (F.size(F.array_distinct(F.transform("frames", lambda f: f["idx"]))) != F.col("n")),
            "frame_positions",
        )
        .when(bad_value, "timestamp_range")
        .when(~ordered, "timestamp_order"),
    )


def blink(sequences: DataFrame) -> DataFrame:
    """Add ``blink_candidate``: two open frames, a short closed run, two open frames."""
    fr, n = F.col("frames"), F.size("frames")
    eyes = lambda i: F.coalesce(F.get(fr, i)["eyes"], F.lit(-1))
    ts = lambda i: F.get(fr, i)["timestamp_ms"]
    steady = F.forall(fr, lambda f: f["usable"] & F.coalesce(f["same_face"], F.lit(False)))
    positions = F.sequence(F.lit(0), n - 1)
    no_gap = F.forall(
        positions, lambda i: (i == 0) | (ts(i) - ts(i - 1) <= L["max_frame_gap_ms"])
    )

    def opens(start: Column) -> Column:
        # First frame after ``start`` whose eyes are not closed.
        end = F.get(F.filter(positions, lambda j: (j > start) & (eyes(j) != 0)), F.lit(0))
        span = ts(end) - ts(start)
        return (
            (start >= 2) & (eyes(start - 2) == 2) & (eyes(start - 1) == 2) & (eyes(start) == 0)
            & (eyes(end) == 2) & (eyes(end + 1) == 2)
            & (span >= L["min_blink_duration_ms"]) & (span <= L["max_blink_duration_ms"])
        )

    found = F.exists(positions, lambda i: F.coalesce(opens(i), F.lit(False)))
    return sequences.withColumn(
        "blink_candidate",
        F.when(F.col("reason").isNull(), (n >= L["min_blink_frames"]) & steady & no_gap & found),
    )


def repeats(sequences: DataFrame) -> DataFrame:
    distinct = F.size(F.array_distinct(F.transform("frames", lambda f: f["digest"])))
    return sequences.withColumn("repeated_frames", F.when(F.col("reason").isNull(), F.size("frames") - distinct))


def spoof(sequences: DataFrame) -> DataFrame:
    """Largest per-frame indicator; a fully repeated sequence scores one."""
    per_frame = F.transform(
        F.filter("frames", lambda f: f["usable"]),
        lambda f: (
            F.lit(0.5) * (f["contrast"] < L["min_texture_contrast"]).cast("int")
            + F.lit(0.5) * (f["periodic"] > L["max_periodic_ratio"]).cast("int")
        ),
    )
    all_same = (F.col("n") > 1) & (F.col("repeated_frames") == F.col("n") - 1)
    score = F.when(all_same, 1.0).otherwise(F.array_max(per_frame))
    return sequences.withColumn("all_repeated", F.coalesce(all_same, F.lit(False))).withColumn(
        "spoof_score", F.when(F.col("reason").isNull(), score)
    )


def outcome(frames: DataFrame) -> DataFrame:
    """Findings, verdict and status per sequence; there is never a liveness score."""
    return outcome_of(gather(frames))


def outcome_of(gathered: DataFrame) -> DataFrame:
    seq = spoof(repeats(blink(validate(gathered))))
    missing = F.transform(
        F.filter("frames", lambda f: ~f["usable"]), lambda f: F.lit("LIVENESS_FACE_EVIDENCE_MISSING")
    )
    broken = F.exists("frames", lambda f: F.coalesce(~f["same_face"], F.lit(False)))
    suspicious = F.coalesce(F.col("spoof_score") >= L["suspicious_score"], F.lit(False))
    rest = F.array_compact(
        F.array(
            F.when(F.col("all_repeated"), "REPEATED_FRAMES"),
            F.when(broken, "FACE_CONTINUITY_FAILED"),
            F.when(suspicious, "SPOOF_HEURISTIC"),
        )
    )
    valid = F.col("reason").isNull()
    return (
        seq.withColumn("_codes", F.concat(missing, rest))
        .withColumn(
            "liveness_status",
            F.when(valid, F.when((F.col("n") == 1) | (F.size("_codes") > 0), "insufficient_evidence").otherwise("ok")),
        )
        .withColumn("liveness_verdict", F.when(valid, F.when(suspicious, "suspicious").otherwise("inconclusive")))
        .withColumn(
            "liveness_codes", F.when(valid, F.concat("_codes", F.array(F.lit("LIVENESS_NOT_VERIFIED"))))
        )
        .drop("_codes")
    )


def continuity(frames: DataFrame, threshold: float | None = None) -> DataFrame:
    """Each frame against the first frame that has a vector; NULL without one.

    Rows: ``seq_id, idx, embedding``. The first vector is an aggregate joined back,
    so a long sequence is not gathered.
    """
    limit = FACE_THRESHOLDS["cosine_threshold"] if threshold is None else threshold
    usable = F.col("embedding").isNotNull()
    first = frames.filter(usable).groupBy("seq_id").agg(F.min_by("embedding", "idx").alias("_first"))
    joined = frames.join(first, "seq_id", "left")
    return joined.withColumn(
        "same_face_as_first", vectors.cosine(F.col("_first"), F.col("embedding")) >= limit
    ).drop("_first")
