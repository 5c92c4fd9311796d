"""Layer assembly and the full screening job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from idsift.operators import ocr, risk, validation
from idsift.policy import RiskPolicy


def assemble(docs: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """Left-join layer tables by document; an absent layer stays NULL.

    Every layer has one row per document, so a join never multiplies rows. All
    joins share the document key and therefore one partitioning.
    """
    out = docs
    for name, layer in layers.items():
        clash = set(out.columns) & set(layer.columns) - {"doc_id"}
        if clash:
            raise ValueError(f"layer {name} repeats columns {sorted(clash)}")
        out = out.join(layer, "doc_id", "left")
    return out


def status(df: DataFrame) -> DataFrame:
    """Staged status, screening status and failures from per-layer columns.

    Staged: the first of capture, reading and validation that is not ``ok``.
    Screening: a gated capture decides alone; any failed layer means insufficient
    evidence; otherwise the score decides. ``failures`` holds stage and error
    class only.
    """
    staged = F.coalesce(
        *[F.when(F.col(c) != "ok", F.col(c)) for c in ("capture_status", "ocr_status", "validation_status")],
        F.lit("ok"),
    )
    gated = F.col("capture_status") != "ok"
    screening = (
        F.when(gated, F.col("capture_status"))
        .when(F.size("failures") > 0, "insufficient_evidence")
        .otherwise(F.col("risk_status"))
    )
    return df.withColumn("staged_status", staged).withColumn("screening_status", screening)


def summary(df: DataFrame) -> DataFrame:
    """Review metadata only: no names, numbers, images or raw text survive."""
    names = F.array(*[F.lit(n) for n in validation.COMPARED])
    flags = F.array(*[F.col(f"x_{n}") for n in validation.COMPARED])
    mismatched = F.array_compact(
        F.transform(F.arrays_zip(names.alias("n"), flags.alias("x")), lambda p: F.when(~p["x"], p["n"]))
    )
    failed = F.transform(F.filter("checks", lambda c: ~c["valid"]), lambda c: c["field"])
    none = F.array().cast("array<string>")
    # A layer that wasn't joined has not run.
    own = lambda c, t="string": F.col(c) if c in df.columns else F.lit(None).cast(t)
    layer = lambda c: F.coalesce(own(c), F.lit("not_run"))
    stages = F.transform("failures", lambda f: f["stage"]) if "failures" in df.columns else none
    return df.select(
        "doc_id",
        own("reference_date").alias("reference_date"),
        F.col("screening_status").alias("processing_status"),
        "document_type",
        "score",
        "category",
        "missing_required",
        layer("capture_status").alias("capture"),
        layer("ocr_status").alias("ocr"),
        layer("validation_status").alias("validation"),
        layer("tampering_status").alias("tampering"),
        layer("face_status").alias("face"),
        layer("liveness_status").alias("liveness"),
        own("cosine_similarity", "double").alias("face_similarity"),
        own("decision").alias("face_decision"),
        stages.alias("failure_stages"),
        own("duration_ms", "double").alias("duration_ms"),
        F.struct(
            "score", "score_lo", "score_hi", "coverage", "category", "missing_required", "risk_status",
            F.transform("contributions", lambda c: F.struct(c["name"], c["points"], c["complete"])).alias("points"),
        ).alias("risk"),
        F.coalesce(mismatched, none).alias("mismatch_fields"),
        F.coalesce(failed, none).alias("failed_check_fields"),
        F.lit(False).alias("actor_verified"),
        F.lit(False).alias("images_retained"),
    )


def screen(
    ocr_lines: DataFrame,
    ref_list: DataFrame | None,
    codes: list[str],
    layers: dict[str, DataFrame] | None = None,
    reference: Column | None = None,
    policy: RiskPolicy | None = None,
) -> DataFrame:
    """Text lines to score. Scoring adds no shuffle: signals stay columns of the
    document row, and other layers' signal columns join on the document."""
    documents = ocr.resolve(ocr_lines)
    validated = validation.run(documents, ref_list, codes, reference)
    with_signals = risk.validation_signals(validated)
    return risk.score_wide(assemble(with_signals, layers or {}), policy)
