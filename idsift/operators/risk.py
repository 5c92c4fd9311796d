"""Ten risk signals and the transparent weighted score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from idsift.functions.tables import explode_rows
from idsift.policy import RiskPolicy

SIGNAL = "struct<value:double,complete:boolean,explanation:string,source:string,experimental:boolean>"

# Which findings feed which signal.
DATE_FLAGS = [
    "DOCUMENT_EXPIRED", "DOB_IMPLAUSIBLE", "EXPIRY_IMPLAUSIBLE", "ISSUE_EXPIRY_ORDER",
    "FUTURE_ISSUE", "ISSUE_BEFORE_BIRTH", "VISA_WINDOW_INVALID", "VISA_NOT_YET_VALID",
    "VISA_ENTRY_WINDOW_EXPIRED", "VISA_STAY_INVALID", "INVALID_MRZ_DATE",
]
DATE_UNKNOWN = ["DATE_UNREADABLE", "DOB_CENTURY_AMBIGUOUS", "EXPIRY_CENTURY_INFERRED"]
FORMAT_FLAGS = ["COUNTRY_CODE_UNKNOWN", "NUMBER_FORMAT", "COUNTRY_NUMBER_FORMAT"]
NO_POSITIVE = "Nothing in the evidence counts against the document; a person must still look."
MISSING_SUFFIX = ". What is missing may still count against it."


def _signal(name: str, value: Column, complete: Column, explanation: Column | str, source: str, experimental: bool | Column = False) -> Column:
    text = F.lit(explanation) if isinstance(explanation, str) else explanation
    flag = experimental if isinstance(experimental, Column) else F.lit(experimental)
    return F.struct(
        value.cast("double").alias("value"), complete.alias("complete"), text.alias("explanation"),
        F.lit(source).alias("source"), flag.alias("experimental"),
    ).alias(f"s_{name}")


def _codes_in(wanted: list[str]) -> Column:
    codes = F.transform("findings", lambda f: f["code"])
    return F.array_sort(F.array_intersect(codes, F.array(*[F.lit(c) for c in wanted])))


def validation_signals(validated: DataFrame) -> DataFrame:
    """Add ``s_mrz, s_cross_fields, s_dates, s_blacklist, s_format``; no shuffle."""
    known = F.filter("checks", lambda c: c["valid"].isNotNull())
    n_known = F.coalesce(F.when(F.col("checks").isNotNull(), F.size(known)), F.lit(0))
    n_checks = F.coalesce(F.when(F.col("checks").isNotNull(), F.size("checks")), F.lit(0))
    supported = F.coalesce(F.when(F.col("limitations").isNotNull(), F.size("limitations")), F.lit(0)) == 0
    compared = [F.col(f"x_{n}") for n in ("dob", "expiry", "name", "number")]
    n_compared = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in compared])
    staged = validated.select(
        "*",
        n_known.alias("_known"), n_checks.alias("_checks"), supported.alias("_supported"),
        F.exists("checks", lambda c: F.coalesce(~c["valid"], F.lit(False))).alias("_failed"),
        n_compared.alias("_compared"),
        _codes_in(DATE_FLAGS).alias("_date_flags"), _codes_in(DATE_UNKNOWN).alias("_date_unknown"),
        _codes_in(FORMAT_FLAGS).alias("_format_flags"),
    )
    dates_known = (
        F.col("resolved_dob").isNotNull() & F.col("resolved_expiry").isNotNull()
        & (F.size("_date_unknown") == 0)
    )
    listed = F.col("database_available") & F.col("blacklist_hit").isNotNull()
    format_known = (F.col("_known") > 0) & F.col("_supported")
    any_format = F.size("_format_flags") > 0

    def named(flags: str, prefix: str, none: str) -> Column:
        return F.concat(
            F.lit(prefix), F.when(F.size(flags) > 0, F.array_join(flags, ", ")).otherwise(none)
        )

    return staged.select(
        *validated.columns,
        _signal(
            "mrz", F.when(F.col("_known") > 0, F.col("_failed").cast("double")),
            (F.col("_checks") > 0) & (F.col("_known") == F.col("_checks")) & F.col("_supported"),
            "One capped signal for failed zone checks; a misread can also fail a check.", "L2",
        ),
        _signal(
            "cross_fields",
            F.when(F.col("_compared") > 0, F.least(F.col("mismatch_count") / 2, F.lit(1.0))),
            F.col("_compared") == 4,
            F.concat(F.col("mismatch_count").cast("string"), F.lit(" disagreeing fields between zone and print; two reach the cap.")),
            "L2",
        ),
        _signal(
            "dates", F.when(F.size("_date_flags") > 0, 1.0).when(dates_known, 0.0), dates_known,
            named("_date_flags", "Date rules: ", "none broken; unresolved dates stay unknown."),
            "L2",
        ),
        _signal(
            "blacklist", F.when(listed, F.col("blacklist_hit").cast("double")), listed,
            "Reference-list lookup over fictional entries.", "L2 lookup", True,
        ),
        _signal(
            "format", F.when(format_known | any_format, any_format.cast("double")), format_known,
            named("_format_flags", "Country and number rules: ", "none broken."),
            "L2 policy", True,
        ),
    )


def forensic_signals(rolled: DataFrame) -> DataFrame:
    """``s_tampering, s_metadata`` from the detector roll-up."""
    return rolled.select(
        "doc_id",
        _signal(
            "tampering", F.col("spatial"), F.col("spatial_complete"),
            "Largest spatial detector score; correlated detectors are not added up.",
            "L3 spatial", True,
        ),
        _signal(
            "metadata", F.col("metadata"), F.col("metadata_complete"),
            "Largest file-metadata score; editing alone proves nothing.",
            "L3 metadata", True,
        ),
    )


def face_signal(verified: DataFrame) -> DataFrame:
    """``s_face``, recomputed from the similarity and never taken from a decision."""
    usable = (F.col("document_face_count") == 1) & (F.col("live_face_count") == 1)
    return verified.filter(
        (F.col("face_status") == "ok") & F.col("cosine_similarity").isNotNull()
    ).select(
        "doc_id",
        _signal(
            "face",
            F.when(usable, (F.col("cosine_similarity") < F.col("threshold")).cast("double")), usable,
            F.concat(
                F.lit("Cosine "), F.format_string("%.4f", "cosine_similarity"), F.lit(", threshold "),
                F.format_string("%.4f", "threshold"),
                F.lit("; a pair comparison certifies neither identity nor liveness."),
            ),
            "L4 pair", True,
        ),
    )


def liveness_signal(sequences: DataFrame) -> DataFrame:
    """``s_liveness``: only a positive spoof indicator speaks; never complete."""
    return sequences.select(
        "doc_id",
        _signal(
            "liveness", F.when(F.col("spoof_score") > 0, F.col("spoof_score")), F.lit(False),
            "Texture and repetition indicator; liveness stays unverified.", "L4 sequence", True,
        ),
    )


def duplicate_signal(hits: DataFrame) -> DataFrame:
    return hits.select(
        "doc_id",
        _signal(
            "duplicate_identity", F.col("duplicate_hit").cast("double"), F.col("duplicate_hit").isNotNull(),
            "Nearest gallery vector under another name or number.",
            "L4 gallery", True,
        ),
    )


def to_long(wide: DataFrame, names: list[str]) -> DataFrame:
    """Signal columns to rows; absent layers contribute no row."""
    rows = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"s_{n}").isNotNull(),
                    F.struct(F.lit(n).alias("name"), F.col(f"s_{n}").alias("s")),
                )
                for n in names
            ]
        )
    )
    return explode_rows(wide.select("doc_id", rows.alias("r")), ["doc_id"], "r").select(
        "doc_id", "name", "s.*"
    )


def constraints(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split off signal rows whose name or value is outside its domain."""
    v = F.col("value")
    broken = F.array_compact(
        F.array(
            F.when(~F.col("name").isin(*RiskPolicy().weights), "unknown_name"),
            F.when(F.isnan(v) | (F.abs(v) == float("inf")), "not_finite"),
            F.when(~F.isnan(v) & ((v < 0) | (v > 1)), "out_of_range"),
        )
    )
    marked = signals.withColumn("reasons", broken)
    return (
        marked.filter(F.size("reasons") == 0).drop("reasons"),
        marked.filter(F.size("reasons") > 0),
    )


def pivot(signals: DataFrame, policy: RiskPolicy) -> DataFrame:
    """Long signals to one row per document by conditional aggregation.

    With a time column ``ts`` the newest row of a signal counts, so that a corrected
    value replaces an older one; of rows of one time, and without it, the largest.
    """
    columns = signals.columns
    text = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    body = F.struct(
        F.col("value"), F.col("complete"), text("explanation").alias("explanation"),
        text("source").alias("source"),
        (F.col("experimental") if "experimental" in columns else F.lit(False)).alias("experimental"),
    )
    time = F.col("ts") if "ts" in columns else F.lit(None).cast("timestamp")
    row = F.struct(time.alias("ts"), body.alias("body"))
    return signals.groupBy("doc_id").agg(
        *[F.max(F.when(F.col("name") == n, row))["body"].cast(SIGNAL).alias(f"s_{n}") for n in policy.weights]
    )


def score_wide(wide: DataFrame, policy: RiskPolicy | None = None) -> DataFrame:
    """Score rows that carry ``s_<name>`` columns; missing columns are missing evidence."""
    policy = policy or RiskPolicy()
    total = lambda cols: reduce(lambda a, b: a + b, cols)
    names = list(policy.weights)
    filled = wide.select(
        "*", *[F.lit(None).cast(SIGNAL).alias(f"s_{n}") for n in names if f"s_{n}" not in wide.columns]
    )
    value = {n: F.col(f"s_{n}.value") for n in names}
    staged = filled.select(
        "*",
        *[
            F.bround(F.lit(float(w)) * F.coalesce(value[n], F.lit(0.0)), 4).alias(f"pt_{n}")
            for n, w in policy.weights.items()
        ],
        *[
            (F.coalesce(F.col(f"s_{n}.complete"), F.lit(False)) & value[n].isNotNull()).alias(f"ok_{n}")
            for n in names
        ],
    )
    weighted = [n for n in names if policy.weights[n] > 0]
    missing = lambda pool: F.array_compact(
        F.array(*[F.when(~F.col(f"ok_{n}"), n) for n in pool])
    )
    lower = F.bround(total([F.col(f"pt_{n}") for n in names]), 4)
    upper = F.bround(
        total([F.when(F.col(f"ok_{n}"), F.col(f"pt_{n}")).otherwise(float(policy.weights[n])) for n in names]), 4
    )
    coverage = F.bround(
        total([F.when(F.col(f"ok_{n}"), float(policy.weights[n])).otherwise(0.0) for n in names]) / 100, 4
    )
    observed = reduce(lambda a, b: a | b, [value[n].isNotNull() for n in weighted])
    summed = staged.select(
        "*", lower.alias("score_lo"), upper.alias("score_hi"), coverage.alias("coverage"),
        observed.alias("_observed"), missing(weighted).alias("missing_signals"),
        missing([n for n in weighted if n in policy.required_signals]).alias("missing_required"),
    )
    complete = F.size("missing_required") == 0
    category = F.when(
        F.col("_observed"),
        F.when(F.col("score_lo") >= policy.high_threshold, "High").when(
            complete,
            F.when(F.col("score_lo") >= policy.medium_threshold, "Medium").otherwise("Low"),
        ),
    )
    positive = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"pt_{n}") > 0,
                    F.concat(
                        F.lit(f"{n}: +"), F.format_string("%.2f", F.col(f"pt_{n}")),
                        F.lit(f"/{policy.weights[n]:g} points. "),
                        F.coalesce(F.col(f"s_{n}.explanation"), F.lit("")),
                    ),
                )
                for n in names
            ],
            F.when(
                ~complete,
                F.concat(
                    F.lit("Not all required evidence is there: "), F.array_join("missing_required", ", "),
                    F.lit(MISSING_SUFFIX),
                ),
            ),
        )
    )
    internal = [c for c in summed.columns if c.startswith(("pt_", "ok_", "_"))]
    contributions = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"), F.lit(float(policy.weights[n])).alias("weight"),
                value[n].alias("value"), F.col(f"pt_{n}").alias("points"), F.col(f"ok_{n}").alias("complete"),
                F.coalesce(F.col(f"s_{n}.explanation"), F.lit("There is no evidence to use.")).alias("explanation"),
                F.coalesce(F.col(f"s_{n}.source"), F.lit("missing")).alias("source"),
                F.coalesce(F.col(f"s_{n}.experimental"), F.lit(False)).alias("experimental"),
            )
            for n in names
        ]
    )
    return (
        summed.withColumn("score", F.when(F.col("_observed"), F.col("score_lo")))
        .withColumn("category", category)
        .withColumn(
            "reasons", F.when(F.size(positive) > 0, positive).otherwise(F.array(F.lit(NO_POSITIVE)))
        )
        .withColumn("contributions", contributions)
        .withColumn("risk_status", F.when(complete, "ok").otherwise("insufficient_evidence"))
        .withColumn("policy_version", F.lit(policy.version))
        .withColumn("policy_sha256", F.lit(policy.digest))
        .drop(*internal)
    )


def score(signals: DataFrame, policy: RiskPolicy | None = None) -> DataFrame:
    """Score a long signal table: one shuffle on the document, combined first."""
    policy = policy or RiskPolicy()
    scored = score_wide(pivot(signals, policy), policy)
    return scored.drop(*[f"s_{n}" for n in policy.weights])


def contributions(scored: DataFrame) -> DataFrame:
    return explode_rows(scored, ["doc_id"], "contributions")
