"""Queries over risk signals, scores and whole screening results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from idsift.operators import faces, forensics, imaging, pipeline, quality, risk, sequences, validation
from idsift.plans import oracle as O, records, signals, views
from idsift.policy import RiskPolicy

QUERIES: dict = {}
SQL: dict = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


SIGNAL_SCORE = O.scoring("signals", "signals")
PIPE_SCORE = O.scoring("val_signals", "val")
SCORE_COLUMNS = "doc_id, score, category, score_lo, score_hi, coverage, risk_status"


def scored(spark, sf) -> DataFrame:
    return risk.score(views.signals(spark, sf))


def screened(spark, sf, layers=None) -> DataFrame:
    return pipeline.screen(
        views.stored_lines(spark, sf), views.ref_list(spark, sf), validation.country_codes(spark), layers
    )


@query("pipeline_score", O.query(f"SELECT {SCORE_COLUMNS} FROM scored_docs", **PIPE_SCORE))
def flagship(spark, sf):
    return screened(spark, sf).select(*SCORE_COLUMNS.split(", "))


@query("g9_validation_signals", O.query("SELECT doc_id, name, value, complete FROM val_signals"))
def g9(spark, sf):
    wide = risk.validation_signals(records.validated(spark, sf))
    names = ["mrz", "cross_fields", "dates", "blacklist", "format"]
    return risk.to_long(wide, names).select("doc_id", "name", "value", "complete")


@query("g10_weighted_score", O.query(f"SELECT {SCORE_COLUMNS} FROM scored_docs", **SIGNAL_SCORE))
def g10(spark, sf):
    return scored(spark, sf).select(*SCORE_COLUMNS.split(", "))


@query("g10_contributions", O.query("SELECT doc_id, name, weight, value, points, complete FROM contrib", **SIGNAL_SCORE))
def g10c(spark, sf):
    return risk.contributions(scored(spark, sf)).select("doc_id", "name", "weight", "value", "points", "complete")


@query("g11_bounds_coverage", O.query("SELECT doc_id, score_lo, score_hi, coverage FROM scored_docs", **SIGNAL_SCORE))
def g11(spark, sf):
    return scored(spark, sf).select("doc_id", "score_lo", "score_hi", "coverage")


@query("g12_missing_signals", O.query("SELECT doc_id, missing, missing_required FROM scored_docs", **SIGNAL_SCORE))
def g12(spark, sf):
    return scored(spark, sf).select(
        "doc_id", F.array_join("missing_signals", ",").alias("missing"),
        F.array_join("missing_required", ",").alias("missing_required"),
    )


@query("g13_category_mix", O.query("SELECT category, risk_status, count(*) AS n FROM scored_docs GROUP BY ALL", **SIGNAL_SCORE))
def g13(spark, sf):
    return scored(spark, sf).groupBy("category", "risk_status").agg(F.count("*").alias("n"))


@query("g14_reasons", O.query(f"""
SELECT doc_id, CASE WHEN text = '' THEN '{risk.NO_POSITIVE}' ELSE text END AS reasons FROM (
SELECT doc_id, concat_ws('|', nullif(string_agg(name || ': +' || printf('%.2f', points) || '/' || CAST(weight AS INT) || ' points. ', '|' ORDER BY ord) FILTER (points > 0), ''),
  'Not all required evidence is there: ' || nullif(string_agg(name, ', ' ORDER BY ord) FILTER (NOT complete AND name IN ({O.REQUIRED})), '') || '. What is missing may still count against it.') AS text
FROM contrib GROUP BY doc_id) g""", **SIGNAL_SCORE))
def g14(spark, sf):
    return scored(spark, sf).select("doc_id", F.array_join("reasons", "|").alias("reasons"))


@query("u3_code_sets", O.query(f"""
SELECT v.doc_id, {O._any(risk.DATE_FLAGS)} AS date_flag, {O._any(risk.DATE_UNKNOWN)} AS date_unknown, {O._any(risk.FORMAT_FLAGS)} AS format_flag
FROM val v LEFT JOIN codes c ON c.doc_id = v.doc_id"""))
def u3(spark, sf):
    has = lambda wanted: F.size(risk._codes_in(wanted)) > 0
    return records.validated(spark, sf).select(
        "doc_id", has(risk.DATE_FLAGS).alias("date_flag"), has(risk.DATE_UNKNOWN).alias("date_unknown"),
        has(risk.FORMAT_FLAGS).alias("format_flag"),
    )


@query("x1_constraints", O.query("""
SELECT event_id, array_to_string(list_filter([CASE WHEN value < 1 OR value > 80 THEN 'value_range' END,
  CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'event_type_domain' END,
  CASE WHEN NOT regexp_full_match(props, '\\{"k": [0-9]{2}\\}') THEN 'props_pattern' END], lambda v: v IS NOT NULL), ',') AS violations FROM events"""))
def x1(spark, sf):
    spec = [
        quality.in_range("value", 1, 80), quality.one_of("event_type", ["click", "view", "purchase"]),
        quality.matches("props", r'\{"k": [0-9]{2}\}'),
    ]
    marked = quality.constraints(views.table(spark, sf, "events"), spec)
    return marked.select("event_id", F.array_join("violations", ",").alias("violations"))


@query("x1_signal_quarantine", O.query("""
SELECT doc_id, name, CASE WHEN v < 0 OR v > 1 THEN 'out_of_range' ELSE '' END AS reason
FROM (SELECT l_orderkey * 10 + l_linenumber AS doc_id, 'mrz' AS name, l_quantity / 50 * (1 + l_discount) - 0.1 AS v FROM lineitem) q"""))
def x1s(spark, sf):
    raw = views.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), F.lit("mrz").alias("name"),
        (F.col("l_quantity") / 50 * (1 + F.col("l_discount")) - 0.1).alias("value"),
    )
    good, bad = risk.constraints(raw)
    return good.select("doc_id", "name", F.lit("").alias("reason")).unionByName(
        bad.select("doc_id", "name", F.array_join("reasons", ",").alias("reason"))
    )


@query("x3_regions", O.query("""
SELECT l_orderkey, l_linenumber, l_partkey, ok, count(*) AS n FROM (
SELECT l_orderkey, l_linenumber, l_partkey, l_discount >= 0 AND l_tax >= 0 AND l_quantity / 50 - 0.1 > 0 AND w2 > 0 AND l_discount + (l_quantity / 50 - 0.1) <= 1 AND l_tax + w2 <= 1 AND l_linenumber <> 7 AS ok
FROM (SELECT *, l_linenumber / 7.0::DOUBLE AS w2 FROM lineitem) l) q GROUP BY ALL"""))
def x3(spark, sf):
    base = [F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50 - 0.1, F.col("l_linenumber") / 7.0]
    region = F.when(F.col("l_linenumber") == 7, F.array(*base[:3])).otherwise(F.array(*base))
    return (
        views.table(spark, sf, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", quality.valid_region(region).alias("ok"))
        .groupBy("l_orderkey", "l_linenumber", "l_partkey", "ok").agg(F.count("*").alias("n"))
    )


# -------------------------------------------------- capture gate on feature rows
O.define("gated", """
SELECT *, list_filter([CASE WHEN width < 600 OR height < 350 THEN 'LOW_RESOLUTION' END, CASE WHEN laplacian_variance < 45 THEN 'BLUR' END,
  CASE WHEN brightness < 55 THEN 'DARK' END, CASE WHEN brightness > 248 THEN 'OVEREXPOSED' END,
  CASE WHEN saturated_fraction > 0.45 THEN 'POSSIBLE_GLARE' END], lambda c: c IS NOT NULL) AS codes FROM features""")


@query("q2_quality_gate", O.query("SELECT doc_id, array_to_string(codes, ',') AS codes, CASE WHEN len(codes) > 0 THEN 'needs_rescan' ELSE 'ok' END AS capture_status FROM gated"))
def q2(spark, sf):
    return imaging.gate(views.features(spark, sf)).select(
        "doc_id", F.array_join("capture_codes", ",").alias("codes"), "capture_status"
    )


@query("q3_type_hint", O.query("""
SELECT doc_id, CASE WHEN ok THEN 'id' ELSE 'unknown' END AS hint, CASE WHEN ok THEN 0.35::DOUBLE END AS hint_confidence
FROM (SELECT p_partkey AS doc_id, (p_size * 40 + p_partkey % 50)::DOUBLE / (p_size * 25) BETWEEN 1.48 AND 1.68 AS ok FROM part) q"""))
def q3(spark, sf):
    shaped = views.table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"), (F.col("p_size") * 40 + F.col("p_partkey") % 50).alias("width"),
        (F.col("p_size") * 25).alias("height"),
    )
    return imaging.type_hint(shaped).select("doc_id", "hint", "hint_confidence")


# ------------------------------------------------------------- whole pipeline
O.define("layers", """
SELECT i.doc_id, CASE WHEN g.doc_id IS NULL THEN 'ok' WHEN len(g.codes) > 0 THEN 'needs_rescan' ELSE 'ok' END AS capture_status,
  CASE WHEN r.has_zone OR r.has_viz THEN 'ok' ELSE 'insufficient_evidence' END AS ocr_status,
  CASE WHEN r.fmt IS NOT NULL AND NOT list_contains(coalesce(c.codes, []), 'MRZ_VARIANT_UNSUPPORTED') THEN 'ok' ELSE 'insufficient_evidence' END AS validation_status,
  s.risk_status, i.doc_id % 13 = 0 AS failed, r.document_type, s.score, s.category, s.missing_required
FROM ids i LEFT JOIN gated g ON g.doc_id = i.doc_id LEFT JOIN resolved r ON r.doc_id = i.doc_id LEFT JOIN codes c ON c.doc_id = i.doc_id
LEFT JOIN scored_docs s ON s.doc_id = i.doc_id""")
_SCREEN = "CASE WHEN capture_status <> 'ok' THEN capture_status WHEN failed THEN 'insufficient_evidence' ELSE risk_status END"


def screened_with_status(spark, sf):
    capture = imaging.gate(views.features(spark, sf)).select("doc_id", F.col("capture_status").alias("_gate"))
    out = pipeline.assemble(screened(spark, sf), {"capture": capture})
    return pipeline.status(
        out.withColumn("capture_status", F.coalesce("_gate", F.lit("ok"))).withColumn(
            "failures",
            F.when(
                F.col("doc_id") % 13 == 0, F.array(F.struct(F.lit("L3").alias("stage"), F.lit("ValueError").alias("code")))
            ).otherwise(F.array().cast("array<struct<stage:string,code:string>>")),
        )
    )


@query("x4_status", O.query(f"""
SELECT doc_id, CASE WHEN capture_status <> 'ok' THEN capture_status WHEN ocr_status <> 'ok' THEN ocr_status ELSE validation_status END AS staged_status,
  {_SCREEN} AS screening_status FROM layers""", **PIPE_SCORE))
def x4(spark, sf):
    return screened_with_status(spark, sf).select("doc_id", "staged_status", "screening_status")


@query("x2_privacy_summary", O.query(f"""
SELECT l.doc_id, {_SCREEN.replace("failed", "l.failed")} AS processing_status, l.document_type, l.score, l.category, l.missing_required, l.capture_status AS capture, l.ocr_status AS ocr, l.validation_status AS validation,
  array_to_string(list_filter([CASE WHEN NOT x_dob THEN 'dob' END, CASE WHEN NOT x_expiry THEN 'expiry' END, CASE WHEN NOT x_name THEN 'name' END, CASE WHEN NOT x_number THEN 'number' END], lambda f: f IS NOT NULL), ',') AS mismatch_fields,
  coalesce(f.failed, '') AS failed_check_fields, '2026-10-03' AS reference_date, 'not_run' AS face, CASE WHEN l.failed THEN 'L3' ELSE '' END AS failure_stages, l.risk_status AS risk_status
FROM layers l JOIN val v ON v.doc_id = l.doc_id LEFT JOIN (SELECT doc_id, string_agg(field, ',' ORDER BY ord) FILTER (NOT valid) AS failed FROM parsed_checks GROUP BY doc_id) f ON f.doc_id = l.doc_id""", **PIPE_SCORE))
def x2(spark, sf):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return pipeline.summary(screened_with_status(spark, sf)).select(
        "doc_id", "processing_status", "document_type", "score", "category", joined("missing_required"),
        "capture", "ocr", "validation", joined("mismatch_fields"), joined("failed_check_fields"),
        "reference_date", "face", joined("failure_stages"), "risk.risk_status",
    )


# ------------------------------------------------------ all layers in one score
def all_layers(spark, sf) -> dict[str, DataFrame]:
    """Signal columns of the layers outside text, one row per document each."""
    detectors = risk.forensic_signals(forensics.rollup(views.detectors(spark, sf)))
    pairs = risk.face_signal(faces.verify(*signals.face_sides(spark, sf), 0.1))
    frames = sequences.outcome(views.frames(spark, sf)).filter(F.col("reason").isNull())
    liveness = risk.liveness_signal(frames.withColumnRenamed("seq_id", "doc_id"))
    duplicates = risk.duplicate_signal(signals.j6(spark, sf).withColumnRenamed("query_id", "doc_id"))
    return {"tampering": detectors, "face": pairs, "liveness": liveness, "duplicate": duplicates}


_ALL = """SELECT doc_id, name, value, complete FROM val_signals
UNION ALL SELECT doc_id, 'tampering', spatial, spatial_complete FROM rolled UNION ALL SELECT doc_id, 'metadata', metadata, metadata_complete FROM rolled
UNION ALL SELECT doc_id, 'face', (cosine < 0.1)::DOUBLE, true FROM verified WHERE cosine IS NOT NULL
UNION ALL SELECT seq_id, 'liveness', CASE WHEN spoof_score > 0 THEN spoof_score END::DOUBLE, false FROM seq_out WHERE reason IS NULL
UNION ALL SELECT query_id, 'duplicate_identity', duplicate_hit::DOUBLE, true FROM duplicates"""


@query("j3_layer_assembly", O.query(
    f"SELECT {SCORE_COLUMNS}, missing FROM scored_docs", **O.scoring("all_signals", "val"), all_signals=_ALL,
    duplicates=signals.DUPLICATES_SQL,
))
def j3(spark, sf):
    return screened(spark, sf, all_layers(spark, sf)).select(
        *SCORE_COLUMNS.split(", "), F.array_join("missing_signals", ",").alias("missing")
    )
