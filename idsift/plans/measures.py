"""Queries over evaluation metrics and dataset preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from idsift.operators import datasets, evaluation as E, mrz, ranks
from idsift.plans import oracle as O, records, views

QUERIES: dict = {}
SQL: dict = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


RATES = ("precision", "recall", "f1", "false_positive_rate", "false_negative_rate")


def rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def counts_sql(truth, pred, extra=""):
    return f"""SELECT {extra} count(*) AS n, count(*) FILTER (NOT {truth} AND NOT {pred}) AS tn, count(*) FILTER (NOT {truth} AND {pred}) AS fp,
  count(*) FILTER ({truth} AND NOT {pred}) AS fn, count(*) FILTER ({truth} AND {pred}) AS tp"""


RATE_SQL = """round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS false_positive_rate, round(fn / nullif(fn + tp, 0), 6) AS false_negative_rate"""


@query("g16_binary_metrics", O.query(f"SELECT *, {RATE_SQL} FROM (({counts_sql('truth', '(score >= 0.5)', 'cohort,')} FROM scored GROUP BY cohort) UNION ALL ({counts_sql('truth', '(score >= 0.5)', chr(39) + 'all' + chr(39) + ' AS cohort,')} FROM scored)) q"))
def g16(spark, sf):
    rows = views.scored(spark, sf).withColumn("pred", F.col("score") >= 0.5)
    total = E.binary(rows, "truth", "pred").withColumn("cohort", F.lit("all"))
    return rounded(E.binary(rows, "truth", "pred", ["cohort"]).unionByName(total), *RATES)


@query("g17_by_cohort", O.query(f"""
SELECT *, {RATE_SQL} FROM ({counts_sql('truth', 'pred', 'cohort, detector,')} FROM (
  SELECT cohort, truth, 'learned' AS detector, score >= 0.4 AS pred FROM scored UNION ALL SELECT cohort, truth, 'classical', score >= 0.55 FROM scored) u GROUP BY cohort, detector) q"""))
def g17(spark, sf):
    rows = views.scored(spark, sf).select(
        "cohort", "truth", (F.col("score") >= 0.4).alias("a"), (F.col("score") >= 0.55).alias("b")
    )
    return rounded(E.by_cohort(rows, "truth", {"learned": "a", "classical": "b"}, "cohort"), *RATES)


@query("g18_per_attack", O.query(f"""
SELECT attack, count, flagged, mean_iou, tn, fp, fn, tp, {RATE_SQL} FROM (
SELECT a.attack, count(*) FILTER (s.attack = a.attack) AS count, count(*) FILTER (s.attack = a.attack AND score >= 0.55) AS flagged,
  round(avg(CASE WHEN s.attack = a.attack AND a.attack <> 'clean' THEN iou END), 6) AS mean_iou,
  CASE WHEN a.attack <> 'clean' THEN count(*) FILTER (s.attack = 'clean' AND score < 0.55) END AS tn, CASE WHEN a.attack <> 'clean' THEN count(*) FILTER (s.attack = 'clean' AND score >= 0.55) END AS fp,
  CASE WHEN a.attack <> 'clean' THEN count(*) FILTER (s.attack = a.attack AND score < 0.55) END AS fn, CASE WHEN a.attack <> 'clean' THEN count(*) FILTER (s.attack = a.attack AND score >= 0.55) END AS tp
FROM (VALUES ('clean'), ('text_replacement'), ('copy_move'), ('stamp_edit')) a(attack) JOIN (SELECT *, CASE WHEN doc_id % 7 <> 0 THEN score / 2 END AS iou FROM scored) s ON s.attack IN (a.attack, 'clean') GROUP BY a.attack) q"""))
def g18(spark, sf):
    rows = views.scored(spark, sf).select(
        "attack", (F.col("score") >= 0.55).alias("flagged"),
        F.when(F.col("doc_id") % 7 != 0, F.col("score") / 2).alias("iou"),
    )
    out = E.per_attack(rows, ["clean", "text_replacement", "copy_move", "stamp_edit"])
    return rounded(out, "mean_iou", *RATES)


@query("g19_mask_iou", O.query("SELECT image_id, round(count(*) FILTER (truth AND v >= 0.5) / nullif(count(*) FILTER (truth OR v >= 0.5), 0), 6) AS iou FROM cells GROUP BY image_id"))
def g19(spark, sf):
    return rounded(E.iou(views.cells(spark, sf), F.col("truth"), F.col("v") >= 0.5, ["image_id"]), "iou")


@query("g20_image_flag", O.query("SELECT image_id, round(avg((v >= 0.5)::INT), 6) AS fraction, avg((v >= 0.5)::INT) >= 0.02 AS flagged FROM cells GROUP BY image_id"))
def g20(spark, sf):
    return rounded(E.image_flag(views.cells(spark, sf), ["image_id"], "v"), "fraction")


@query("g21_latency", O.query("""
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, round(median(value), 6) AS median_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms,
  min(value) AS min_ms, max(value) AS max_ms FROM events WHERE value >= 0 AND isfinite(value) GROUP BY event_type"""))
def g21(spark, sf):
    summary, _ = E.latency(views.table(spark, sf, "events").select("event_type", "value"), "value", ["event_type"])
    return rounded(summary, "mean_ms", "median_ms", "p95_ms").select(
        "event_type", "n", "mean_ms", "median_ms", "p95_ms", "min_ms", "max_ms"
    )


_LATENCY = """count(*) AS n, round(avg(value), 6) AS mean_ms, round(median(value), 6) AS median_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms,
  min(value) AS min_ms, max(value) AS max_ms"""


@query("g21_latency_groups", O.query(f"""
SELECT nullif(event_type, 'error') AS event_type, {_LATENCY} FROM events WHERE value >= 0 AND isfinite(value) GROUP BY ALL
UNION ALL SELECT 'all rows', {_LATENCY} FROM events WHERE value >= 0 AND isfinite(value)"""))
def g21n(spark, sf):
    """A null group, and all rows as one group."""
    kind = F.col("event_type")
    rows = views.table(spark, sf, "events").select(F.when(kind != "error", kind).alias("event_type"), "value")
    each, _ = E.latency(rows, "value", ["event_type"])
    whole, _ = E.latency(rows, "value")
    names = ["event_type", "n", "mean_ms", "median_ms", "p95_ms", "min_ms", "max_ms"]
    both = each.select(*names).unionByName(whole.withColumn("event_type", F.lit("all rows")).select(*names))
    return rounded(both, "mean_ms", "median_ms", "p95_ms").select(*names)


@query("g21_layer_latency", O.query("""
SELECT layer, count(*) AS n, round(median(d), 6) AS median_ms, round(quantile_cont(d, 0.95), 6) AS p95_ms FROM (
  SELECT 'capture' AS layer, l_quantity AS d FROM lineitem UNION ALL SELECT 'ocr', l_extendedprice FROM lineitem UNION ALL SELECT 'rules', l_tax FROM lineitem) q GROUP BY layer"""))
def g21b(spark, sf):
    wide = views.table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_quantity").alias("capture"), F.col("l_extendedprice").alias("ocr"), F.col("l_tax").alias("rules")
    )
    long = E.unpivot_layers(wide, ["l_orderkey"], ["capture", "ocr", "rules"])
    summary, _ = E.latency(long, "duration_ms", ["layer"])
    return rounded(summary, "median_ms", "p95_ms").select("layer", "n", "median_ms", "p95_ms")


# ----------------------------------------------------- field-level accuracy
O.define("field_truth", "SELECT doc_id, 'viz' AS channel, 'number' AS field, number AS expected FROM ids UNION ALL SELECT doc_id, 'viz', 'name', surname || ' ' || given_names FROM ids "
         "UNION ALL SELECT doc_id, 'viz', 'gender', gender FROM ids UNION ALL SELECT doc_id, 'mrz', 'number', number FROM ids UNION ALL SELECT doc_id, 'mrz', 'name', surname || ' ' || given_names FROM ids "
         "UNION ALL SELECT doc_id, 'mrz', 'dob', strftime(dob, '%y%m%d') FROM ids UNION ALL SELECT doc_id, 'mrz', 'expiry', strftime(expiry, '%y%m%d') FROM ids UNION ALL SELECT doc_id, 'mrz', 'gender', gender FROM ids")
O.define("field_observed", "SELECT doc_id, 'viz' AS channel, 'number' AS field, v_number AS observed FROM viz_wide UNION ALL SELECT doc_id, 'viz', 'name', v_name FROM viz_wide UNION ALL SELECT doc_id, 'viz', 'gender', v_gender FROM viz_wide "
         + " ".join(f"UNION ALL SELECT doc_id, 'mrz', '{f}', {f}_value FROM parsed" for f in ("number", "name", "dob", "expiry", "gender")))
O.define("field_matches", "SELECT t.doc_id, t.channel, t.field, t.expected, o.observed, coalesce(t.expected = o.observed, false) AS match FROM field_truth t LEFT JOIN field_observed o ON o.doc_id = t.doc_id AND o.channel = t.channel AND o.field = t.field")


def matches(spark, sf):
    def long(df, rows):
        items = F.array(*[
            F.struct(F.lit(c).alias("channel"), F.lit(f).alias("field"), v.alias("value")) for c, f, v in rows
        ])
        return df.select("doc_id", F.explode(items).alias("r")).select("doc_id", "r.*")

    name = F.concat_ws(" ", "surname", "given_names")
    truth = long(views.ids(spark, sf), [
        ("viz", "number", F.col("number")), ("viz", "name", name), ("viz", "gender", F.col("gender")),
        ("mrz", "number", F.col("number")), ("mrz", "name", name), ("mrz", "gender", F.col("gender")),
        ("mrz", "dob", F.date_format("dob", "yyMMdd")), ("mrz", "expiry", F.date_format("expiry", "yyMMdd")),
    ]).withColumnRenamed("value", "expected")
    seen = long(records.documents(spark, sf), [
        *[("viz", f, F.col(f"v_{f}")) for f in ("number", "name", "gender")],
        *[("mrz", f, F.col(f"f_{f}.corrected")) for f in ("number", "name", "dob", "expiry", "gender")],
    ]).withColumnRenamed("value", "observed")
    return E.field_matches(truth, seen)


@query("j12_field_matches", O.query("SELECT * FROM field_matches"))
def j12(spark, sf):
    return matches(spark, sf)


@query("g22_field_accuracy", O.query("""
SELECT channel, field, count(*) FILTER (match) AS correct, count(*) AS total, round(count(*) FILTER (match) / count(*), 6) AS accuracy FROM field_matches GROUP BY channel, field
UNION ALL SELECT channel, 'overall', count(*) FILTER (match), count(*), round(count(*) FILTER (match) / count(*), 6) FROM field_matches GROUP BY channel"""))
def g22(spark, sf):
    return rounded(E.field_accuracy(matches(spark, sf)), "accuracy")


@query("k4_field_errors", O.query("SELECT doc_id, channel, field, expected, observed FROM field_matches WHERE NOT match"))
def k4(spark, sf):
    return E.errors(matches(spark, sf)).drop("match")


@query("g23_check_pass_rates", O.query("""
SELECT valid_documents, parsed_valid_documents, all_checks_pass, invalid_documents, invalid_flagged, round(all_checks_pass / valid_documents, 6) AS end_to_end_pass_rate, round(all_checks_pass / parsed_valid_documents, 6) AS conditional_pass_rate FROM (
SELECT count(*) FILTER (variant NOT IN (1, 12)) AS valid_documents, count(*) FILTER (variant NOT IN (1, 12) AND n > 0) AS parsed_valid_documents, count(*) FILTER (variant NOT IN (1, 12) AND n = good) AS all_checks_pass,
  count(*) FILTER (variant IN (1, 12)) AS invalid_documents, count(*) FILTER (variant IN (1, 12) AND bad > 0) AS invalid_flagged
FROM ids LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (valid) AS good, count(*) FILTER (NOT valid) AS bad FROM parsed_checks GROUP BY doc_id) c USING (doc_id)) q"""))
def g23(spark, sf):
    truth = views.ids(spark, sf).select("doc_id", (~F.col("variant").isin(1, 12)).alias("expected_valid"))
    seen = records.documents(spark, sf).select(
        "doc_id", F.col("fmt").isNotNull().alias("parsed"),
        F.coalesce(F.forall("checks", lambda c: F.coalesce(c["valid"], F.lit(False))), F.lit(False)).alias("all_pass"),
        F.coalesce(F.exists("checks", lambda c: F.coalesce(~c["valid"], F.lit(False))), F.lit(False)).alias("any_failed"),
    )
    out = E.check_pass_rates(truth.join(seen, "doc_id", "left"))
    return rounded(out, "end_to_end_pass_rate", "conditional_pass_rate")


@query("w4_roc", O.query("""
SELECT cohort, threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM (
SELECT cohort, NULL::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr FROM scored GROUP BY cohort HAVING bool_or(truth) AND bool_or(NOT truth)
UNION ALL SELECT t.cohort, t.score, count(*) FILTER (s.score >= t.score AND NOT s.truth) / count(*) FILTER (NOT s.truth), count(*) FILTER (s.score >= t.score AND s.truth) / count(*) FILTER (s.truth)
FROM (SELECT DISTINCT cohort, score FROM scored) t JOIN scored s ON s.cohort = t.cohort GROUP BY t.cohort, t.score HAVING bool_or(s.truth) AND bool_or(NOT s.truth)) q"""))
def w4(spark, sf):
    curve = E.roc(views.scored(spark, sf), "truth", "score", ["cohort"])
    return curve.select("cohort", "threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("w4_roc_nulls", O.query("""
SELECT cohort, NULL::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr FROM roc_known GROUP BY cohort HAVING bool_or(truth) AND bool_or(NOT truth)
UNION ALL SELECT cohort, score, round(cn / an, 9), round(cp / ap, 9) FROM (
  SELECT cohort, score, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(n) OVER g AS an, sum(p) OVER g AS ap FROM roc_merged
  WINDOW w AS (PARTITION BY cohort ORDER BY score DESC), g AS (PARTITION BY cohort)) q WHERE an > 0 AND ap > 0""",
    roc_known="""
SELECT * FROM (SELECT nullif(cohort, 'de') AS cohort, CASE WHEN doc_id % 5 <> 0 THEN score END AS score, truth FROM scored) r WHERE score IS NOT NULL""",
    roc_merged="SELECT cohort, score, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n FROM roc_known GROUP BY ALL"))
def w4n(spark, sf):
    """A null cohort is a cohort; rows without a score don't count."""
    rows = views.scored(spark, sf).select(
        F.when(F.col("cohort") != "de", F.col("cohort")).alias("cohort"), "truth",
        F.when(F.col("doc_id") % 5 != 0, F.col("score")).alias("score"),
    )
    curve = E.roc(rows, "truth", "score", ["cohort"])
    return curve.select("cohort", "threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("w4_roc_lineitem", O.query("""
WITH s AS (SELECT l_extendedprice AS score, l_returnflag = 'R' AS truth FROM lineitem), m AS (SELECT score, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n FROM s GROUP BY score)
SELECT NULL::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL SELECT score, round(sum(n) OVER (ORDER BY score DESC) / sum(n) OVER (), 9), round(sum(p) OVER (ORDER BY score DESC) / sum(p) OVER (), 9) FROM m"""))
def w4b(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").alias("truth")
    )
    return E.roc(rows, "truth", "score").select(
        "threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr")
    )


# ---------------------------------------------------------------- datasets
O.define("split_rows", """
SELECT doc_id, grp, content, attack, mask_nonempty, coalesce(split, CASE WHEN h < 7 THEN 'train' WHEN h < 9 THEN 'val' ELSE 'test' END) AS split
FROM (SELECT *, CAST('0x' || substr(sha256(grp), 1, 8) AS BIGINT) % 10 AS h FROM manifest) m""")


def split_rows(spark, sf):
    return datasets.assign_split(views.manifest(spark, sf))


@query("d1_hash_split", O.query("SELECT doc_id, grp, split FROM split_rows"))
def d1(spark, sf):
    return split_rows(spark, sf).select("doc_id", "grp", "split")


@query("d2_label_checks", O.query("""
SELECT doc_id, array_to_string(list_filter([CASE WHEN mask IS NULL AND NOT (attack = 'clean' AND doc_id % 2 = 0) THEN 'unknown_is_not_clean' END,
  CASE WHEN mask IS NOT NULL AND (attack = 'clean') = mask THEN 'label_disagrees_with_mask' END,
  CASE WHEN mask IS NOT NULL AND doc_id % 13 = 0 THEN 'mask_size_differs' END], lambda p: p IS NOT NULL), ',') AS problems
FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN NOT mask_nonempty ELSE mask_nonempty END AS mask FROM split_rows) q"""))
def d2(spark, sf):
    d = F.col("doc_id")
    noisy = split_rows(spark, sf).withColumn(
        "mask_nonempty", F.when(d % 7 != 0, F.when(d % 11 == 0, ~F.col("mask_nonempty")).otherwise(F.col("mask_nonempty")))
    ).withColumn("verified_clean", d % 2 == 0).withColumns({
        "width": 100 + d % 3, "mask_width": 100 + d % 3, "height": F.lit(80), "mask_height": F.when(d % 13 == 0, 79).otherwise(80),
    })
    return datasets.check_labels(noisy).select("doc_id", F.array_join("problems", ",").alias("problems"))


@query("d3_manifest", O.query("""
SELECT lpad(CAST(m.doc_id AS VARCHAR), 7, '0') || '.png' AS image, lpad(CAST(m.doc_id AS VARCHAR), 7, '0') || '_mask.png' AS mask, m.grp, s.split, m.attack,
  CASE WHEN m.doc_id % 3 = 0 THEN 'user-authorized-public-dataset' ELSE 'own' END AS source, sha256(m.content) AS source_sha256 FROM manifest m JOIN split_rows s ON s.doc_id = m.doc_id"""))
def d3(spark, sf):
    rows = views.manifest(spark, sf).withColumn("row_index", F.col("doc_id")).withColumn(
        "source", F.when(F.col("doc_id") % 3 != 0, "own")
    )
    return datasets.build_manifest(rows)


@query("d4_domain_guard", O.query("""
SELECT count(*) FILTER (grp IS DISTINCT FROM 'src0') AS foreign_rows, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'val') AS val_rows, count(*) FILTER (split = 'test') AS test_rows,
  count(*) FILTER (grp IS DISTINCT FROM 'src0') = 0 AND count(*) FILTER (split = 'train') > 0 AND count(*) FILTER (split = 'val') > 0 AND count(*) FILTER (split = 'test') > 0 AS usable FROM split_rows"""))
def d4(spark, sf):
    return datasets.require_domain(split_rows(spark, sf).withColumn("source", F.col("grp")), "src0")


@query("u1_group_leakage", O.query("SELECT grp, min(split) AS first_split, max(split) AS last_split FROM split_rows GROUP BY grp HAVING count(DISTINCT split) > 1"))
def u1(spark, sf):
    return datasets.group_leakage(split_rows(spark, sf))


@query("u2_content_leakage", O.query("SELECT sha256(content) AS digest, min(split) AS first_split, max(split) AS last_split FROM split_rows GROUP BY 1 HAVING count(DISTINCT split) > 1"))
def u2(spark, sf):
    return datasets.content_leakage(split_rows(spark, sf))


@query("g27_split_summary", O.query("SELECT split, count(*) AS n_rows, count(DISTINCT grp) AS n_groups FROM split_rows GROUP BY split"))
def g27(spark, sf):
    return datasets.summary(split_rows(spark, sf))


@query("j10_leaked_groups", O.query("SELECT DISTINCT s.cohort AS grp FROM scored s WHERE s.cohort IN (SELECT lang FROM documents WHERE n_chars > 2000)"))
def j10(spark, sf):
    evaluation = views.scored(spark, sf).select(F.col("cohort").alias("grp"))
    training = views.table(spark, sf, "documents").filter(F.col("n_chars") > 2000).select(F.col("lang").alias("grp"))
    return datasets.leaked_groups(evaluation, training)


@query("j11_eval_samples", O.query("SELECT 'original_test_replay' AS cohort, grp, attack, doc_id FROM split_rows WHERE split = 'test' UNION ALL SELECT 'fresh_groups', grp, attack, doc_id FROM scored"))
def j11(spark, sf):
    return datasets.eval_samples(split_rows(spark, sf), views.scored(spark, sf).drop("cohort"))
