"""Evaluation metrics as aggregates; an undefined ratio is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from idsift.operators import ranks
from idsift.policy import IMAGE_FRACTION_THRESHOLD, PIXEL_THRESHOLD


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole)


def _counts(truth: Column, predicted: Column) -> list[Column]:
    return [
        F.count("*").alias("n"),
        F.count_if(~truth & ~predicted).alias("tn"),
        F.count_if(~truth & predicted).alias("fp"),
        F.count_if(truth & ~predicted).alias("fn"),
        F.count_if(truth & predicted).alias("tp"),
    ]


def with_rates(df: DataFrame) -> DataFrame:
    """Ratios next to the counts ``tn, fp, fn, tp``."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return df.select(
        "*",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(fp, fp + tn).alias("false_positive_rate"),
        ratio(fn, fn + tp).alias("false_negative_rate"),
    )


def binary(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    return with_rates(df.groupBy(*(by or [])).agg(*_counts(F.col(truth), F.col(predicted))))


def by_cohort(df: DataFrame, truth: str, detectors: dict[str, str], cohort: str) -> DataFrame:
    """Metrics per cohort and detector; detectors are columns turned into rows."""
    rows = F.array(
        *[F.struct(F.lit(n).alias("detector"), F.col(c).alias("predicted")) for n, c in detectors.items()]
    )
    long = df.select(cohort, truth, F.explode(rows).alias("d")).select(cohort, truth, "d.*")
    return binary(long, truth, "predicted", [cohort, "detector"])


def per_attack(df: DataFrame, attacks: list[str]) -> DataFrame:
    """Each attack against the same clean rows.

    Rows are counted once per attack, and the one set of clean counts is added
    to every attack afterwards, so clean rows are not copied.
    """
    clean = F.col("attack") == "clean"
    out = [
        F.struct(
            F.lit(a).alias("attack"),
            F.count_if(F.col("attack") == a).alias("count"),
            F.count_if((F.col("attack") == a) & F.col("flagged")).alias("flagged"),
            F.avg(F.when((F.col("attack") == a) & ~clean, F.col("iou"))).alias("mean_iou"),
            F.count_if(clean & ~F.col("flagged")).alias("tn"),
            F.count_if(clean & F.col("flagged")).alias("fp"),
        )
        for a in attacks
    ]
    counts = df.agg(F.array(*out).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    compared = F.col("attack") != "clean"
    versus = lambda c: F.when(compared, c)
    return with_rates(
        counts.select(
            "attack", "count", "flagged", "mean_iou", versus(F.col("tn")).alias("tn"), versus(F.col("fp")).alias("fp"),
            versus(F.col("count") - F.col("flagged")).alias("fn"), versus(F.col("flagged")).alias("tp"),
        )
    )


def iou(cells: DataFrame, truth: Column, predicted: Column, by: list[str]) -> DataFrame:
    both, either = F.count_if(truth & predicted), F.count_if(truth | predicted)
    return cells.groupBy(*by).agg(ratio(both, either).alias("iou"))


def image_flag(cells: DataFrame, by: list[str], value: str) -> DataFrame:
    hot = F.avg((F.col(value) >= PIXEL_THRESHOLD).cast("double"))
    return cells.groupBy(*by).agg(hot.alias("fraction")).withColumn(
        "flagged", F.col("fraction") >= IMAGE_FRACTION_THRESHOLD
    )


def roc(df: DataFrame, truth: str, score: str, by: list[str] | None = None) -> DataFrame:
    """One point per distinct score plus the origin; nothing for a single class.

    A null group is a group. Rows without a usable score or truth give no point and
    don't count; ``unscored`` has them.
    """
    keys = list(by or [])
    base = df.filter(_scored(truth, score)).select(*keys, F.col(truth).alias("_t"), F.col(score).cast("double").alias("threshold"))
    merged = base.groupBy(*keys, "threshold").agg(
        F.count_if("_t").alias("pos"), F.count_if(~F.col("_t")).alias("neg")
    )
    curve = ranks.running_sums(merged, keys, "threshold", ["pos", "neg"]).filter("all_pos > 0 and all_neg > 0")
    points = curve.select(
        *keys, "threshold", (F.col("cum_neg") / F.col("all_neg")).alias("fpr"), (F.col("cum_pos") / F.col("all_pos")).alias("tpr")
    )
    zero = F.lit(0.0)
    totals = merged.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n")).filter("_p > 0 and _n > 0")
    origin = totals.select(*keys, F.lit(None).cast("double").alias("threshold"), zero.alias("fpr"), zero.alias("tpr"))
    return origin.unionByName(points)


def _scored(truth: str, score: str) -> Column:
    s = F.col(score).cast("double")
    return F.col(truth).isNotNull() & s.isNotNull() & ~F.isnan(s)


def unscored(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Rows that ``roc`` leaves out: no truth, no score, or a score that is no number."""
    return df.filter(~F.coalesce(_scored(truth, score), F.lit(False)))


def latency(df: DataFrame, value: str, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Summary per group, over all rows without ``by``, and the rejected rows (NULL,
    negative, not finite). A null group is a group."""
    by = list(by or [])
    v = F.col(value)
    good = v.isNotNull() & ~F.isnan(v) & (v < float("inf")) & (v >= 0)
    kept = df.filter(good)
    simple = kept.groupBy(ranks.group_of(by)).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms")
    )
    ranked = ranks.quantiles(kept, by, value, {"median_ms": 0.5, "p95_ms": 0.95})
    ranked = ranked.select(ranks.group_of(by), "median_ms", "p95_ms")
    both = simple.join(ranked, "_g").select(
        *[F.col(f"_g.{k}").alias(k) for k in by], "n", "mean_ms", "min_ms", "max_ms", "median_ms", "p95_ms"
    )
    return both, df.filter(~F.coalesce(good, F.lit(False)))


def unpivot_layers(df: DataFrame, keys: list[str], layers: list[str]) -> DataFrame:
    return df.unpivot(keys, layers, "layer", "duration_ms")


def field_matches(truth: DataFrame, observed: DataFrame) -> DataFrame:
    """Exact match per document, channel and field; a missing value is wrong."""
    keys = ["doc_id", "channel", "field"]
    return (
        truth.select(*keys, "expected")
        .join(observed.select(*keys, "observed"), keys, "left")
        .withColumn("match", F.coalesce(F.col("expected") == F.col("observed"), F.lit(False)))
    )


def field_accuracy(matches: DataFrame) -> DataFrame:
    """Per channel and field, with one overall row per channel."""
    counted = matches.groupBy("channel", "field").agg(
        F.count_if("match").alias("correct"), F.count("*").alias("total")
    )
    overall = counted.groupBy("channel").agg(
        F.lit("overall").alias("field"), F.sum("correct").alias("correct"), F.sum("total").alias("total")
    )
    return counted.unionByName(overall).withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def check_pass_rates(docs: DataFrame) -> DataFrame:
    """Pass rates of rows ``expected_valid, parsed, all_pass, any_failed``."""
    valid, parsed, passed = F.col("expected_valid"), F.col("parsed"), F.col("all_pass")
    out = docs.agg(
        F.count_if(valid).alias("valid_documents"),
        F.count_if(valid & parsed).alias("parsed_valid_documents"),
        F.count_if(valid & passed).alias("all_checks_pass"),
        F.count_if(valid & parsed & passed).alias("_passed_parsed"),
        F.count_if(~valid).alias("invalid_documents"),
        F.count_if(~valid & F.col("any_failed")).alias("invalid_flagged"),
    )
    return out.select(
        "*",
        ratio(F.col("all_checks_pass"), F.col("valid_documents")).alias("end_to_end_pass_rate"),
        ratio(F.col("_passed_parsed"), F.col("parsed_valid_documents")).alias("conditional_pass_rate"),
    ).drop("_passed_parsed")


def far_frr(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """Error rates per threshold over pairs with a similarity; the rest is counted.

    ``pairs`` has ``same_identity`` and a nullable ``cosine``. All thresholds are
    counted in one pass over the pairs.
    """
    known, same = F.col("cosine").isNotNull(), F.col("same_identity")
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.count_if(known).alias("eligible"),
                F.count_if(~known).alias("undetermined"),
                F.count_if(known & ~same & (F.col("cosine") < t)).alias("tn"),
                F.count_if(known & ~same & (F.col("cosine") >= t)).alias("fp"),
                F.count_if(known & same & (F.col("cosine") < t)).alias("fn"),
                F.count_if(known & same & (F.col("cosine") >= t)).alias("tp"),
            )
            for t in thresholds
        ]
    )
    counted = pairs.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    return counted.select(
        "*",
        ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("far"),
        ratio(F.col("fn"), F.col("fn") + F.col("tp")).alias("frr"),
    )


def errors(matches: DataFrame) -> DataFrame:
    """Mismatching fields ordered by document."""
    return matches.filter(~F.col("match")).orderBy("doc_id", "channel", "field")
