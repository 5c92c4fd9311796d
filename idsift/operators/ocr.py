"""Text-reading results: word tables to lines, reading-source choice, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from idsift.functions import mrz as M
from idsift.operators import mrz, viz

LINE_KEYS = ["page", "block", "par", "line"]


def lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words joined per printed line, with the mean of their known confidences.

    A printed line is a bounded group: it is one row of text on one page.
    """
    known = F.when(F.col("conf") >= 0, F.col("conf") / 100)
    ordered = F.array_sort(F.collect_list(F.struct("word_no", "text")))
    return words.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"),
        F.avg(known).alias("confidence"),
    )


def confidences(ocr_lines: DataFrame) -> DataFrame:
    """Smallest confidence per reading pass and over filler-bearing full lines."""
    conf = F.col("confidence")
    return ocr_lines.groupBy("doc_id").agg(
        F.min(F.when(F.col("pass") == "rows", conf)).alias("rows_confidence"),
        F.min(F.when(F.col("pass") == "crop", conf)).alias("crop_confidence"),
        F.min(F.when((F.col("pass") == "full") & F.contains("text", F.lit("<")), conf)).alias(
            "filler_confidence"
        ),
    )


WIDTHS = (44, 36, 30)


def _row_pass(ocr_lines: DataFrame) -> DataFrame:
    """Per document, from the zone-wide lines of the row pass only: the zone among
    them, and the last lines of each width. These lines are few."""
    width = F.length(M.clean(F.col("text")))
    sized = ocr_lines.filter((F.col("pass") == "rows") & width.isin(*WIDTHS)).select(
        "doc_id", "line_no", "text", width.alias("_w")
    )
    both = F.struct("text", M.clean(F.col("text")).alias("c"))
    latest = Window.partitionBy("doc_id", "_w").orderBy(F.desc("line_no"))
    at = lambda w, rn: F.max(F.when((F.col("_w") == w) & (F.col("_rn") == rn), both))
    body = (
        sized.withColumn("_rn", F.row_number().over(latest)).filter(F.col("_rn") <= 2).groupBy("doc_id")
        .agg(
            *[at(w, 1).alias(f"_last_{w}") for w in WIDTHS], at(30, 2).alias("_before_last_30")
        )
    )
    zones = mrz.candidates(sized, ["doc_id"]).groupBy("doc_id").agg(F.min_by("zone", "line_no").alias("_z_rows_by_length"))
    return body.join(zones, "doc_id", "left")


def read(ocr_lines: DataFrame) -> DataFrame:
    """Everything the lines say about a document, one row each.

    One window pass gives each line its followers, one aggregate with map-side
    combine makes the row; columns nobody asks for are pruned from both.
    """
    conf, which = F.col("confidence"), F.col("pass")
    full = which == "full"
    up = F.upper("text")
    # "NATIONAL ID" may be split over two consecutive lines.
    split_id = up.rlike(r"(?U)\bNATIONAL\s*$") & F.upper("n1").rlike(r"(?U)^\s*ID\b")
    hits = []
    for kind, pattern in viz.KEYWORDS:
        hit = up.rlike("(?U)" + pattern)
        if kind == "id":
            hit = hit | F.coalesce(split_id, F.lit(False))
        hits.append(hit.alias(kind))
    # Most lines hold no keyword, label or zone; each costs them one test.
    led = mrz.with_next_lines(ocr_lines, ["doc_id", "pass"]).select(
        "doc_id", "pass", "line_no", "confidence", F.contains("text", F.lit("<")).alias("_filler"),
        F.when(up.rlike(viz.ANY_KEYWORD), F.struct(*hits)).alias("_kinds"),
        mrz.zone_at(F.col("text"), F.col("n1"), F.col("n2")).alias("zone"),
        F.when(
            # The first line of a zone's width is the header, and is tested afterwards.
            full & F.substring("text", 1, 1).isin(*mrz.DOCUMENT_LETTERS),
            F.struct("text", M.clean(F.col("text")).alias("c")),
        ).alias("_head"),
        F.when(full, viz.groups_of(F.col("text"))).alias("_g"),
    ).withColumn("field", viz.label_from(F.col("_g"))).withColumn("value", viz.tidy(viz.value_from(F.col("_g"))))
    flags = [F.coalesce(F.max(f"_kinds.{kind}"), F.lit(False)).alias(f"_is_{kind}") for kind, _ in viz.KEYWORDS]
    # One comparable struct per candidate: its order first, then what it carries.
    ranked = led.select(
        "*",
        F.when(F.col("field").isNotNull(), F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("line_no")).alias("n"), "value")).alias("_printed"),
        F.when(F.col("zone").isNotNull(), F.struct("line_no", "zone")).alias("_zone"),
        F.when(F.col("_head").isNotNull(), F.struct("line_no", "_head", F.length("_head.c").alias("w"))).alias("_headed"),
    )
    facts = ranked.groupBy("doc_id").agg(
        F.min(F.when(which == "rows", conf)).alias("_rows_conf"),
        F.min(F.when(which == "crop", conf)).alias("_crop_conf"),
        F.min(F.when(full & F.col("_filler"), conf)).alias("_filler_conf"),
        *flags,
        *[F.min(F.when(which == p, F.col("_zone")))["zone"].alias(f"_z_{p}") for p in ("rows", "full", "crop")],
        *[F.min(F.when(F.col("_headed.w") == w, F.col("_headed")))["_head"].alias(f"_head_{w}") for w in WIDTHS],
        *[F.max(F.when(F.col("field") == name, F.col("_printed")))["value"].alias(f"v_{name}") for name in viz.FIELDS],
    )
    # A document without any readable line has a row too, of nothing.
    every = ocr_lines.select("doc_id").distinct()
    return every.join(facts, "doc_id", "left").join(_row_pass(ocr_lines), "doc_id", "left")


def choose(read_rows: DataFrame) -> DataFrame:
    """The zone of the most trusted source that yields one: ``source, r1, r2, r3``."""
    def found(column: str) -> tuple[Column, Column]:
        return F.col(column).isNotNull(), F.col(column)

    chosen = [("rows", *found("_z_rows")), ("rows_by_length", *found("_z_rows_by_length"))]
    for w, name in zip(WIDTHS, ("combined_td3", "combined_td2", "combined_td1"), strict=True):
        # The first header of the full pass with the last body lines of the row pass.
        parts = [f"_head_{w}", "_before_last_30", "_last_30"] if w == 30 else [f"_head_{w}", f"_last_{w}"]
        layout = next(lay for lay in mrz.LAYOUTS.values() if lay.width == w)
        joined = F.concat_ws("\n", *[F.col(f"{p}.c") for p in parts])
        texts = [F.col(f"{p}.text") for p in parts] + [F.lit(None).cast("string")]
        zone = F.struct(F.lit(0).alias("rank"), *[t.alias(f"r{i + 1}") for i, t in enumerate(texts[:3])])
        chosen.append((name, joined.rlike(mrz.zone_pattern(layout)), zone))
    chosen += [("full", *found("_z_full")), ("crop", *found("_z_crop"))]
    best = None
    for name, test, zone in chosen:
        value = F.struct(F.lit(name).alias("source"), zone.alias("zone"))
        best = F.when(test, value) if best is None else best.when(test, value)
    used = ("_z_", "_head_", "_last_", "_before_last")
    rest = [c for c in read_rows.columns if not c.startswith(used)]
    return read_rows.select("*", best.alias("_best")).select(
        *rest, "_best.source", "_best.zone.r1", "_best.zone.r2", "_best.zone.r3"
    )


def find_any(ocr_lines: DataFrame) -> DataFrame:
    """One zone per document that has any."""
    found = choose(read(ocr_lines)).select("doc_id", "source", "r1", "r2", "r3")
    return found.filter(F.col("source").isNotNull())


def resolve(ocr_lines: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """One row per document: zone, printed fields, type, confidence, outcome.

    Two shuffles of the lines (followers, document); the row-pass branch only
    moves zone-wide lines.
    """
    parsed = mrz.parse(choose(read(ocr_lines))).drop("c1", "c2", "c3", "reason")
    if hints is not None:
        parsed = parsed.join(hints.select("doc_id", "hint"), "doc_id", "left")
    else:
        parsed = parsed.withColumn("hint", F.lit("unknown"))
    return outcome(parsed)


def outcome(df: DataFrame) -> DataFrame:
    """Type with fallback, zone confidence, findings and status."""
    has_zone = F.col("fmt").isNotNull()
    has_viz = F.coalesce(*[F.col(f"v_{n}") for n in viz.FIELDS]).isNotNull()
    kind = F.when(F.col("hint") != "unknown", F.col("hint"))
    for name, _ in viz.KEYWORDS:
        kind = kind.when(F.coalesce(f"_is_{name}", F.lit(False)), name)
    kind = (
        kind.when(F.col("fmt") == "TD3", "passport").when(has_zone, "id").otherwise("unknown")
    )
    own = F.when(F.col("source").startswith("rows") | F.col("source").startswith("combined"), F.col("_rows_conf")).when(
        F.col("source") == "crop", F.col("_crop_conf")
    )
    codes = F.array_compact(
        F.array(
            F.when(~has_zone, "MRZ_NOT_EXTRACTED"),
            F.when(has_zone & (F.size("corrections") > 0), "OCR_CORRECTIONS"),
            F.when(~has_viz, "VIZ_NOT_EXTRACTED"),
        )
    )
    internal = [c for c in df.columns if c.startswith("_")]
    return (
        df.withColumn("document_type", kind)
        .withColumn("mrz_confidence", F.when(has_zone, F.coalesce(own, F.col("_filler_conf"))))
        .withColumn("ocr_codes", codes)
        .withColumn(
            "ocr_status", F.when(has_zone | has_viz, "ok").otherwise("insufficient_evidence")
        )
        .drop(*internal)
    )
