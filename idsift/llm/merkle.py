"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

A section ends at a blank line, a paragraph at a line break, a sentence at its
closing marks or after PIECE characters. A sentence's hash is its own, a paragraph's
covers its sentences' hashes, a section's its paragraphs', and the root all of them
and the text's length. Equal roots mean equal texts. Where roots differ, only the
branches that differ need a look: `edits` names the paragraphs.

Only DataFrame functions. The next document in the order of ids is found over ids
alone, in ranges of ids; texts then move once by id, and the part of a text that
its neighbour needs moves to that neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idsift.llm import common
from idsift.llm.decontamination import let

PIECE = 240
SENTENCE = rf"[^.!?]{{1,{PIECE}}}+[.!?]{{0,16}}+|[.!?]{{1,16}}+"
BLANK_LINE = r"\n[\x20\x09\x0D]*\n"
#: Ids in a range, about, and the most ranges.
RANGE_ROWS = 20_000
MOST_RANGES = 1_024


def tree(text: Column) -> Column:
    """struct(root, sections: array of (hash, paragraphs: array of (hash, sentences)))."""

    def paragraph(p: Column) -> Column:
        sentences = F.transform(F.regexp_extract_all(p, F.lit(SENTENCE), F.lit(0)), lambda s: F.xxhash64(s))
        return let(sentences, lambda s: F.struct(F.xxhash64(F.lit(1), s).alias("hash"), s.alias("sentences")))

    def section(s: Column) -> Column:
        paragraphs = F.transform(F.split(s, r"\n", -1), paragraph)
        return let(
            paragraphs,
            lambda p: F.struct(F.xxhash64(F.lit(2), F.transform(p, lambda x: x["hash"])).alias("hash"), p.alias("paragraphs")),
        )

    def whole(sections: Column) -> Column:
        hashes = F.array_join(F.transform(sections, lambda s: F.lower(F.hex(s["hash"]))), ".")
        # The digest makes equal roots mean equal texts even if short hashes collide.
        root = F.sha2(F.concat(hashes, F.lit(":"), F.sha2(text, 256)), 256)
        return F.struct(root.alias("root"), sections.alias("sections"))

    return let(F.transform(F.split(text, BLANK_LINE, -1), section), whole)


def leaves(t: Column) -> Column:
    """Distinct sentence hashes."""
    return F.array_distinct(
        F.flatten(F.transform(t["sections"], lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["sentences"]))))
    )


def written(t: Column) -> Column:
    """root|section(paragraph(sentence.sentence)...)...: the tree as text, hashes in hex."""

    def brief(h: Column) -> Column:
        return F.lower(F.hex(h))

    def paragraph(p: Column) -> Column:
        return F.concat(
            brief(p["hash"]), F.lit("("), F.array_join(F.transform(p["sentences"], brief), "."), F.lit(")")
        )

    def section(s: Column) -> Column:
        return F.concat(
            brief(s["hash"]), F.lit("("), F.array_join(F.transform(s["paragraphs"], paragraph), ""), F.lit(")")
        )

    return F.concat(t["root"], F.lit("|"), F.array_join(F.transform(t["sections"], section), ""))


def likeness(root: Column, own: Column, other_root: Column, other: Column) -> Column:
    """1 for equal roots, else twice the shared leaves over all leaves of both."""
    n = F.size(own) + F.size(other)
    shared = F.size(F.array_intersect(own, other))
    return F.when(root == other_root, 1.0).when(n == 0, 0.0).otherwise(2.0 * shared / n)


def edits(docs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """docs with `changed`: the paragraphs of the new text, as (section, paragraph)
    numbers from 0, whose hashes the old text doesn't have. Null texts are empty;
    equal roots end the search at the top."""
    ends = docs.withColumn("_old", tree(F.coalesce(old, F.lit("")))).withColumn("_new", tree(F.coalesce(new, F.lit(""))))

    def branches(pair: Column) -> Column:
        was, now = pair["was"], pair["now"]
        known_sections = F.transform(was["sections"], lambda s: s["hash"])
        known = F.flatten(F.transform(was["sections"], lambda s: F.transform(s["paragraphs"], lambda p: p["hash"])))
        numbered = F.flatten(
            F.transform(
                now["sections"],
                lambda s, i: F.when(F.array_contains(known_sections, s["hash"]), _no_branches()).otherwise(
                    F.filter(
                        F.transform(
                            s["paragraphs"],
                            lambda p, j: F.when(
                                ~F.array_contains(known, p["hash"]),
                                F.struct(i.alias("section"), j.alias("paragraph")),
                            ),
                        ),
                        lambda b: b.isNotNull(),
                    )
                ),
            )
        )
        return F.when(was["root"] == now["root"], _no_branches()).otherwise(numbered)

    pair = F.struct(F.col("_old").alias("was"), F.col("_new").alias("now"))
    return ends.withColumn("changed", let(pair, branches)).drop("_old", "_new")


def _no_branches() -> Column:
    return F.array().cast("array<struct<section:int,paragraph:int>>")


def neighbours(ids: DataFrame, bounds: list) -> DataFrame:
    """(doc_id, _key, n) distinct -> with next_id and next_key: the next row by
    descending doc_id (null last), then _key; after the last, the first.

    Windows run in ranges of ids; the first row of each range, one per range, links them."""
    limits = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    ranged = ids.withColumn(
        "_range",
        F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(
            F.size(F.filter(limits, lambda b: F.col("doc_id") <= b))
        ),
    )
    order = [F.col("doc_id").desc_nulls_last(), F.col("_key")]
    inside = Window.partitionBy("_range").orderBy(*order)
    linked = (
        ranged.withColumn("_next", F.lead(F.struct("doc_id", "_key")).over(inside))
        .withColumn("_first", F.row_number().over(inside) == 1)
    )
    heads = linked.filter("_first").select("_range", F.struct("doc_id", "_key").alias("_head"))
    ring = Window.orderBy("_range")
    heads = heads.select(
        "_range",
        F.coalesce(F.lead("_head").over(ring), F.first("_head").over(ring)).alias("_head"),
    )
    chained = linked.join(heads, "_range", "left").withColumn("_next", F.coalesce("_next", "_head"))
    return chained.select(
        "doc_id", "_key", "n", F.col("_next.doc_id").alias("next_id"), F.col("_next._key").alias("next_key")
    )


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, a row per row.

    The edited text has its last third replaced by the start of the next document by
    descending doc_id (null last; after the last: the first). A null text is empty.
    Rows of one doc_id are ordered by their texts' hashes, and rows that are wholly
    equal are one document in this order, with equal results. A single document is
    its own next one. Other columns of docs are dropped; an empty table gives none.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "_key", F.xxhash64("text", F.length("text"))
    )
    ids = texts.select("doc_id", "_key", F.length("text").alias("n"))
    rows = ids.count()
    wanted = min(MOST_RANGES, -(-rows // RANGE_ROWS))
    bounds: list = []
    if wanted > 1:
        steps = [i / wanted for i in range(1, wanted)]
        found = ids.agg(F.percentile_approx("doc_id", steps, 10_000).alias("b")).first()["b"]
        bounds = sorted(set(found or []))
    links = neighbours(ids.distinct(), bounds)
    # The id is null-safe as text; rows of one id and text meet in one group. Both sides
    # of the join read the same three columns, so that texts are shuffled once.
    as_text = lambda c: F.coalesce(F.concat(F.lit("#"), F.col(c).cast("string")), F.lit(""))
    copies = Window.partitionBy("_id", "_key").orderBy("_id")
    placed = (
        texts.select(as_text("doc_id").alias("_id"), "_key", "text").repartition("_id", "_key")
        .withColumn("_copy", F.row_number().over(copies))
    )
    sent = (
        placed.filter("_copy = 1").select("_id", "_key", "text")
        .join(
            links.select(
                as_text("next_id").alias("_id"), F.col("next_key").alias("_key"),
                as_text("doc_id").alias("_to"), F.col("_key").alias("_to_key"), F.col("n").alias("_n"),
            ),
            ["_id", "_key"],
        )
        .select(
            "_to", "_to_key", F.expr("substring(text, 1, cast(floor(_n / 3) as int))").alias("_start"),
            let(tree(F.col("text")), lambda t: F.struct(t["root"].alias("root"), leaves(t).alias("leaves"))).alias("_next"),
        )
    )
    joined = placed.join(sent, F.expr("_id = _to and _key = _to_key")).select(
        F.when(F.col("_id") != "", F.expr("substring(_id, 2)")).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"),
        "text", "_start", "_next", F.length("text").alias("_n"),
    )
    cut = joined.withColumn(
        "_edited", F.concat(F.expr("substring(text, 1, _n - cast(floor(_n / 3) as int))"), F.col("_start"))
    )

    def results(own: Column) -> Column:
        def both(edited: Column) -> Column:
            return let(
                F.struct(leaves(own).alias("own"), leaves(edited).alias("edited")),
                lambda x: F.struct(
                    written(own).alias("fingerprint"),
                    written(edited).alias("edited_fingerprint"),
                    likeness(own["root"], x["own"], edited["root"], x["edited"]).alias("near_edited"),
                    likeness(own["root"], x["own"], F.col("_next.root"), F.col("_next.leaves")).alias("near_next"),
                ),
            )

        return let(tree(F.col("_edited")), both)

    found = cut.select(
        "doc_id", F.col("_n").cast("bigint").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        let(tree(F.col("text")), results).alias("_r"),
    )
    return found.select("doc_id", "n_chars", "edited_sha256", "_r.*")


def op6_merkle(spark, sf_dir: str) -> DataFrame:
    return fingerprint(common.table(spark, sf_dir, "documents"))


QUERIES = {"op6_merkle": op6_merkle}
SQL: dict[str, str] = {}
