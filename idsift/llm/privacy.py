"""Personal data: entities by form, and terms that reveal them by corpus statistics.

Entities (email, ip, card, phone) are found by pattern. A term is a word of a text that
holds an entity. How strongly it reveals that entity is its pointwise mutual information
with it over the entity's information content, both from document counts of the corpus:

    disclosure(t; c) = log2(n(c,t) * N / (n(c) * n(t))) / log2(N / n(c))

1 means that the entity occurs wherever the term does. Terms at or above THRESHOLD
that occur with the entity in SUPPORT or more different texts are spans too, wherever
they stand in a text with the entity; they are removed if they disclose fully and
generalised otherwise.

Only DataFrame functions. Positions are running sums over a document's matches, not
nested lists, so a document with very many matches stays linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idsift.llm import common
from idsift.llm.decontamination import let

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: What each kind becomes in sanitised text.
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", TERM: "[TERM]"}
THRESHOLD = 0.9
SUPPORT = 2

# A match starts where its first run of characters starts, or where the last match
# ended: from a later start in the run it would need the same rest. Possessive
# repeats keep the match in constant stack, whatever the text's length.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word: letters and digits, with single marks inside it; a point only between digits.
WORD = (
    r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*+"
    r"(?:(?:['’_-]|(?<=\p{N})\.(?=\p{N}))[\p{L}\p{N}][\p{L}\p{M}\p{N}]*+)*+"
)
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_MATCH = "array<struct<gap:int,len:int,found:string>>"


def matches(text: Column, kind: str) -> Column:
    """Every match in order: characters before it since the last, its length and text."""
    hint = HINTS[kind]
    maybe = text.contains(hint) if hint else text.rlike("[0-9]")
    return F.when(maybe, pieces(text, PATTERNS[kind])).otherwise(F.array().cast(_MATCH))


def pieces(text: Column, pattern: str) -> Column:
    def zipped(both: Column) -> Column:
        def one(found: Column, i: Column) -> Column:
            before = F.element_at(both["gaps"], i + 1)
            return F.struct(F.length(before).alias("gap"), F.length(found).alias("len"), found.alias("found"))

        return F.transform(both["found"], one)

    split = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")
    )
    return let(split, zipped)


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    reverse = F.split(F.reverse(number), "")

    def weigh(total: Column, pair: Column) -> Column:
        d = pair["digit"].cast("int")
        doubled = F.when(pair["i"] % 2 == 1, d * 2).otherwise(d)
        return total + F.when(doubled > 9, doubled - 9).otherwise(doubled)

    pairs = F.transform(F.filter(reverse, lambda d: d != ""), lambda d, i: F.struct(d.alias("digit"), i.alias("i")))
    return F.aggregate(pairs, F.lit(0), weigh) % 10 == 0


def is_valid(kind: Column, found: Column) -> Column:
    number = digits(found)
    parts = F.forall(
        F.split(found, r"\."),
        lambda p: let(
            F.regexp_replace(p, "^0+", ""), lambda s: (F.length(s) < 3) | ((F.length(s) == 3) & (s <= "255"))
        ),
    )
    card = F.when(F.length(number).between(16, 19), luhn(number)).otherwise(False)
    return (
        F.when(kind == "ip", parts).when(kind == "card", card)
        .when(kind == "phone", F.length(number).between(8, 15)).otherwise(True)
    )


def entities(docs: DataFrame) -> DataFrame:
    """docs (_id, _key, text) -> _id, _key, copies, kind, rank, start, end, found: a row per
    valid entity. end is exclusive; both count code points. Rows of equal _id and _key are
    copies, whose matches are placed once."""
    once = (
        docs.select("_id", "_key", _all_matches().alias("all")).filter(F.size("all") > 0)
        .groupBy("_id", "_key").agg(F.first("all").alias("all"), F.count("*").alias("copies"))
    )
    rows = once.select("_id", "_key", "copies", F.explode("all").alias("m")).select("_id", "_key", "copies", "m.*").select(
        "_id", "_key", "copies", "rank", "i", "x.*"
    )
    upto = Window.partitionBy("_id", "_key", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("kind", kind)
    return placed.filter(is_valid(F.col("kind"), F.col("found"))).select(
        "_id", "_key", "copies", "kind", "rank", (F.col("end") - F.col("len")).alias("start"), "end", "found",
    )


def _all_matches() -> Column:
    return F.concat(*[_ranked(matches(F.col("text"), kind), rank) for rank, kind in enumerate(KINDS)])


def holding(docs: DataFrame) -> DataFrame:
    """The documents with a match, written once. Their texts alone are moved to meet what
    is known of a document; all others stay where they are read."""
    return common.stored(docs.filter(F.size(_all_matches()) > 0), "holding")


def _ranked(found: Column, rank: int) -> Column:
    return F.transform(found, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), x.alias("x")))


def entity_name(kind: Column, found: Column) -> Column:
    """Spellings of one entity have one name."""
    value = F.when(kind.isin("email", "ip"), common.lower_ascii(found)).otherwise(digits(found))
    return F.concat(kind, F.lit(":"), value)


def words_of(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def mentions(found: DataFrame) -> DataFrame:
    """Entities -> _id, _key, copies, entity: a row per document and entity in it."""
    return found.select("_id", "_key", "copies", entity_name(F.col("kind"), F.col("found")).alias("entity")).distinct()


def _where(names: list[str]) -> Column:
    """Which documents a group's rows are of, as a fingerprint of the set."""
    document = lambda seed: F.xxhash64(F.lit(seed), "_id", "_key")
    return F.sha2(
        F.concat_ws(":", *names, F.bit_xor(document(1)), F.bit_xor(document(2)), F.sum(document(3).cast("decimal(38,0)"))), 256
    )


class Revealing:
    """How strongly terms reveal entities. Counts are of rows over the whole corpus;
    SUPPORT counts different texts, so copies are one.

    An entity and a term occur together in n_entity rows at most, so a term in more than
    N ** (1 - THRESHOLD) * n_entity ** THRESHOLD rows stays below THRESHOLD. Such terms go
    before they meet the entities; no other pair is left out.

    Entities of equal count that occur in the same documents stand alike to every term,
    and so do such terms to every entity. Only these groups are paired, so a list of very
    many addresses and names that stand together is one pair.
    """

    def __init__(self, docs: DataFrame, held: DataFrame, mentioned: DataFrame):
        total = docs.count()
        self.n = F.lit(total)
        of_entity = common.stored(
            mentioned.groupBy("entity", "_key").agg(F.sum("copies").alias("n"))
            .groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("n_texts"))
            .filter((F.col("n_texts") >= SUPPORT) & (F.col("n_entity") < self.n)).drop("n_texts")
            .withColumn("most", F.lit(float(total) ** (1 - THRESHOLD)) * F.col("n_entity") ** THRESHOLD * (1 + 1e-9)),
            "of_entity",
        )
        asked = mentioned.join(of_entity, "entity")
        self.entity_groups = common.stored(asked.groupBy("entity").agg(_where([F.first("n_entity")]).alias("of")), "groups")
        self.asked = common.stored(
            asked.join(self.entity_groups, "entity").select("_id", "_key", "copies", "of", "n_entity", "most").distinct(), "asked"
        )
        most = of_entity.agg(F.coalesce(F.max("most"), F.lit(0.0))).first()[0]
        of_term = (
            docs.select(F.explode(words_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
            .filter(F.col("n_term").between(SUPPORT, most))
        )
        bounds = self.asked.groupBy("_id", "_key").agg(F.max("most").alias("bound"))
        terms = common.stored(
            held.join(bounds, ["_id", "_key"]).select("_id", "_key", "bound", F.explode(words_of(F.col("text"))).alias("term"))
            .join(of_term, "term").filter(F.col("n_term") <= F.col("bound"))
            .select("_id", "_key", "term", "n_term").distinct(),
            "terms",
        )
        self.term_groups = common.stored(terms.groupBy("term").agg(_where([F.first("n_term")]).alias("by")), "groups")
        self.terms = common.stored(terms.join(self.term_groups, "term"), "terms")
        self.pairs = common.stored(self._pairs(), "pairs")

    def _pairs(self) -> DataFrame:
        """of, by, disclosure: groups of entities and of terms at or above THRESHOLD."""
        grouped = self.terms.select("_id", "_key", "by", "n_term").distinct()
        pairs = (
            self.asked.join(grouped, ["_id", "_key"]).filter(F.col("n_term") <= F.col("most"))
            .groupBy("of", "by", "_key").agg(
                F.sum("copies").alias("n"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term")
            )
            .groupBy("of", "by").agg(
                F.sum("n").alias("n_both"), F.count("*").alias("n_texts"),
                F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"),
            )
            .filter(F.col("n_texts") >= SUPPORT)
        )
        information = F.log2(self.n / F.col("n_entity"))
        mutual = F.log2(F.col("n_both") * self.n / (F.col("n_entity") * F.greatest("n_term", "n_both")))
        return (
            pairs.withColumn("disclosure", F.when(information > 0, mutual / information))
            .filter(F.col("disclosure") >= THRESHOLD).select("of", "by", "disclosure")
        )

    def told(self) -> DataFrame:
        """_id, _key, term, d: the terms that reveal an entity of their document."""
        strongest = self.asked.join(self.pairs, "of").groupBy("_id", "_key", "by").agg(F.max("disclosure").alias("d"))
        return self.terms.join(strongest, ["_id", "_key", "by"]).select("_id", "_key", "term", "d")

    def disclosures(self) -> DataFrame:
        """entity, term, disclosure: all pairs at or above THRESHOLD."""
        return self.entity_groups.join(self.pairs, "of").join(self.term_groups, "by").select("entity", "term", "disclosure")


def occurrences(docs: DataFrame, told: DataFrame) -> DataFrame:
    """docs (_id, _key, text), told (_id, _key, term, d) -> _id, _key, start, end, d: every
    place in a document of a term told of it."""
    texts = docs.join(told.select("_id", "_key").distinct(), ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
    rows = texts.select("_id", "_key", F.posexplode(pieces(F.col("text"), WORD)).alias("i", "x")).select(
        "_id", "_key", "i", "x.*"
    )
    upto = Window.partitionBy("_id", "_key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).select(
        "_id", "_key", F.lower("found").alias("term"), (F.col("end") - F.col("len")).alias("start"), "end"
    )
    return placed.join(told, ["_id", "_key", "term"]).drop("term")


def spans(docs: DataFrame) -> DataFrame:
    """docs (_id, _key, text) -> _id, _key, kind, rank, start, end, action: every entity,
    and every occurrence of a disclosing term in a text with the entity that it discloses.
    A term that overlaps an entity's span is part of that span."""
    held = holding(docs)
    found = common.stored(entities(held), "entities")
    mentioned = common.stored(mentions(found), "mentions")
    base = found.select("_id", "_key", "kind", "rank", "start", "end", F.lit("generalise").alias("action"))
    told = common.stored(Revealing(docs, held, mentioned).told(), "told")
    terms = occurrences(held, told).select(
        "_id", "_key", F.lit(TERM).alias("kind"), F.lit(len(KINDS)).alias("rank"), "start", "end",
        F.when(F.col("d") >= 1, "remove").otherwise("generalise").alias("action"),
    )
    is_term = F.col("kind") == TERM
    order = Window.partitionBy("_id", "_key").orderBy("start", "rank", "end")
    reached = F.max(F.when(~is_term, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(~is_term, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    inside = F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False))
    both = base.join(told.select("_id", "_key").distinct(), ["_id", "_key"], "left_semi").unionByName(terms)
    free = both.withColumn("inside", inside).filter(is_term & ~F.col("inside")).drop("inside")
    return base.unionByName(free)


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with a non-null identity; rows of equal id and text have equal results."""
    return docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("#"), F.col("doc_id").cast("string")), F.lit("")).alias("_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"), F.coalesce("text", F.lit("")).alias("text"),
    )


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans
    (kind:start:end by kind, then start, comma-joined), n_term, a row per row.

    A null or empty text has none. Repeated rows are judged alike; each counts in the
    statistics, but they are one text. Other columns are dropped."""
    rows = keyed(docs)
    found = spans(rows.select("_id", "_key", "text"))
    named = F.concat_ws(":", "kind", "start", "end")
    listed = found.distinct().groupBy("_id", "_key").agg(
        F.sort_array(F.collect_list(F.struct("rank", "start", "end", named.alias("name")))).alias("all")
    )
    base = F.transform(F.filter(F.col("all"), lambda x: x["rank"] < len(KINDS)), lambda x: x["name"])
    totals = listed.select(
        "_id", "_key",
        "all", F.array_join(base, ",").alias("base"),
        F.array_join(F.transform("all", lambda x: x["name"]), ",").alias("spans"),
    )
    joined = rows.select("doc_id", "_id", "_key").join(totals, ["_id", "_key"], "left")
    counts = [
        F.coalesce(_count_of(F.col("all"), k), F.lit(0)).cast("bigint").alias(f"n_{kind}")
        for k, kind in enumerate((*KINDS, TERM))
    ]
    return joined.select(
        "doc_id", *counts[: len(KINDS)], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), counts[-1],
    )


def _count_of(listed: Column, rank: int) -> Column:
    return F.size(F.filter(listed, lambda x: x["rank"] == rank))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with every span in the text replaced by its kind's label, or removed. All
    rows and other columns stay; of spans that overlap, the first, then longest, counts."""
    rows = keyed(docs)
    found = spans(rows.select("_id", "_key", "text"))
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    put = F.when(F.col("action") == "remove", F.lit("")).otherwise(labels[F.col("kind")])
    before = Window.partitionBy("_id", "_key").orderBy("start", F.desc("end"), "rank")
    reached = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    clear = found.distinct().withColumn("reached", reached).filter("reached is null or start >= reached")
    listed = clear.groupBy("_id", "_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", put.alias("put")))).alias("_cuts")
    )
    cuts = F.col("_cuts")

    def piece(cut: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.element_at(cuts, F.greatest(i, F.lit(1)))["end"])
        return F.concat(F.substring(F.col("text"), begin + 1, cut["start"] - begin), cut["put"])

    rest = F.substring(F.col("text"), F.element_at(cuts, -1)["end"] + 1, F.length("text"))
    clean = F.concat(F.array_join(F.transform(cuts, piece), ""), rest)
    keys = docs.withColumn("_id", F.coalesce(F.concat(F.lit("#"), F.col("doc_id").cast("string")), F.lit("")))
    keys = keys.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keys.join(listed, ["_id", "_key"], "left")
    return joined.withColumn("text", F.when(cuts.isNull(), F.col("text")).otherwise(clean)).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )


def op10_private(spark, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))


QUERIES = {"op10_private": op10_private}
SQL: dict[str, str] = {}
