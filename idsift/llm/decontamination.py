"""Benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of every sliding window of w = m - k + 1
k-grams. A shared span of m words has one whole window in it, so the two sides keep
a common hash: no span is missed. Documents meet the benchmark on these fingerprints.
A hit is then extended to every window of m words around it, and these meet the
benchmark's windows word by word, which removes false hits.

Windows of an item are SPAN consecutive words; a shorter item is one window of its
own length, which gets a fingerprint length of its own.

Only DataFrame functions; the fingerprint join sees distinct hashes of a document
against distinct hashes of the benchmark, and the window join distinct windows, so
frequent phrases multiply nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsift.llm import common

SPAN = 13
GRAM = 5
#: Share of hit words from which a document counts as contaminated: 1 in 20.
RARE = 20
#: A word of lower-cased text, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` spelt as what it holds, which
#: Java's matcher tests several times faster; and one of text with capitals.
TOKEN = "[0-9a-z\u0080-\U0010ffff]+"
ANY_TOKEN = "[0-9A-Za-z\u0080-\U0010ffff]+"
OWN = {"n_words", "n_hit", "n_items", "items_sha256", "contaminated"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body or its loops use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lowered(text: Column) -> Column:
    """As common.lower_ascii, which is slow, with Spark's own function for texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(common.lower_ascii(text))


def tokens(text: Column) -> Column:
    """Lower-cased words; null has none."""
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(ANY_TOKEN)), F.lit(0)).cast("bigint")


def upto(n: Column) -> Column:
    """1..n, empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def gram_hashes(words: Column, k: int) -> Column:
    return F.transform(upto(F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))


def winnow(words: Column, m: int) -> Column:
    """Distinct kept hashes: every span of m words has at least one of them."""
    k = min(GRAM, m)
    w = m - k + 1
    if w == 1:
        return F.array_distinct(gram_hashes(words, k))
    return let(
        gram_hashes(words, k),
        lambda h: F.array_distinct(F.transform(upto(F.size(h) - (w - 1)), lambda i: F.array_min(F.slice(h, i, w)))),
    )


def window_at(words: Column, start: Column, m: Column | int) -> Column:
    return F.array_join(F.slice(words, start, m), " ")


def item_windows(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """item_id, m, words, window: every window of every item that has words."""
    words = benchmark.select("item_id", tokens(F.col("text")).alias("words")).filter(F.size("words") > 0)
    sized = words.withColumn("m", F.least(F.lit(span), F.size("words")))
    at = sized.select("item_id", "m", "words", F.explode(upto(F.size("words") - F.col("m") + 1)).alias("start"))
    return at.select("item_id", "m", window_at(F.col("words"), F.col("start"), F.col("m")).alias("window")).distinct()


def _tagged(hashes: Column, m: int) -> Column:
    return F.transform(hashes, lambda h: F.struct(F.lit(m).alias("m"), h.alias("h")))


def _windows_around(words: Column, met: Column, m: int) -> Column:
    """Windows of m words that hold a k-gram whose hash is among those met."""
    k = min(GRAM, m)
    hashes = F.transform(F.filter(met, lambda x: x["m"] == m), lambda x: x["h"])

    def spread(i: Column) -> Column:
        return F.filter(F.sequence(i - (m - k), i), lambda s: (s >= 1) & (s + (m - 1) <= F.size(words)))

    def around(pair: Column) -> Column:
        h, found = pair["h"], pair["found"]
        at = F.filter(upto(F.size(h)), lambda i: F.array_contains(found, F.element_at(h, i)))
        return F.transform(
            F.array_distinct(F.flatten(F.transform(at, spread))),
            lambda s: F.struct(F.lit(m).alias("m"), s.alias("start"), window_at(words, s, m).alias("window")),
        )

    found = let(F.struct(gram_hashes(words, k).alias("h"), hashes.alias("found")), around)
    none = F.array().cast("array<struct<m:int,start:int,window:string>>")
    return F.when(F.size(hashes) > 0, found).otherwise(none)


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """All rows and columns of docs (doc_id, text, ...), and with them n_words, n_hit
    (words inside any occurrence of a benchmark window), n_items (items with occurring
    windows), items_sha256 and contaminated.

    A null or empty text has no words and isn't hit. An item without words has no
    window. Repeated rows, and items, are judged alike; an empty benchmark hits
    nothing. Input columns with the names above are replaced.
    """
    windows = item_windows(benchmark, span)
    lengths = sorted(r["m"] for r in windows.select("m").distinct().collect())  # at most span numbers
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    if not lengths:
        lengths = [span]

    def prints(words: Column) -> Column:
        return F.concat(*[_tagged(winnow(words, m), m) for m in lengths])

    asked = keyed.select(
        "doc_id", "_key", F.explode(let(tokens(F.col("text")), prints)).alias("p")
    ).select("doc_id", "_key", "p.m", "p.h")
    split_window = F.split("window", " ")
    kept = windows.select("m", "window").distinct()
    listed = None
    for m in lengths:
        part = kept.filter(F.col("m") == m).select("m", F.explode(winnow(split_window, m)).alias("h")).distinct()
        listed = part if listed is None else listed.unionByName(part)
    met = (
        asked.join(listed, ["m", "h"], "left_semi")
        .groupBy("doc_id", "_key").agg(F.collect_set(F.struct("m", "h")).alias("met"))
    )

    def tries(words: Column) -> Column:
        return F.concat(*[_windows_around(words, F.col("met"), m) for m in lengths])

    hit_texts = keyed.select("doc_id", "_key", "text").join(
        met.withColumnRenamed("doc_id", "_met_id").withColumnRenamed("_key", "_met_key"),
        F.expr("doc_id <=> _met_id and _key = _met_key"),
    )
    tried = hit_texts.select(
        "doc_id", "_key", F.explode(let(tokens(F.col("text")), tries)).alias("t")
    ).select("doc_id", "_key", "t.m", "t.start", "t.window").distinct()
    found = tried.join(kept, ["m", "window"], "left_semi")
    covered = found.groupBy("doc_id", "_key").agg(
        F.size(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.collect_list(F.struct("start", "m")),
                        lambda x: F.sequence(x["start"], x["start"] + x["m"] - 1),
                    )
                )
            )
        ).cast("bigint").alias("n_hit")
    )
    items = (
        found.select("doc_id", "_key", "m", "window").distinct().join(windows, ["m", "window"])
        .groupBy("doc_id", "_key")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    results = covered.alias("c").join(
        items.alias("i"), F.expr("c.doc_id <=> i.doc_id and c._key = i._key")
    ).select(F.col("c.doc_id").alias("_hit_id"), F.col("c._key").alias("_hit_key"), F.col("n_hit").alias("_hit_n"), F.col("items").alias("_hit_items"))
    counted = keyed.select(*common.without(docs, OWN), "_key", count_tokens(F.col("text")).alias("n_words"))
    joined = counted.join(results, F.expr("doc_id <=> _hit_id and _key = _hit_key"), "left")
    no_items = F.array().cast("array<string>")
    n_hit = F.coalesce("_hit_n", F.lit(0).cast("bigint"))
    return joined.select(
        *common.without(docs, OWN),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(F.coalesce("_hit_items", no_items)).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("_hit_items", no_items), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * RARE >= F.col("n_words"))).alias("contaminated"),
    )


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, common.table(spark, sf_dir, "benchmark")).drop("text")


SQL_DECONTAMINATE = r"""
with doc as (
  select doc_id, coalesce(text, '') as text, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from {docs}),
item as (
  select item_id, w, least(13, len(w)) as m from (
    select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark) where len(w) > 0),
windows as (
  select distinct item_id, m, array_to_string(w[s:s + m - 1], ' ') as win
  from (select item_id, w, m, unnest(range(1, len(w) - m + 2)) as s from item)),
lengths as (select distinct m from windows),
spans as (
  select r, m, s, array_to_string(w[s:s + m - 1], ' ') as win
  from (select r, w, m, unnest(range(1, greatest(1, len(w) - m + 2))) as s from doc, lengths)),
found as (select distinct r, m, s, win from spans where (m, win) in (select m, win from windows)),
covered as (select r, count(distinct p) as n_hit
  from (select r, unnest(range(s, s + m)) as p from found) group by r),
items as (select r, count(distinct item_id) as n_items,
    array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as ids
  from found join windows using (m, win) group by r),
judged as (
  select d.*, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(ids, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
  from doc d left join covered using (r) left join items using (r))
"""

QUERIES = {"op8_decontaminate": op8_decontaminate}
SQL = {
    "op8_decontaminate": SQL_DECONTAMINATE.format(docs="documents")
    + "select doc_id, n_words, n_hit, n_items, items_sha256, contaminated from judged"
}
