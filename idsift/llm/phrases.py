"""Phrase collocations from exact counts in counting quotient filters.

Words that occur LEAST times or more in their language get ids; the ids of a phrase
are packed into one number, and each block of the corpus counts these numbers in a
counting quotient filter. Filters are cut by leading bits into shards and the shards
of all blocks merged, so that no task holds more than about SHARD entries.

Phrases are counted length by length. A phrase can only be frequent if both of its
phrases that are a word shorter are; these are looked up in a bit map of bounded size,
whose false positives cost a counter and change no result.

Ids are given to the MOST_WORDS most frequent words at most, so that the dictionary
that goes to the tasks has a bound. Phrases with a frequent word beyond them are
counted as text, exactly, beside the filters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idsift.llm import common, quotient

LEAST = 100
LONGEST = 5
TOP = 2_000
#: Words with an id, at most.
MOST_WORDS = 1 << 18
#: Tokens that a task counts at a time.
BLOCK = 1 << 19
#: Entries of a shard, about.
SHARD = 1 << 20
#: Shards into which filters are cut at a time: 2 ** FAN_BITS.
FAN_BITS = 8
#: Bits of the map of frequent phrases: 2 ** MAP_BITS at most.
MAP_BITS = 25
#: Rows that one ranking task gets, about.
RANKED = 100_000
#: Distinct words, or phrases with a word without id, that a task counts before it passes them on.
HELD = 60_000

#: Texts that a task takes from a batch at a time.
SLICE = 200

BREAK = b"."
_CLEAN = bytes.maketrans(common.UPPER.encode() + b".,;:!?\x0b\x0c\r", common.UPPER.lower().encode() + b"\n" * 9)


def tokens(text: bytes) -> list[bytes]:
    """Words in order, with a BREAK between the pieces of a text. No word is a BREAK,
    because a full stop ends a piece."""
    return text.translate(_CLEAN).replace(b"\n", b" . ").split()


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return docs.filter("text is not null").select(lang, F.col("text").cast("binary").alias("text"))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Language and text of every row, few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield from zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase, c of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for lang, text in _each(batches):
            held.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, held.values())) >= HELD:
                yield _counts(held)
                held = {}
        yield _counts(held)

    return (
        _texts(docs).mapInArrow(count, "lang string, phrase string, c long")
        .groupBy("lang", "phrase").agg(F.sum("c").alias("c"))
    )


def _counts(held: dict[str, Counter]) -> pa.RecordBatch:
    for words in held.values():
        words.pop(BREAK, None)
    return pa.RecordBatch.from_pydict({
        "lang": pa.array([lang for lang, words in held.items() for _ in words], pa.string()),
        "phrase": pa.array([w.decode() for words in held.values() for w in words], pa.string()),
        "c": pa.array([c for words in held.values() for c in words.values()], pa.int64()),
    })


def encoded(docs: DataFrame, ids) -> DataFrame:
    """ids: blocks of texts as word ids (32 bits); 0 is a break or a word without id."""

    def block(waiting: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"ids": pa.array([np.concatenate(waiting).tobytes()], pa.binary())})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, waiting, size = ids.value, [], 0
        for lang, text in _each(batches):
            words = tokens(text)
            waiting.append(np.fromiter(map(of.get(lang, {}).get, words, repeat(0)), np.int32, len(words)))
            waiting.append(np.zeros(1, np.int32))
            size += len(words) + 1
            if size >= BLOCK:
                yield block(waiting)
                waiting, size = [], 0
        if waiting:
            yield block(waiting)

    return _texts(docs).mapInArrow(encode, "ids binary")


def counted(blocks: DataFrame, n: int, bits: int, depth: int, shorter=None) -> DataFrame:
    """shard, filter: a counting quotient filter of the n-grams of each block, in shards.
    shorter: broadcast bit map of the frequent phrases of n - 1 words."""
    width = n * bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("ids").to_pylist():
                ids = np.frombuffer(data, dtype=np.int32)
                places = len(ids) - n + 1
                if places <= 0:
                    continue
                known = np.concatenate(([0], np.cumsum(ids == 0)))
                ok = known[n:] == known[:places]
                if shorter is not None:
                    ok[ok] = _both_in(shorter.value, ids, np.nonzero(ok)[0], n, bits)
                at = np.nonzero(ok)[0]
                found = quotient.counted(*quotient.pack([ids[at + i] for i in range(n)], bits), None, width)
                yield _filters(found, width, depth)

    return blocks.mapInArrow(count, "shard long, filter binary")


def _both_in(marks: np.ndarray, ids: np.ndarray, at: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Whether the n-gram's first and last n - 1 words are both marked."""
    ok = np.ones(len(at), dtype=bool)
    for shift in (0, 1):
        here = at[ok] + shift
        h = quotient.place(*quotient.pack([ids[here + i] for i in range(n - 1)], bits), _bits_of(marks))
        ok[ok] = (marks[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1
    return ok


def _bits_of(marks: np.ndarray) -> int:
    return (len(marks) * 64).bit_length() - 1


def _filters(found: tuple, width: int, depth: int) -> pa.RecordBatch:
    parts = [(shard, quotient.dumps(part, width, depth)) for shard, part in quotient.shards(found, width, depth)]
    return pa.RecordBatch.from_pydict(
        {"shard": pa.array([p[0] for p in parts], pa.int64()), "filter": pa.array([p[1] for p in parts], pa.binary())}
    )


def merged(filters: DataFrame, n: int, bits: int, least: int, names, depth: int, need: int) -> DataFrame:
    """lang, phrase, c, place of all n-grams that occur `least` times or more.

    While a shard is too large for a task, 2 ** FAN_BITS of its filters at a time are
    merged and cut into shards of more leading bits: the number of filters stays in
    proportion to the blocks, however many shards there are in the end."""
    width = n * bits
    while depth < need:
        deeper = min(need, depth + FAN_BITS)
        most = filters.groupBy("shard").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        groups = max(1, most >> FAN_BITS)

        part = F.pmod(F.xxhash64("filter"), F.lit(groups))
        cut = filters.groupBy("shard", part.alias("part")).applyInArrow(_deepened(width, deeper), "shard long, filter binary")
        filters = common.stored(cut, "filters")
        depth = deeper

    def merge(group: pa.Table) -> pa.Table:
        left, right, counts = quotient.merged([quotient.loads(f) for f in group["filter"].to_pylist()], width)
        often = counts >= least
        left, right, counts = left[often], right[often], counts[often]
        lang, word = names.value
        columns = quotient.unpack(left, right, bits, n)
        phrases = [b" ".join(word[i] for i in row).decode() for row in zip(*columns, strict=True)]
        return pa.table({
            "lang": pa.array([lang[i] for i in columns[0]], pa.string()), "phrase": pa.array(phrases, pa.string()),
            "c": counts, "place": quotient.place(left, right, MAP_BITS),
        })

    return filters.groupBy("shard").applyInArrow(merge, "lang string, phrase string, c long, place long")


def _deepened(width: int, depth: int):
    def deepen(group: pa.Table) -> pa.Table:
        filters = [quotient.loads(f) for f in group["filter"].to_pylist()]
        return pa.Table.from_batches([_filters(quotient.merged(filters, width), width, depth)])

    return deepen


def marks_of(frequent: DataFrame) -> np.ndarray:
    """Bit map of the frequent phrases' places, of 2 ** MAP_BITS bits at most."""
    bits = min(MAP_BITS, max(6, (frequent.count() * 64).bit_length()))
    spot = F.shiftright("place", MAP_BITS - bits)
    one = F.expr(f"shiftleft(1L, cast(shiftright(place, {MAP_BITS - bits}) & 63 as int))")
    rows = frequent.groupBy(F.shiftright(spot, 6).alias("i")).agg(F.bit_or(one).alias("w")).toPandas()
    marks = np.zeros(1 << (bits - 6), dtype=np.int64)
    marks[rows["i"].to_numpy(dtype=np.int64)] = rows["w"].to_numpy(dtype=np.int64)
    return marks.view(np.uint64)


def spelt(docs: DataFrame, ids, longest: int, least: int) -> DataFrame:
    """lang, phrase, c: frequent phrases with a word that has no id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = ids.value, {}
        for lang, text in _each(batches):
            known, own, words = of.get(lang, {}), held.setdefault(lang, Counter()), tokens(text)
            for i, word in enumerate(words):
                if word == BREAK or word in known:
                    continue
                # Phrases in which this is the first word without id.
                start = i
                while start > 0 and i - start < longest - 1 and words[start - 1] in known:
                    start -= 1
                for a in range(start, i + 1):
                    for b in range(i + 1, min(len(words), a + longest) + 1):
                        if words[b - 1] == BREAK:
                            break
                        if b - a > 1:
                            own[b" ".join(words[a:b])] += 1
            if sum(map(len, held.values())) >= HELD:
                yield _counts(held)
                held = {}
        yield _counts(held)

    found = _texts(docs).mapInArrow(count, "lang string, phrase string, c long")
    return found.groupBy("lang", "phrase").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """docs (text, lang) -> (lang, phrase, c) of every phrase of 1 to `longest` words that
    occurs `least` times or more, and (lang, n) with all word occurrences of a language."""
    spark = docs.sparkSession
    words = common.stored(word_counts(docs), "words")
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"))
    often = common.stored(words.filter(F.col("c") >= least), "often")
    top = often.orderBy(F.desc("c"), "lang", "phrase").limit(MOST_WORDS).select("lang", "phrase").toArrow()
    lang, phrase = top["lang"].to_pylist(), [w.encode() for w in top["phrase"].to_pylist()]
    of: dict[str, dict[bytes, int]] = {}
    for i, (its, word) in enumerate(zip(lang, phrase, strict=True), 1):
        of.setdefault(its, {})[word] = i
    ids, names = spark.sparkContext.broadcast(of), spark.sparkContext.broadcast(([""] + lang, [b""] + phrase))
    bits = max(1, len(lang).bit_length())
    blocks = common.stored(encoded(docs, ids), "blocks")
    parts, shorter = [often.select("lang", "phrase", "c")], None
    places = often.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    for n in range(2, longest + 1):
        if not places:
            break
        # A phrase's every occurrence holds one of a shorter frequent phrase.
        need = min(quotient.halves(n * bits)[0], max(0, (places - 1) // SHARD).bit_length())
        depth = min(need, FAN_BITS)
        filters = common.stored(counted(blocks, n, bits, depth, shorter), "filters")
        found = common.stored(merged(filters, n, bits, least, names, depth, need), "phrases")
        parts.append(found.select("lang", "phrase", "c"))
        places = found.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        if n < longest and places:
            shorter = spark.sparkContext.broadcast(marks_of(found))
    if often.count() > len(lang):
        parts.append(common.stored(spelt(docs, ids, longest, least), "spelt"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """docs (text, lang) -> lang, rank, phrase, a, l, r, n, score: each language's best
    phrases of 2 to `longest` words.

    a is the phrase's count and n the language's words. Cut after its first k words a
    phrase scores floor(1000 a n / (l r)), l and r the counts of its two sides; its
    lowest cut counts, then smallest k. Phrases inside a longer candidate that is as
    frequent are dropped. All arithmetic is in whole numbers.

    A null lang is `und`. Null and empty texts have no words, repeated rows count each,
    other columns are ignored, and an empty table or one without a frequent phrase
    gives no row.
    """
    grams, totals = frequent_phrases(docs, least, longest)
    words = F.split("phrase", " ")
    phrases = grams.withColumn("words", words).withColumn("size", F.size("words")).filter("size > 1")
    side = lambda begin, length: F.array_join(F.slice("words", begin, length), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", F.col("c").alias("a"), "k", side(F.lit(1), F.col("k")).alias("head"),
        side(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"),
    )
    heads = grams.select("lang", F.col("phrase").alias("head"), F.col("c").alias("l"))
    tails = grams.select("lang", F.col("phrase").alias("tail"), F.col("c").alias("r"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = (
        cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
        .withColumn("above", (exact("a") * 1000).cast("decimal(19,0)") * exact("n"))
        .withColumn("below", exact("l") * exact("r"))
        .withColumn("score", F.expr("above div below").cast("bigint"))
        .groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
        .select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    )
    inner = F.expr(
        "flatten(transform(sequence(1, size - 1), i -> transform(sequence(2, least(size - 1, size - i + 1)), "
        "m -> array_join(slice(words, i, m), ' '))))"
    )
    held = (
        phrases.filter("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("c").alias("longer"))
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    )
    kept = scored.join(held, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 100 * a").drop("longer")
    kept = common.stored(kept, "collocations")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salts = -(-kept.count() // RANKED)
    while salts > 1:
        salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        rank = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
        kept = common.stored(salted.withColumn("rank", rank).filter(F.col("rank") <= top).drop("rank", "salt"), "ranked")
        salts = -(-salts * min(top, RANKED // 2) // RANKED)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    ).withColumn("rank", F.col("rank").cast("bigint"))


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


SQL_PHRASES = """
with texts as (
  select row_number() over () as doc, coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
cut as (select doc, lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from texts),
pieces as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from cut),
grams as (
  select lang, array_to_string(list_slice(w, i, i + m - 1), ' ') as phrase, m
  from (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces), range(1, 6) t(m)
  where i + m - 1 <= len(w)),
counts as (select lang, phrase, m, count(*) as f from grams group by all),
totals as (select lang, sum(f)::bigint as n from counts where m = 1 group by lang),
often as (select * from counts where f >= 100),
split as (select lang, phrase, m, f, string_split(phrase, ' ') as w from often where m > 1),
cuts as (
  select s.lang, s.phrase, s.m, s.f, k,
    array_to_string(list_slice(w, 1, k), ' ') as head, array_to_string(list_slice(w, k + 1, m), ' ') as tail
  from split s, range(1, 5) t(k) where k < m),
scored as (
  select c.lang, c.phrase, c.m, c.f as a, k, h.f as l, t.f as r, n.n,
    (1000 * c.f::hugeint * n.n // (h.f::hugeint * t.f))::bigint as score
  from cuts c join often h on h.lang = c.lang and h.phrase = c.head
    join often t on t.lang = c.lang and t.phrase = c.tail join totals n on n.lang = c.lang),
low as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (
  select * from low x where not exists (
    select 1 from split y where y.lang = x.lang and y.m > x.m and 100 * y.f >= 100 * x.a
      and contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')))
select lang, rank, phrase, a, l, r, n, score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
where rank <= 2000
"""

QUERIES = {"op12_phrases": op12_phrases}
SQL = {"op12_phrases": SQL_PHRASES}
