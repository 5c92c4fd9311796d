"""Language identification by word-first backoff.

A known word scores its logarithmic frequency in each language. An unseen word is
spelt out as character n-grams, the longest length of which any n-gram is known:
the score is the mean over the word's known n-grams of that length. A text's score
is the sum over its words.

The model is fitted on a bounded sample of labelled rows (DOCS_PER_LANGUAGE) and has
at most MODEL_ENTRIES entries, so it has a known size when it is sent to the tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idsift.llm import common

#: Labelled documents per language that the model is fitted on, about.
DOCS_PER_LANGUAGE = 4_000
#: Entries of the model: words, and n-grams of each length, over all languages.
MODEL_ENTRIES = 400_000
#: Longest character n-gram; a word is marked at both ends.
LONGEST = 5
SMOOTHING = 0.1
#: Words whose evidence makes up the confidence.
EVIDENCE_WORDS = 8
UNKNOWN = "und"
#: Unseen words that a task remembers before it starts anew.
REMEMBERED = 50_000
#: Distinct words, or n-grams, that a task counts before it passes them on.
HELD = 50_000
#: Longer words are neither learned from letter by letter nor remembered.
LONGEST_WORD = 64

_word = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, entries: int = MODEL_ENTRIES) -> dict:
    """labelled (doc_id, text, lang) -> the model's tables, sent to the driver.

    Rows with a null text or lang teach nothing. n = 0 counts words.
    """
    known = labelled.filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "tables": {}}
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, min(1.0, docs_per_language / sizes[lang])).otherwise(share)
    # A document's place in a fixed order decides, so that reruns learn the same.
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 20)) / (1 << 20)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                held.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, held.values())) >= HELD:
                    yield _frame(((lang, 0, w), c) for lang, words in held.items() for w, c in words.items())
                    held = {}
        yield _frame(((lang, 0, w), c) for lang, words in held.items() for w, c in words.items())

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for lang, word, c in zip(batch["lang"], batch["gram"], batch["c"], strict=True):
                if len(word) <= LONGEST_WORD:
                    for n in range(1, LONGEST + 1):
                        for g in grams(word, n):
                            found[lang, n, g] += c
                if len(found) >= HELD:
                    yield _frame(found.items())
                    found = Counter()
        yield _frame(found.items())

    # Words are counted first, so that each distinct one is spelt once.
    schema = "lang string, n int, gram string, c long"
    texts = known.filter(place < share).select("lang", "text")
    words = common.stored(
        texts.mapInPandas(count, schema).groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")), "words"
    )
    spelt = words.mapInPandas(spell, schema).groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    counted = words.unionByName(spelt)
    each = max(100, entries // (len(langs) * (LONGEST + 1)))
    by_kind = Window.partitionBy("lang", "n")
    rank = F.row_number().over(by_kind.orderBy(F.desc("c"), "gram"))
    rows = (
        counted.withColumn("total", F.sum("c").over(by_kind)).withColumn("rank", rank)
        .filter(F.col("rank") <= each).drop("rank").toPandas()
    )
    place_of = {lang: i for i, lang in enumerate(langs)}
    tables: dict[int, dict[str, int]] = {n: {} for n in range(LONGEST + 1)}
    totals = np.ones((LONGEST + 1, len(langs)))
    for n, gram in sorted(set(zip(rows["n"], rows["gram"], strict=True))):
        tables[n][gram] = sum(map(len, tables.values()))
    counts = np.zeros((sum(map(len, tables.values())), len(langs)))
    kind = np.zeros(len(counts), dtype=np.int64)
    for lang, n, gram, c, total in rows.itertuples(index=False):
        at = tables[n][gram]
        counts[at, place_of[lang]], kind[at] = c, n
        totals[n, place_of[lang]] = total
    sizes_of = np.array([max(1, len(tables[n])) for n in range(LONGEST + 1)])
    below = np.log(totals + SMOOTHING * sizes_of[:, None])
    return {"langs": langs, "tables": tables, "logs": np.log(counts + SMOOTHING) - below[kind]}


def _frame(counts) -> pd.DataFrame:
    return pd.DataFrame([(*k, c) for k, c in counts], columns=["lang", "n", "gram", "c"])


def backoff(word: str, tables: dict[int, dict[str, int]]) -> list[int]:
    """Rows of an unseen word's known n-grams, of the longest n that has any."""
    for n in range(min(LONGEST, len(word) + 2), 0, -1):
        table = tables[n]
        found = [i for g in grams(word, n) if (i := table.get(g)) is not None]
        if found:
            return found
    return []


def score(words: list[str], model: dict, memory: dict[str, list[int]]) -> tuple[str, float]:
    """Best language and a confidence between 0 and 1; ties go to the lower name."""
    langs, tables = model["langs"], model["tables"]
    if not langs or not has_letter(words):
        return UNKNOWN, 0.0
    known, at, weights = tables[0], [], []
    for word, c in Counter(words).items():
        i = known.get(word)
        if i is not None:
            at.append(i)
            weights.append(c)
            continue
        found = memory.get(word)
        if found is None:
            if len(memory) >= REMEMBERED:
                memory.clear()
            found = backoff(word, tables)
            if len(word) <= LONGEST_WORD:
                memory[word] = found
        if found:
            at += found
            weights += [c / len(found)] * len(found)
    total = np.array(weights) @ model["logs"][at] if at else np.zeros(len(langs))
    best = int(total.argmax())
    evidence = (total - total[best]) * min(1.0, EVIDENCE_WORDS / len(words))
    return langs[best], float(1 / np.exp(evidence).sum())


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """docs with lang_pred and score.

    A null text, an empty one or one without a letter is `und` with score 0, as is
    every text if the model knows no language. Whole texts are read. Repeated rows
    are judged alike, and other columns are kept; input columns with the two names
    are replaced.
    """

    # Unpacked once per worker, not once per task.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memory: dict[str, list[int]] = {}
        for texts in batches:
            found = [score(words_of(t), shared.value, memory) if t else (UNKNOWN, 0.0) for t in texts]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    judged = docs.select(*common.without(docs, {"lang_pred", "score", "_judged"}), judge(F.col("text")).alias("_judged"))
    return judged.select("*", "_judged.lang_pred", "_judged.score").drop("_judged")


def is_held_out():
    return common.crc_of_id() % 5 == 0


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.filter(~is_held_out()).select("doc_id", "text", "lang"))
    judged = identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
SQL: dict[str, str] = {}
