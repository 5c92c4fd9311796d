"""Held-out accuracy, the backoff rule, and rows without letters."""

import math
import random
from collections import Counter

import edge
import numpy as np
import pytest
from idsift.llm import common, language
from pyspark.sql import functions as F


def test_held_out_accuracy(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    found = language.op9_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out").collect()
    assert len(held) > 20
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_held_out_labels_teach_nothing(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    spoilt = docs.withColumn("lang", F.when(language.is_held_out(), F.lit("xx")).otherwise(F.col("lang")))
    model = language.fit(spoilt.filter(~language.is_held_out()))
    assert "xx" not in model["langs"]


def test_backoff_goes_to_the_longest_known_length():
    tables = {n: {} for n in range(language.LONGEST + 1)}
    tables[2] = {"ab": 0, "bc": 1}
    tables[1] = {"a": 2}
    assert language.backoff("abc", tables) == [0, 1]
    assert language.backoff("xay", tables) == [2]
    assert language.backoff("q", tables) == []


def test_known_words_come_first():
    tables = {n: {} for n in range(language.LONGEST + 1)}
    tables[0], tables[3] = {"der": 0}, {"der": 1}
    logs = np.array([[-9.0, -1.0], [-1.0, -9.0]])
    model = {"langs": ["de", "en"], "tables": tables, "logs": logs}
    assert language.score(["der"], model, {})[0] == "en"
    assert language.score(["xderx"], model, {})[0] == "de"


def test_edge_rows(spark):
    docs = edge.docs(spark)
    model = language.fit(docs)
    found = language.identify(docs, model).collect()
    assert len(found) == len(edge.rows())
    for r in found:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in model["langs"] and 0 < r["score"] <= 1
    none = language.fit(edge.empty(spark))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(edge.empty(spark), model).count() == 0


def plainly(train, text):
    """Prediction by the definition: counts, then a sum over the text's words."""
    langs = sorted({lang for _, lang in train})
    counts = {lang: [Counter() for _ in range(language.LONGEST + 1)] for lang in langs}
    for text_of, lang in train:
        for word in language.words_of(text_of):
            counts[lang][0][word] += 1
            for n in range(1, language.LONGEST + 1):
                marked = f"<{word}>"
                counts[lang][n].update(marked[i : i + n] for i in range(len(marked) - n + 1))
    known = [set().union(*(counts[lang][n] for lang in langs)) for n in range(language.LONGEST + 1)]

    def log(lang, n, entry):
        total = sum(counts[lang][n].values()) or 1
        return math.log(counts[lang][n][entry] + language.SMOOTHING) - math.log(total + language.SMOOTHING * len(known[n]))

    words, totals = language.words_of(text), dict.fromkeys(langs, 0.0)
    for word in words:
        if word in known[0]:
            for lang in langs:
                totals[lang] += log(lang, 0, word)
            continue
        marked = f"<{word}>"
        for n in range(language.LONGEST, 0, -1):
            found = [g for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if g in known[n]]
            if found:
                for lang in langs:
                    totals[lang] += sum(log(lang, n, g) for g in found) / len(found)
                break
    best = max(langs, key=lambda lang: (totals[lang], [-ord(c) for c in lang]))
    share = min(1.0, language.EVIDENCE_WORDS / len(words))
    return best, 1 / sum(math.exp((t - totals[best]) * share) for t in totals.values())


def test_against_plain_scoring(spark):
    rnd = random.Random(12)
    stems = {"en": ["the", "water", "light", "thing"], "de": ["das", "wasser", "licht", "ding"], "fr": ["le", "eau", "lumière", "chose"]}
    make = lambda lang, n: " ".join(rnd.choice(stems[lang]) + rnd.choice(["", "", "s", "en", "ment"]) for _ in range(n))
    train = [(make(lang, rnd.randint(1, 30)), lang) for lang in stems for _ in range(25)]
    model = language.fit(spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(train)], "doc_id long, text string, lang string"))
    asked = [make(lang, 6) for lang in stems for _ in range(8)] + ["wässerchen leuchtet", "qqq zzz", "licht eau thing", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    for r in language.identify(df, model).collect():
        want, confidence = plainly(train, r["text"])
        assert (r["lang_pred"], r["score"]) == (want, pytest.approx(confidence, abs=1e-9)), r["text"]
