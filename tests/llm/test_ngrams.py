"""Elias-Fano sequences, the trie, and scores against the model in plain code."""

import math
import random
from collections import Counter, defaultdict

import edge
import numpy as np
import pytest
from idsift.llm import common, ngrams
from idsift.llm.eliasfano import Monotone, Trie, probability, quantised
from pyspark.sql import functions as F


@pytest.mark.parametrize("n, universe", [(0, 10), (1, 1), (5, 5), (1000, 1000), (1000, 10**12), (3000, 3100), (700, 40)])
def test_monotone(n, universe):
    rnd = np.random.default_rng(n)
    values = np.sort(rnd.integers(0, universe, n))
    s = Monotone(*Monotone.encode(values, universe))
    assert s.at(np.arange(n)).tolist() == values.tolist()
    targets = np.concatenate((values, rnd.integers(0, universe, 500), [0, universe - 1]))
    place, equal = s.successor(targets)
    assert place.tolist() == np.searchsorted(values, targets).tolist()
    assert equal.tolist() == np.isin(targets, values).tolist()


def test_quantised_probabilities():
    p = np.array([0.0, 1.0, 0.5, 1e-9, 0.123])
    got = probability(quantised(p))
    assert got[0] == 0 and got[1] == 1
    assert np.allclose(got[1:], p[1:], rtol=3e-4)


def test_trie_finds_what_it_holds():
    rnd = np.random.default_rng(2)
    contexts = np.unique(rnd.integers(0, 2**63, 300).astype(np.uint64))
    words = np.unique(rnd.integers(0, 2**48, 400).astype(np.uint64))
    pairs = np.unique(rnd.integers(0, len(contexts) * len(words), 5000))
    of, word = pairs // len(words), pairs % len(words)
    prob = rnd.random(len(pairs)) + 1e-6
    trie = Trie(contexts, words, of, word, prob, np.zeros(len(contexts)))
    known = {(int(c), int(w)): p for c, w, p in zip(of, word, prob, strict=True)}
    c, w = rnd.integers(0, len(contexts), 4000), rnd.integers(0, len(words), 4000)
    got = probability(trie.find(c, words[w]))
    want = [known.get((int(a), int(b)), 0.0) for a, b in zip(c, w, strict=True)]
    assert np.allclose(got, want, rtol=3e-4)
    assert trie.context_numbers(np.array([1], dtype=np.uint64)).tolist() == [-1]
    assert trie.find(np.array([-1, 0]), np.array([words[0], 1], dtype=np.uint64)).tolist()[0] == 0
    trie.close()


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def model(train):
    """Unigram and pair probabilities of plain code, with one set of discounts."""
    uni, pairs = Counter(), Counter()
    for text in train:
        t = tokens(text)
        uni.update(t)
        pairs.update(zip([b"\n\n", *t[:-1]], t, strict=True))
    n, v = sum(uni.values()), len(uni)
    d = ngrams.discounts(np.array(list(pairs.values())))
    total, left = Counter(), defaultdict(float)
    for (a, _), c in pairs.items():
        total[a] += c
        left[a] += d[min(c, 3)]

    def one(w):
        return (uni[w] + 1) / (n + v + 1)

    def two(a, w):
        if not total[a]:
            return one(w)
        c = pairs[a, w]
        return (c - d[min(c, 3)]) / total[a] + left[a] / total[a] * one(w)

    return uni, n, one, two


def some_texts():
    rnd = random.Random(5)
    words = ["the", "of", "Ünder"] + [f"w{i}" for i in range(60)]
    return [" ".join(rnd.choice(words[: rnd.choice([3, 20, 63])]) for _ in range(rnd.randint(0, 40))) for _ in range(120)]


@pytest.mark.parametrize("block", [10**7, 300])
def test_scores(spark, block, monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK", block)
    texts = some_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    out = F.col("doc_id") % 4 == 1
    found = {r["doc_id"]: r for r in ngrams.score(df.repartition(3), out).collect()}
    uni, n, one, two = model([t for i, t in enumerate(texts) if i % 4 != 1])
    for i, text in enumerate(texts):
        t, r = tokens(text), found[i]
        assert r["held_out"] == (i % 4 == 1)
        assert (r["n_tokens"], r["train_tokens"]) == (len(t), n)
        assert r["n_known"] == sum(uni[w] > 0 for w in t)
        assert r["base_score"] == pytest.approx(sum(math.log10(one(w)) for w in t), abs=1e-9)
        want = sum(math.log10(two(a, w)) for a, w in zip([b"\n\n", *t[:-1]], t, strict=True))
        assert r["score"] == pytest.approx(want, rel=2e-4, abs=2e-3)


def test_probabilities_add_up():
    uni, n, one, two = model(some_texts())
    vocabulary = [*uni, b"unseen"]
    assert sum(map(one, vocabulary)) == pytest.approx(1)
    for a in (b"the", b"w5", b"\n\n", b"unseen"):
        assert sum(two(a, w) for w in vocabulary) == pytest.approx(1)


def test_shards_and_spread_contexts(spark, monkeypatch):
    """Counts are those of one shard; scores stay probabilities under other discounts."""
    texts = some_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = F.col("doc_id") % 4 == 1
    plain = {r["doc_id"]: r for r in ngrams.score(df, out).collect()}
    for name, size in (("SHARD", 50), ("HOT", 20), ("REPORTED", 2), ("BLOCK", 2000)):
        monkeypatch.setattr(ngrams, name, size)
    found = {r["doc_id"]: r for r in ngrams.score(df, out).collect()}
    for i, r in found.items():
        for c in ("n_tokens", "n_known", "train_tokens"):
            assert r[c] == plain[i][c]
        assert r["base_score"] == pytest.approx(plain[i]["base_score"])
        assert r["score"] == pytest.approx(plain[i]["score"], rel=0.15)


def test_better_than_its_base_on_held_out_text(spark, sf_dir):
    found = [r for r in ngrams.op2_lm_score(spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


def test_edge_rows(spark):
    out = common.crc_of_id() % 7 == 2
    found = ngrams.score(edge.docs(spark), out).collect()
    assert len(found) == len(edge.rows())
    assert all(r["score"] <= 0 and r["n_tokens"] >= 1 for r in found)
    assert ngrams.score(edge.empty(spark), out).count() == 0
    alone = ngrams.score(edge.docs(spark), F.lit(True)).collect()
    assert {(r["train_tokens"], r["n_known"]) for r in alone} == {(0, 0)}
