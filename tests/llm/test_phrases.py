"""Collocations against plain counting, and the filter's round trip."""

import random
import re
from collections import Counter

import edge
import numpy as np
import pytest
from idsift.llm import phrases, quotient


def brute(docs, least, longest, top):
    counts, total = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = {}
    for lang, f in counts.items():
        often = [p for p in f if len(p) > 1 and f[p] >= least]
        rows = []
        for p in often:
            if any(len(y) > len(p) and f[y] >= f[p] and p in [y[i : i + len(p)] for i in range(len(y))] for y in often):
                continue
            cuts = [(1000 * f[p] * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            rows.append((" ".join(p), f[p], left, right, total[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out |= {(lang, i): r for i, r in enumerate(rows[:top], 1)}
    return out


def corpus(n=300):
    rnd = random.Random(4)
    words = ["der", "The", "new", "york", "CITY", "of", "a", "é", "ß", "\U0001f600", "x-1", "\x00", "rare"]
    fixed = ["new york city of the", "a a a a a a", "der der", "The new\tyork"]
    docs = []
    for i in range(n):
        parts = [rnd.choice(fixed) if rnd.random() < 0.4 else rnd.choice(words) for _ in range(rnd.randint(0, 40))]
        text = "".join(p + rnd.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "!?"]) for p in parts)
        docs.append((i, rnd.choice([text, text, text, None, ""]), rnd.choice(["en", "de", None, "und"])))
    return docs


def found(df, **settings):
    return {(r["lang"], r["rank"]): tuple(r)[2:] for r in phrases.collocations(df, **settings).collect()}


@pytest.mark.parametrize("case", ["plain", "few ids", "many shards", "ranked in parts"])
def test_against_plain_counting(spark, monkeypatch, case):
    docs = corpus()
    settings = {"least": 6, "longest": 5, "top": 30 if case != "ranked in parts" else 5}
    if case == "few ids":
        monkeypatch.setattr(phrases, "MOST_WORDS", 5)
        monkeypatch.setattr(phrases, "HELD", 50)
    if case == "many shards":
        for name, value in (("SHARD", 16), ("FAN_BITS", 1), ("BLOCK", 200), ("MAP_BITS", 8)):
            monkeypatch.setattr(phrases, name, value)
    if case == "ranked in parts":
        monkeypatch.setattr(phrases, "RANKED", 12)
    df = edge.with_clashes(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(7))
    want = brute([(lang, text) for _, text, lang in docs], **settings)
    assert found(df, **settings) == want and len(want) >= 15


def test_edge_rows(spark):
    want = brute([(r[2], r[1]) for r in edge.rows()], 3, 5, 2000)
    assert found(edge.docs(spark), least=3) == want and want
    assert found(edge.empty(spark)) == {}
    assert found(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")) == {}


@pytest.mark.parametrize("n,bits", [(1, 1), (2, 1), (2, 18), (3, 7), (4, 16), (4, 18), (5, 13), (5, 18)])
def test_filters_lose_nothing(n, bits):
    rnd = np.random.default_rng(n * bits)
    columns = [rnd.integers(0, 1 << bits, 700) % 40 for _ in range(n)]
    columns[0][:50] = (1 << bits) - 1
    width, depth = n * bits, min(3, quotient.halves(n * bits)[0])
    left, right = quotient.pack(columns, bits)
    assert all((a == b).all() for a, b in zip(columns, quotient.unpack(left, right, bits, n), strict=True))
    whole = quotient.counted(left, right, np.where(np.arange(700) % 9, 1, 300), width)
    parts = [quotient.loads(quotient.dumps(p, width, depth)) for _, p in quotient.shards(whole, width, depth)]
    both = quotient.merged(parts + parts, width)
    assert (both[0] == whole[0]).all() and (both[1] == whole[1]).all() and (both[2] == 2 * whole[2]).all()
    ids = Counter()
    for row, c in zip(zip(*columns, strict=True), np.where(np.arange(700) % 9, 1, 300), strict=True):
        ids[tuple(map(int, row))] += int(c)
    back = zip(*quotient.unpack(whole[0], whole[1], bits, n), strict=True)
    assert {tuple(map(int, k)): int(c) for k, c in zip(back, whole[2], strict=True)} == ids
