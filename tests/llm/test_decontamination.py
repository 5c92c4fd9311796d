"""Hits against a search of every window, in plain code."""

import hashlib
import random
import re
from collections import defaultdict

import edge
from idsift.llm import decontamination
from pyspark.sql import functions as F

WORD = re.compile(decontamination.TOKEN)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, span=13):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        m = min(span, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[s : s + m])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for m in lengths:
            for s in range(len(w) - m + 1):
                who = windows.get(tuple(w[s : s + m]))
                if who:
                    hit.update(range(s, s + m))
                    found |= who
        ids = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def cases():
    rnd = random.Random(1)
    some = lambda n: [f"w{rnd.randint(0, 400)}" for _ in range(n)]
    items = [some(rnd.choice([3, 7, 12, 13, 14, 30])) for _ in range(25)] + [["the"] * 20, ["only"], []]
    docs = []
    for i in range(60):
        text = some(rnd.randint(0, 80))
        for _ in range(rnd.randint(0, 3)):
            item = rnd.choice(items)
            lo = rnd.randint(0, max(0, len(item) - 13))
            at = rnd.randint(0, len(text))
            text[at:at] = item[lo : lo + rnd.choice([12, 13, 14, 40])]
        if i % 10 == 0:
            text += ["The"] * 200
        docs.append(rnd.choice([" ", "\n", ", "]).join(text).title())
    return docs, [(i, " ".join(t)) for i, t in enumerate(items)] + [(None, "null ids count for hits " * 3), (3, None)]


def check(spark, docs, items):
    df = edge.with_clashes(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(df, bench).collect()
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got}
    want = brute(docs, items)
    assert len(got) == len(docs)
    for i, w in enumerate(want):
        assert got[i] == w, (i, docs[i])


def test_short_and_long_items(spark):
    docs, items = cases()
    check(spark, docs, items)


def test_long_items_only(spark):
    docs, items = cases()
    check(spark, docs, [(i, t) for i, t in items if t and len(t.split()) >= 13])


def test_repeated_passages_and_long_texts(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [passage, passage + " x", "y " + passage, "z " * 50_000 + passage, (passage + " ") * 300, "q" * 200_000]
    check(spark, docs, [(1, passage), (2, passage), (10, "a b " + passage)])


def test_edge_rows(spark):
    rows = edge.rows()
    items = [(1, "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt"), (2, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(edge.docs(spark), bench).collect()
    want = brute([t for _, t, *_ in rows], items)
    assert sorted(r["n_hit"] for r in got) == sorted(w[1] for w in want)
    assert sorted(r["n_words"] for r in got) == sorted(w[0] for w in want)
    none = decontamination.decontaminate(edge.docs(spark), bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["contaminated"] or r["n_hit"] for r in none)
    assert decontamination.decontaminate(edge.empty(spark), bench).count() == 0


def test_words_are_told_by_what_they_hold(spark):
    """The contract's class of characters, spelt the other way round, and fast."""
    contract = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    chars = [*map(chr, range(0x100)), *"AZaz09éßИ日😀\U0010ffff퟿￿ "]
    texts = [(f"x{c}y {c}{c} {c}",) for c in chars] + [("",), (None,)]
    rows = spark.createDataFrame(texts, "text string").select(
        decontamination.tokens(F.col("text")).alias("got"), decontamination.count_tokens(F.col("text")).alias("n"),
        F.regexp_extract_all(decontamination.common.lower_ascii(F.coalesce("text", F.lit(""))), F.lit(contract), F.lit(0)).alias("want"),
    ).collect()
    assert all(r.got == r.want and r.n == len(r.want) for r in rows)
    assert not decontamination.TOKEN.startswith("[^")
