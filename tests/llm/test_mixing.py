"""The mix's targets, cuts and order, and rows of every kind."""

import hashlib
import random
from collections import defaultdict

import edge
from idsift.llm import mixing


def fill(sizes: dict, weights: dict, repeats=3):
    """Targets by handing on what exceeds a source's limit, again and again."""
    left, out, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > repeats * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weights[s] / total for s in open_}
        for s in over:
            out[s] = float(repeats * sizes[s])
            open_.discard(s)
        left = sum(sizes.values()) - sum(out[s] for s in out)
    return out


def table(spark, sizes):
    rows = [(i, " ".join("w" * n for n in [1] * size), s) for i, (s, size) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_cuts(spark):
    sizes = [("a", 3), ("a", 5), ("b", 1), ("c", 400), ("c", 7), ("d", 90), (None, 12), ("e", 0), ("b", 2)]
    found = mixing.mix(table(spark, sizes)).collect()
    total = defaultdict(int)
    for s, n in sizes:
        total[s] += n
    names = sorted((s for s in total if s is not None)) + [None]
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    want = fill(dict(total), weights)
    taken = defaultdict(int)
    for r in found:
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    largest = {s: max(n for t, n in sizes if t == s) for s in total}
    for s in total:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert sum(taken.values()) == sum(total.values())
    # One document in all is cut.
    assert sum(r["size"] > 0 and r["taken"] % r["size"] > 0 for r in found) <= 1


def test_reruns_and_partitions_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pick = lambda d: sorted(map(tuple, mixing.mix(d).select("doc_id", "taken", "served_before").collect()))
    assert pick(docs) == pick(docs.repartition(7))


def brute(rows, repeats=3):
    """rows (doc_id, size, source) -> words taken of each, by the sequence written out."""
    total = defaultdict(int)
    for _, n, s in rows:
        total[s] += n
    names = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    copies = []
    for rank, s in enumerate(names):
        before = 0
        queue = sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), n, i) for i, n, t in rows if t == s)
        for _, n, i in queue:
            copies += [((total[s] * k + before + n) / (rank % 3 + 1), rank, i, n) for k in range(repeats)]
            before += n
    left, taken = sum(total.values()), defaultdict(int)
    for _, _, i, n in sorted(copies):
        taken[i] += min(n, left)
        left -= min(n, left)
    return taken


def test_against_the_sequence_written_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 40)
    rnd = random.Random(6)
    rows = [(i, rnd.choice([0, 1, 2, 5, 40, 300]), rnd.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(400)]
    df = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, n, s in rows], "doc_id long, text string, source string")
    want = brute(rows)
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(edge.with_clashes(df).repartition(5)).collect()}
    assert got == {i: want[i] for i, _, _ in rows}


def test_one_id_with_several_texts(spark):
    rows = [(7, f"word{i} " * (i % 3 + 1), "a") for i in range(30)] + [(None, f"x{i}", None) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pick = lambda d: sorted((str(r["doc_id"]), r["text"], r["taken"]) for r in mixing.mix(d).collect())
    assert pick(df) == pick(df.repartition(4)) == pick(df.orderBy("text"))


def test_schedule_is_the_mix_in_virtual_time(spark):
    sizes = [("a", 10)] * 9 + [("b", 10)] * 30
    mixed = mixing.mix(table(spark, sizes))
    sent = mixing.schedule(mixed).collect()
    assert [r["virtual_finish"] for r in sent] == sorted(r["virtual_finish"] for r in sent)
    assert sum(r["sent"] for r in sent) == sum(r["taken"] for r in mixed.collect())
    # Any start of the sequence is mixed by weight (a: 1, b: 2), up to a document.
    got = defaultdict(int)
    for r in sent:
        got[r["source"]] += r["sent"]
        if got["a"] < 90:
            assert abs(got["b"] - 2 * got["a"]) <= 20


def test_edge_rows(spark):
    found = mixing.mix(edge.docs(spark)).collect()
    assert len(found) == len(edge.rows())
    for r in found:
        assert r["size"] == len((r["text"] or "").encode().split())
    assert {r["taken"] for r in found if r["size"] == 0} == {0}
    assert mixing.mix(edge.empty(spark)).count() == 0
    blank = table(spark, [("a", 0), ("b", 0)])
    assert {r["taken"] for r in mixing.mix(blank).collect()} == {0}
