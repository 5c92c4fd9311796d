"""Posting lists against all distances."""

import edge
import numpy as np
import pytest
from idsift.llm import nearest

INF, NAN = float("inf"), float("nan")


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, queries, k):
    """(vec_id, vector) of usable rows -> query id: sorted (distance, id)."""
    once = sorted({(i, tuple(np.float32(v).tolist())) for i, v in rows})
    ids, x = np.array([i for i, _ in once]), np.array([v for _, v in once])
    out = {}
    for i, v in queries:
        far = np.sqrt(((x - np.float32(v).astype(float)) ** 2).sum(axis=1))
        out[i] = sorted((d, j) for d, j in zip(far.tolist(), ids.tolist(), strict=True) if j != i)[:k]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    hit = sum(len({j for _, j in got.get(q, [])} & {j for _, j in w}) for q, w in want.items())
    return hit / sum(map(len, want.values()))


@pytest.mark.parametrize("clear", [True, False])
def test_recall_and_distances(spark, monkeypatch, clear):
    monkeypatch.setattr(nearest, "BLOCK", 40)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 5)
    rnd = np.random.default_rng(2)
    middles = rnd.normal(0, 1 if clear else 0.05, (12, 24))
    x = (middles[rnd.integers(0, 12, 3000)] + rnd.normal(0, 0.2, (3000, 24))).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = edge.with_clashes(table(spark, [(*r, None) for r in rows]).repartition(4))
    got = answers(nearest.search(df.filter("vec_id % 50 = 0"), df))
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 10)
    assert got.keys() == want.keys() and all(len(g) == 10 for g in got.values())
    far = {q: dict((j, d) for d, j in brute(rows, [rows[q]], 3000)[q]) for q in list(got)[:5]}
    assert all(s == pytest.approx(far[q][j], abs=1e-12) for q in far for s, j in got[q])
    assert recall(got, want) >= 0.95


def test_copies_ties_and_unusable_rows(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(0, 1, 8).astype("f4").tolist()) for i in range(100)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)]  # a hot vector, in queries too
    rows += [rows[1], rows[1]]
    bad = [(2000, None), (2100, []), (2200, [0.0] * 8), (2300, [NAN] * 8), (2400, [INF] * 8), (2500, [None] + [1.0] * 7), (2600, [1.0] * 7)]
    df = table(spark, [(*r, 1) for r in rows + bad])
    got = answers(nearest.search(df.filter("vec_id % 100 = 0"), df))
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert {q: [j for _, j in g] for q, g in got.items()} == {q: [j for _, j in w] for q, w in want.items()}


def test_few_candidates_and_short_lists(spark, monkeypatch):
    rows = [(i, [float(i + 1), 1.0]) for i in range(6)]
    df = table(spark, [(*r, 1) for r in rows])
    got = answers(nearest.search(df.filter("vec_id = 0"), df))
    assert [j for _, j in got[0]] == [1, 2, 3, 4, 5]
    monkeypatch.setattr(nearest, "LIST", 4)
    rows = [(i, [float(2**i), 1.0]) for i in range(40)]
    df = table(spark, [(*r, 1) for r in rows])
    got = answers(nearest.search(df.filter("vec_id = 0"), df, ratio=1.0))
    assert len(got[0]) == 10
    assert nearest.search(df.limit(0), df).count() == 0 and nearest.search(df, df.limit(0)).count() == 0


def test_null_ids(spark):
    df = table(spark, [(None, [1.0, 2.0], 1), (None, [1.0, 3.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], None)])
    got = nearest.search(df, df).collect()
    assert sorted((str(r["query_id"]), str(r["vec_id"]), r["score"]) for r in got) == [
        ("1", "None", 0.0), ("1", "None", 1.0), ("None", "1", 0.0), ("None", "1", 1.0)
    ]


def test_graph_reaches_what_lies_within_the_ratio():
    rnd = np.random.default_rng(8)
    graph = nearest.Graph(nearest.halved(rnd.normal(0, 1, (4000, 12)), 256))
    x = rnd.normal(0, 1, (300, 12))
    far, true = graph.search(x, 1.2), nearest._distances(x, graph.centroids)
    inside = true <= true.min(axis=1, keepdims=True) * 1.2
    assert (np.isfinite(far) & inside).sum() >= 0.99 * inside.sum()
    assert np.isfinite(far).sum() < 0.9 * far.size
    rows, _, _ = nearest.replicas(graph, x)
    assert set(rows) == set(range(300)) and 1 < len(rows) / 300 <= nearest.REPLICAS


def test_lists_are_balanced():
    rnd = np.random.default_rng(9)
    sample = np.concatenate([rnd.normal(0, 0.01, (900, 4)), rnd.normal(5, 1, (124, 4))])
    centroids = nearest.halved(sample, 16)
    assert len(centroids) == 16 and (np.abs(centroids).max(axis=1) < 1).sum() >= 13
