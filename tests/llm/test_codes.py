"""Product codes against plain code, and the tree against all distances."""

import math

import edge
import numpy as np
import pytest
from idsift.llm import codes

INF, NAN = float("inf"), float("nan")


def brute(rows, parts, entries, rounds):
    """rows (vec_id, vector) without unusable ones -> code, error per row; codebooks."""
    whole = [[math.floor(x * 256) for x in v] for _, v in rows]
    width = len(whole[0]) // parts
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    first = sorted({(i is None, i): None for i, _ in rows})[:entries]
    books = []
    for p in range(parts):
        books.append([min((w, c[p]) for (i, _), w, c in zip(rows, whole, cut, strict=True) if (i is None, i) == key)[1] for key in first])
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        near = [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
        if turn < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    mine = [c[p] for c, n in zip(cut, near, strict=True) if n[p][1] == k]
                    if mine:
                        books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return ["".join(f"{k:02x}" for _, k in n) for n in near], [sum(d for d, _ in n) for n in near], books


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("spread", [0.004, 0.3])
def test_codes_against_plain_code(spark, spread):
    rnd = np.random.default_rng(7)
    good = [(int(i) * 3 - 50, rnd.normal(0, spread, 32).astype("f4").tolist(), int(i) % 3) for i in rnd.permutation(150)]
    good += [good[0], good[0], (None, good[3][1], None), (None, good[4][1], None), (1 << 60, good[5][1], None)]
    bad = [(-99, None, 1), (-98, [], 1), (-97, [1.0] * 31 + [None], 1), (-96, [NAN] * 32, 2), (-95, [INF] + [0.0] * 31, None), (-94, [0.5] * 16, 1), (-93, [70000.0] + [0.0] * 31, 1)]
    df = edge.with_clashes(table(spark, good + bad).repartition(5))
    found, books = codes.compress(df, 16, 20, 2)
    want = brute([g[:2] for g in good], 16, 20, 2)
    assert books.tolist() == want[2]
    got = sorted((str(r["vec_id"]), r["code"], r["error"]) for r in found.collect())
    assert got == sorted((str(g[0]), c, e) for g, c, e in zip(good, want[0], want[1], strict=True))
    back = codes.decode([c for _, c, _ in got[:5]], books)
    assert back.shape == (5, 32)


def test_edge_tables(spark):
    for rows in ([], [(1, None, 1)], [(1, [0.5] * 15, 1)]):
        found, books = codes.compress(table(spark, rows))
        assert found.count() == 0 and books.size == 0
    found, books = codes.compress(table(spark, [(5, [-0.001] * 16, None)] * 3))
    assert [tuple(r) for r in found.collect()] == [(5, None, "00" * 16, 0)] * 3
    assert books.ravel().tolist() == [-1] * 16


@pytest.mark.parametrize("width,size", [(1, 3), (1, 200), (4, 2), (4, 40), (4, 1 << 23), (16, 30)])
def test_tree_finds_the_lowest_of_the_nearest(width, size):
    rnd = np.random.default_rng(width + size)
    entries, queries = rnd.integers(-size, size, (64, width)), rnd.integers(-size, size, (2000, width))
    entries[40] = entries[7]
    number, square, measured = codes.Gnat(entries).search(queries)
    all_squares = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (number == all_squares.argmin(axis=1)).all() and (square == all_squares.min(axis=1)).all()
    assert measured < 64 * 2000 or width > 4


def test_clear_entries_are_found_with_few_distances():
    rnd = np.random.default_rng(1)
    entries = rnd.integers(-3000, 3000, (64, 4))
    queries = entries[rnd.integers(0, 64, 5000)] + rnd.integers(-100, 100, (5000, 4))
    number, _, measured = codes.Gnat(entries).search(queries)
    assert measured < 0.4 * 64 * 5000


def test_roots_enclose():
    squares = np.array([0, 1, 2, 3, 4, 10**6, 10**6 + 1, (1 << 58) - 1, 1 << 57])
    low, high = codes.roots(squares)
    for s, a, b in zip(squares.tolist(), low.tolist(), high.tolist(), strict=True):
        assert a == math.isqrt(16 * s) and b == a + (a * a < 16 * s)
