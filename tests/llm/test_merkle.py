"""Fingerprints against plain code for the order, and the tree's promises."""

import hashlib

import edge
from idsift.llm import merkle
from pyspark.sql import functions as F


def expected(rows):
    """doc_id -> edited text, for distinct ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc, text) in enumerate(order):
        n = len(text or "") // 3
        after = order[(i + 1) % len(order)][1] or ""
        out[doc] = (text or "")[: len(text or "") - n] + after[:n]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_edited_texts(spark, monkeypatch):
    rows = [(i * 7 % 101 * 1000, t) for i, t in enumerate([r[1] for r in edge.rows()] + [f"t{i}. é{i}\n" * i for i in range(60)])]
    want = expected(rows)
    for size in (20_000, 5):
        monkeypatch.setattr(merkle, "RANGE_ROWS", size)
        found = {r["doc_id"]: r for r in merkle.fingerprint(table(spark, rows)).collect()}
        assert len(found) == len(rows)
        for doc, text in rows:
            r = found[doc]
            assert r["n_chars"] == len(text or "")
            assert r["edited_sha256"] == hashlib.sha256(want[doc].encode()).hexdigest()
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            assert (r["fingerprint"] == r["edited_fingerprint"]) == ((text or "") == want[doc])


def test_equal_texts_have_equal_fingerprints_and_edits_stay_near(spark):
    a = "\n".join(f"Paragraph {i} says one thing. Then it says number {i * 7}." for i in range(40))
    b = "\n".join(f"Other {i} tells of {i * 3} things! Are they {i}?" for i in range(40))
    found = {r["doc_id"]: r for r in merkle.fingerprint(table(spark, [(3, a), (2, b), (1, a)])).collect()}
    assert found[3]["fingerprint"] == found[1]["fingerprint"] != found[2]["fingerprint"]
    assert found[1]["near_next"] == 1.0 and found[3]["near_next"] < 0.05
    assert 0.6 < found[3]["near_edited"] < 0.75


def test_branches_locate_edits(spark):
    old = "A one.\nB two.\n\nC three.\nD four."
    new = "A one.\nB 2.\n\nC three.\nD four.\nE five."
    pairs = spark.createDataFrame([(old, new), (old, old), (None, "x"), ("", None)], "old string, new string")
    found = [[(x[0], x[1]) for x in r["changed"]] for r in merkle.edits(pairs).collect()]
    assert found == [[(0, 1), (1, 2)], [], [(0, 0)], []]


def test_edge_rows(spark):
    found = merkle.fingerprint(edge.docs(spark)).collect()
    assert len(found) == len(edge.rows())
    # Wholly equal rows have equal results.
    same = [r for r in found if r["doc_id"] == 5 and r["n_chars"] == len(edge.rows()[5][1])]
    assert len(same) == 3 and len({r["edited_sha256"] for r in same}) == 1
    assert merkle.fingerprint(edge.empty(spark)).count() == 0
    one = merkle.fingerprint(table(spark, [(1, "abcdef")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
