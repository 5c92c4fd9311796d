"""SimHash classes and near-duplicates against all pairs, in plain code."""

import os
import random

import edge
import numpy as np
import pytest
import xxhash
from idsift.llm import linking, simhash


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def bits(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


def test_fingerprint():
    for text in [r[1] for r in edge.rows() if len(r[1] or "") < 5000]:
        assert simhash.text_bits(text) % (1 << 64) == bits(text)


def test_hash_is_sparks(spark):
    for s in ("", "a", "some longer words that fill a block of thirty-two bytes and more", "é"):
        got = spark.sql(f"select xxhash64('{s}')").first()[0]
        assert got % (1 << 64) == xxhash.xxh64_intdigest(s.encode(), 42)


@pytest.mark.parametrize("crowded", [False, True])
def test_links_connect_all_near_fingerprints(spark, crowded):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = set(base) | {0}
    if crowded:  # a cloud around one value, with chains in it
        center = base[0]
        for _ in range(1500):
            fps.add(center ^ sum(1 << b for b in rnd.sample(range(0, 64, 3), rnd.randint(1, 5))))
    for b in base:
        for _ in range(6):
            b ^= 1 << rnd.randrange(64) | 1 << rnd.randrange(64)
            fps.add(b)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    arr = np.array(fps, dtype=np.int64).view(np.uint64)
    links = [(i, int(j)) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 2) if j > i]
    want = groups(len(fps), links)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = {r["node"]: r["component"] for r in linking.components(simhash.near_links(df)).collect()}
    for x, g in zip(fps, want, strict=True):
        assert found.get(x, x) == fps[g]


def test_thresholds_add_up_and_are_cheapest():
    rnd = np.random.default_rng(1)
    widths, near, most = [22, 21, 21], [1.0, 5.0, 2.0], 2
    sizes = rnd.integers(1, 200, (50, 3)).astype(float)
    got = simhash.thresholds(sizes, widths, near, most, 65.0)
    assert ((got + 1).sum(axis=1) == most + 1).all()

    def cost(row, t):
        return sum(
            0 if x < 0 else simhash.ball(w, x) * simhash.PROBE + min(s, 65) + (simhash.ball(w, x) - 1) * n
            for s, x, w, n in zip(row, t, widths, near, strict=True)
        )

    top = simhash.widest(most, 3, 21)
    every = [(a, b, c) for a in range(-1, top + 1) for b in range(-1, top + 1) for c in range(-1, top + 1) if a + b + c == 0]
    for row, t in zip(sizes, got, strict=True):
        assert cost(row, t) == pytest.approx(min(cost(row, e) for e in every))


def test_classes_on_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    arr = np.array([bits(r["text"]) for r in rows], dtype=np.uint64)
    links = [(i, int(j)) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 2) if j > i]
    want = groups(len(rows), links)
    least = {}
    for r, g in zip(rows, want, strict=True):
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    found = {r["doc_id"]: r for r in simhash.op7_simhash(spark, sf_dir).collect()}
    for r, g, b in zip(rows, want, arr.tolist(), strict=True):
        assert found[r["doc_id"]]["component_id"] == least[g]
        assert found[r["doc_id"]]["fingerprint"] == f"{b:016x}"


def test_class_edge_rows(spark):
    found = simhash.classes(edge.docs(spark)).collect()
    assert len(found) == len(edge.rows())
    blank = [r for r in found if r["fp"] == 0]
    assert len(blank) == 4 and {r["component_id"] for r in blank} == {0}
    assert simhash.classes(edge.empty(spark)).count() == 0


def near_table(rnd):
    """Texts with copies, near copies above and below the threshold, and strangers."""
    texts = []
    for g in range(25):
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.choice([40, 120, 400]))]
        for _ in range(rnd.randint(1, 6)):
            w = list(words)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 30])):
                w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 10**6)}"
            texts.append(" ".join(w))
        if g % 5 == 0:
            texts.append(" ".join(words) + " " + " ".join(f"tail{i}" for i in range(len(words) // 8)))
    return texts


@pytest.mark.parametrize("dense", [simhash.NEAR_DENSE, 2])
def test_near_duplicates(spark, dense, monkeypatch):
    monkeypatch.setattr(simhash, "NEAR_DENSE", dense)
    texts = near_table(random.Random(3))
    rnd = list(range(len(texts)))
    random.Random(4).shuffle(rnd)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if simhash.jaccard(texts[i], texts[j]) >= 0.8]
    want = groups(len(texts), links)
    df = edge.with_clashes(spark.createDataFrame([(rnd[i], t) for i, t in enumerate(texts)], "doc_id long, text string"))
    found = {r["text"] + str(r["doc_id"]): r for r in simhash.near_duplicates(df).collect()}
    got = [found[t + str(rnd[i])]["component"] for i, t in enumerate(texts)]
    missed = sum(got[i] != got[j] for i, j in links)
    assert missed <= 0.05 * len(links)
    # Nothing is joined that links don't join.
    for g in set(map(bytes, got)):
        assert len({want[i] for i in range(len(texts)) if bytes(got[i]) == g}) == 1
    for g in set(map(bytes, got)):
        mine = [i for i in range(len(texts)) if bytes(got[i]) == g]
        kept = [rnd[i] for i in mine if found[texts[i] + str(rnd[i])]["keep"]]
        assert kept == [min(rnd[i] for i in mine)]


def edited(rnd, words, edit, n):
    """words with n of them cut off, appended, or replaced in one block."""
    new = [f"y{rnd.randint(0, 10**6)}" for _ in range(n)]
    at = (len(words) - n) // 2
    return {
        "last": words[: len(words) - n], "first": words[n:], "appended": words + new,
        "block": words[:at] + new + words[at + n :],
    }[edit]


def test_no_cut_extended_or_block_edited_copy_is_missed(spark):
    rnd = random.Random(21)
    rows, pairs = [], []
    for edit in ("last", "first", "appended", "block"):
        for _ in range(40):
            words = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.choice([60, 150, 500, 1500]))]
            text = " ".join(words)
            made = (" ".join(edited(rnd, words, edit, n)) for n in range(len(words) // 3, 0, -1))
            copy = next(t for t in made if simhash.jaccard(text, t) >= 0.8)
            assert simhash.jaccard(text, copy) < 0.85
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), text), (len(rows) + 1, copy)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    assert [p for p in pairs if found[p[0]]["component"] != found[p[1]]["component"]] == []
    assert [p for p in pairs if not found[p[0]]["keep"] or found[p[1]]["keep"]] == []


def test_near_duplicate_edge_rows(spark):
    found = simhash.near_duplicates(edge.docs(spark)).collect()
    assert len(found) == len(edge.rows())
    kept = [r for r in found if r["keep"]]
    texts = [" ".join((r["text"] or "").lower().split()) for r in kept]
    assert len(texts) == len(set(texts))
    assert {t for t in texts} >= {"", "a", "###"}
    assert simhash.near_duplicates(edge.empty(spark)).count() == 0


def test_tables_go_when_they_were_read(spark, monkeypatch):
    """Only the nodes, which the result reads, stay in the shared folder."""
    from idsift.llm import common

    there = lambda df: [f for f in df.inputFiles() if os.path.exists(f.removeprefix("file:").replace("///", "/"))]
    made, plain = [], common.stored

    def noted(df, purpose):
        if purpose == "members":
            gone = {p for p, files in made if not any(map(os.path.exists, files))}
            assert gone >= {"index", "probes", "blocks", "shared", "prefixes"}
        out = plain(df, purpose)
        made.append((purpose, [f.removeprefix("file://") for f in there(out)]))
        return out

    monkeypatch.setattr(common, "stored", noted)
    rnd = random.Random(2)
    texts = [" ".join(str(rnd.randrange(5000)) for _ in range(60)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts + [t + " end" for t in texts])), "doc_id long, text string")
    found = simhash.near_duplicates(docs)
    assert {p for p, files in made if any(map(os.path.exists, files))} == {"nodes"}
    assert all(len(files) for p, files in made if p in ("nodes", "blocks", "members"))
    assert found.filter("keep").count() == 30


def test_packed_shingle_keys():
    keys = simhash.shingle_keys([b"w%d" % i for i in range(500)])
    assert len(simhash.packed(keys)) == 6 * len(keys) == 6 * 496
    assert (simhash.unpacked(simhash.packed(keys)) == keys).all()
