"""Line classes against all pairs, in plain code."""

import pathlib
import random
import time

import numpy as np
import pandas as pd

import edge
from pyspark.sql import functions as F

from idsift.llm import common, lines, linking
from test_simhash import groups


def corpus():
    rnd = random.Random(11)
    syllables = ["tion", "the", "er", "an", "in", "re", "on", "ha", "st", "ou"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    base = [" ".join(word() for _ in range(rnd.randint(4, 60))) for _ in range(60)]
    out = []
    for line in base:
        for _ in range(rnd.randint(1, 5)):
            w = line.split(" ")
            for _ in range(rnd.choice([0, 0, 1, 1, 3])):
                w[rnd.randrange(len(w))] = word()
            out.append(rnd.choice([" ".join(w), " ".join(w).upper(), "  " + " ".join(w)]))
    rnd.shuffle(out)
    docs = [(i, "\n".join(out[i * 4 : i * 4 + 4] + ["", "short"]), "x") for i in range(len(out) // 4)]
    return docs


def test_classes_against_all_pairs(spark):
    docs = corpus()
    flat = [(d, no, lines.normal(x)) for d, t, _ in docs for no, x in enumerate(t.split("\n"))]
    long = [f for f in flat if len(f[2]) >= lines.LEAST_CHARS]
    links = [(i, j) for i in range(len(long)) for j in range(i) if lines.jaccard(long[i][2], long[j][2]) >= 0.8]
    want = groups(len(long), links)
    df = edge.with_clashes(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    found = {(r["doc_id"], r["line_no"]): r for r in lines.line_classes(df).collect()}
    assert len(found) == len(flat)
    got = [found[f[0], f[1]]["class_id"] for f in long]
    missed = sum(got[i] != got[j] for i, j in links)
    assert links and missed <= 0.02 * len(links)
    for c in set(got):
        assert len({want[i] for i in range(len(long)) if got[i] == c}) == 1
        mine = [long[i][:2] for i in range(len(long)) if got[i] == c]
        assert [p for p in mine if found[p]["keep"]] == [min(mine)]
    assert all(r["keep"] and r["class_id"] is None for p, r in found.items() if p not in {f[:2] for f in long})


def test_crowd_of_one_template_lists_no_pairs(spark, monkeypatch):
    rnd = random.Random(3)
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)).strip()
    head = "this page was printed from the archive of the society of friends of old railways, see "
    texts = [head * 2 + letters(45) for _ in range(300)]
    texts += [t[:-1] + "#" for t in texts[:40]]
    tried = []
    plain = linking._try

    def counted(pairs, tested, links, verify):
        plain(pairs, tested, links, verify)
        tried.append(tested[-1].count())

    monkeypatch.setattr(linking, "_try", counted)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in lines.line_classes(docs).collect()}
    flat = [lines.normal(t) for t in texts]
    links = [(i, j) for i in range(len(flat)) for j in range(i) if lines.jaccard(flat[i], flat[j]) >= 0.8]
    want = groups(len(flat), links)
    assert len(links) >= 40
    assert sum(found[i] != found[j] for i, j in links) <= 0.02 * len(links)
    for c in set(found.values()):
        assert len({want[i] for i in found if found[i] == c}) == 1
    # Pivots meet every line in each bucket; what is left meets by rare shingles.
    assert tried[-1] <= 3 * len(texts) < len(texts) ** 2 / 20


def test_finer_buckets_lose_no_link(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 6)))
    texts = []
    for _ in range(30):
        base = [word() for _ in range(rnd.randint(6, 40))]
        for _ in range(4):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts = sorted({t for t in texts if len(t) >= lines.SHINGLE})
    minima = lines.signatures(texts)[:, lines.BANDS :].tolist()
    one = [(i, t, *m) for i, (t, m) in enumerate(zip(texts, minima, strict=True))]
    table = spark.createDataFrame(one, "key long, line string, m0 long, m1 long")
    active = spark.createDataFrame([(7, i, i) for i in range(len(texts))], "bucket long, node long, own long")
    members, close = lines.finer(active, table.select("key", "line"), table.select("key", "m0", "m1"))
    met = {(r["node"], r["pivot"]) for r in linking._each(members, close).collect()}
    linked = {(i, j) for i in range(len(texts)) for j in range(i) if lines.jaccard(texts[i], texts[j]) >= 0.8}
    few = {(i, j) for i, j in linked if agreeing(minima[i], minima[j]) < lines.LEAST_EQUAL}
    assert linked and len(few) <= 0.02 * len(linked)
    assert linked - few <= met
    assert len(met) < len(texts) ** 2 / 4


def agreeing(a, b):
    return sum((x >> 5 * i) & 31 == (y >> 5 * i) & 31 for x, y in zip(a, b, strict=True) for i in range(12))


def test_texts_keep_first_lines(spark):
    line = "a passage that many documents of this corpus share with each other"
    docs = [(2, f"{line}\nown line of the second document, long enough\n\nend"), (1, f"top of the first document here\n{line}"), (3, line)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in lines.dedup(df).collect()}
    assert found[1] == docs[1][1]
    assert found[2] == "own line of the second document, long enough\n\nend"
    assert found[3] == ""


def test_short_lines_have_classes(spark):
    docs = [(1, "Menu\nLog in\n \nx\nRead more here"), (2, " menu\nlog  in\n\nX\nread more her\ny"), (3, "Menu\nread More here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["doc_id"], r["line_no"]): r for r in lines.line_classes(df).collect()}
    assert {p for p, r in found.items() if r["class_id"] is None} == {(1, 2), (2, 2)}
    same = [[(1, 0), (2, 0), (3, 0)], [(1, 1), (2, 1)], [(1, 3), (2, 3)], [(1, 4), (2, 4), (3, 1)], [(2, 5)]]
    for places in same:
        assert len({found[p]["class_id"] for p in places}) == 1
        assert [found[p]["keep"] for p in places] == [True] + [False] * (len(places) - 1)
    assert len({found[places[0]]["class_id"] for places in same}) == len(same)
    texts = {r["doc_id"]: r["text"] for r in lines.dedup(df).collect()}
    assert texts == {1: docs[0][1], 2: "\ny", 3: ""}


def test_edge_rows(spark):
    docs = edge.docs(spark)
    found = lines.dedup(docs)
    assert found.columns == docs.columns
    rows = found.collect()
    assert len(rows) == len(edge.rows())
    assert sum(r["text"] is None for r in rows) == 2
    assert lines.dedup(edge.empty(spark)).count() == 0
    assert lines.line_classes(edge.empty(spark)).count() == 0


def test_signatures_don_t_depend_on_company():
    some = [lines.normal(t) for _, t, _ in corpus()[:20]] + ["tiny", "é" * 30]
    together = lines.signatures(some)
    for i, line in enumerate(some):
        assert (lines.signatures([line])[0] == together[i]).all()


def test_only_candidates_move(spark, monkeypatch):
    """Lines without a partner leave no text and no pair in the shared folder, and a line in
    several crowded buckets is spelt once."""
    rnd = random.Random(21)
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)).strip()
    twins = [letters(120) for _ in range(20)]
    texts = twins + [t[:-1] + "#" for t in twins] + [letters(8) + "y" + t[:60] + letters(60) for t in twins for _ in range(10)]
    rows = {}
    plain = common.stored

    def counted(df, purpose):
        out = plain(df, purpose)
        rows.setdefault(purpose, []).append(out.count())
        return out

    monkeypatch.setattr(common, "stored", counted)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in lines.line_classes(docs).collect()}
    assert all(found[i] == found[i + 20] for i in range(20))
    assert 40 <= rows["texts"][0] <= 60
    one = [(i, t, *m) for i, (t, m) in enumerate(zip(twins, lines.signatures(twins)[:, lines.BANDS :].tolist(), strict=True))]
    table = spark.createDataFrame(one, "key long, line string, m0 long, m1 long")
    sizes = []
    for buckets in (1, 5):
        active = spark.createDataFrame([(b, i, i) for b in range(buckets) for i in range(20)], "bucket long, node long, own long")
        sizes.append(lines.finer(active, table.select("key", "line"), table.select("key", "m0", "m1"))[0].count())
    assert sizes[0] == sizes[1]


def test_shared_buckets_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(lines, "FEW", 4)
    rnd = random.Random(4)
    size = lines.BAND_BYTES
    rows = [(k - 90, b"".join(rnd.choice([1, 2, 3, rnd.randrange(1 << 35)]).to_bytes(size, "little") for _ in range(lines.BANDS))) for k in range(60)]
    rows += [(200 + k, b"".join((1000 * b + k // 3).to_bytes(size, "little") for b in range(lines.BANDS))) for k in range(30)]
    of = {}
    for key, bands in rows:
        for i in range(lines.BANDS):
            of.setdefault(int.from_bytes(bands[i * size : i * size + size], "little"), set()).add(key)
    df = spark.createDataFrame(rows + rows[:20], "key long, bands binary")
    got = {(r["bucket"], r["a"], r["b"]) for r in lines.shared_buckets(df, 3).collect()}
    pairs = {(b, x, y) for b, keys in of.items() if len(keys) <= 4 for x in keys for y in keys if x < y}
    crowds = {(b, x, None) for b, keys in of.items() if len(keys) > 4 for x in keys}
    assert pairs and crowds and got == pairs | crowds


def test_lines_that_meet_by_chance_go_where_they_meet(spark):
    """A large bucket of unlike lines lists its alike pairs and no members; one of many alike
    lines lists its members and no pairs; parts of the bands give together what all give."""
    rnd = random.Random(13)
    minima = lambda: [rnd.randrange(1 << 60) for _ in range(2)]
    size, rows = lines.BAND_BYTES, []
    own = lambda k: [(100_000 + k * lines.BANDS + b).to_bytes(size, "little") for b in range(lines.BANDS)]
    common_bits = minima()
    for k in range(120):
        bands = own(k)
        bands[0 if k < 80 else 5] = (7 if k < 80 else 8).to_bytes(size, "little")
        m = minima() if k < 80 else common_bits
        rows.append((k, b"".join(bands), *(rows[-1][2:] if k in (11, 51) else m)))
    df = spark.createDataFrame(rows, "key long, bands binary, m0 long, m1 long")
    whole = {tuple(r) for r in lines.shared_buckets(df, 3).collect()}
    alike = {(7, x, y) for x in range(80) for y in range(x + 1, 80) if agreeing(rows[x][2:], rows[y][2:]) >= lines.LEAST_EQUAL}
    assert {(7, 10, 11), (7, 50, 51)} <= alike and len(alike) < 80
    assert whole == alike | {(8, k, None) for k in range(80, 120)}
    parts = [lines.shared_buckets(df, 3, range(i, i + 4)) for i in (0, 4)]
    assert {tuple(r) for p in parts for r in p.collect()} == whole


def test_pairs_that_go_early_are_not_similar():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 6)))
    a, b = ["a" * 40, "ab" * 2500, "tiny", "x" * 7, "abcabcabc" * 30], ["a" * 90, "ab" * 2500 + "c", "tiny", "x" * 8, "abcabcabd" * 30]
    for _ in range(300):
        w = [word() for _ in range(rnd.randint(3, 60))]
        a.append(" ".join(w).ljust(lines.SHINGLE, "-"))
        for _ in range(rnd.randint(0, 8)):
            w[rnd.randrange(len(w))] = word()
        b.append(" ".join(w).ljust(lines.SHINGLE, "-"))
    similar = [lines.are_similar(lines.shingle_set(x), lines.shingle_set(y)) for x, y in zip(a, b, strict=True)]
    place = np.arange(len(a))
    may = lines.may_be_similar(place, place + len(a), lines.cells_of(a + b))
    assert all(may[similar]) and sum(may) < (sum(similar) + len(a)) / 2
    got = pd.concat(lines._similar.func(iter([(pd.Series(a), pd.Series(b))])))
    assert got.tolist() == similar


def test_tables_of_a_stage_leave_nothing_shuffled(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    moved = lambda: sum(f.stat().st_size for d in folders for f in pathlib.Path(d).rglob("shuffle_*.data"))
    rows = spark.range(5000).selectExpr("id % 50 AS k", "sha2(cast(id AS string), 256) AS t").groupBy("k").agg(F.collect_set("t").alias("ts"))
    before = moved()
    kept = common.stored(rows, "test")
    deadline = time.time() + 20
    while moved() > before and time.time() < deadline:  # Executors remove files by themselves.
        time.sleep(0.2)
    assert moved() <= before and kept.count() == 50
    before = moved()
    rows.collect()
    assert moved() > before
