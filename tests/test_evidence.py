"""Frames, vectors, detectors, regions, audit, datasets, metrics, files, streams."""

import hashlib
import json
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from idsift.functions import vectors
from idsift.operators import audit, datasets, evaluation, faces, forensics, imaging, ranks, risk, sequences
from idsift.sources import readers, reports
from idsift.streaming import jobs

# ---------------------------------------------------------------------- frames
FRAME = "seq_id int, idx int, timestamp_ms double, face_count int, eyes_visible int, quality_ok boolean, same_face_as_first boolean, texture_contrast double, periodic_energy_ratio double, digest string"


def frames(spark, cases):
    rows = []
    for seq, (eyes, times, changes) in enumerate(cases):
        for i, (e, t) in enumerate(zip(eyes, times, strict=True)):
            row = dict(fc=1, q=True, same=True, contrast=20.0, periodic=0.1, digest=f"{seq}-{i}")
            row.update(changes.get(i, changes.get("all", {})))
            rows.append((seq, i, t, row["fc"], e, row["q"], row["same"], row["contrast"], row["periodic"], row["digest"]))
    return spark.createDataFrame(rows, FRAME)


def steady(n):
    return [100.0 * i for i in range(n)]


def test_blink_patterns(spark):
    cases = [
        ([2, 2, 0, 2, 2], steady(5), {}), ([2, 2, 2, 2, 2], steady(5), {}), ([2, 2, 1, 2, 2], steady(5), {}),
        ([0, 0, 2, 2, 2], steady(5), {}), ([2, 2, 0, 2, 2], steady(5), {2: {"same": False}}),
        ([2, 2, 0, 2, 2], [0.0, 100.0, 200.0, 300.0, 2000.0], {}), ([2, 2, 0, 0, 0, 2, 2], steady(7), {}),
        ([2, 2, 0, 0, 2], steady(5), {}), ([2, 2, 0, 2, 2], [0.0, 100.0, 200.0, 250.0, 300.0], {}),
    ]
    rows = sequences.outcome(frames(spark, cases)).collect()
    got = {r.seq_id: r.blink_candidate for r in rows}
    assert [got[i] for i in range(9)] == [True, False, False, False, False, False, True, False, False]


@pytest.mark.parametrize("times", [[0.0, 0.0], [1.0, 0.0], [0.0, float("nan")], [0.0, 25000.0], [-1.0, 5.0], steady(13)])
def test_invalid_sequences(spark, times):
    r = sequences.outcome(frames(spark, [([2] * len(times), times, {})])).first()
    assert r.reason is not None and r.liveness_status is None and r.spoof_score is None


def test_sequence_outcomes(spark):
    cases = [
        ([2] * 5, steady(5), {"all": {"digest": "same"}}), ([2] * 5, steady(5), {}), ([2], [0.0], {}),
        ([2] * 3, steady(3), {1: {"fc": 2}}), ([2] * 3, steady(3), {1: {"contrast": 1.0}}),
    ]
    rows = {r.seq_id: r for r in sequences.outcome(frames(spark, cases)).collect()}
    assert rows[0].repeated_frames == 4 and rows[0].spoof_score == 1.0 and rows[0].liveness_verdict == "suspicious"
    assert rows[1].liveness_status == "ok" and rows[1].liveness_codes == ["LIVENESS_NOT_VERIFIED"]
    assert rows[2].liveness_status == rows[3].liveness_status == "insufficient_evidence"
    assert "LIVENESS_FACE_EVIDENCE_MISSING" in rows[3].liveness_codes and rows[4].spoof_score == 0.5


# --------------------------------------------------------------------- vectors
def test_cosine(spark):
    nan, inf = float("nan"), float("inf")
    pairs = [([1.0, 2.0], [3.0, 6.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([], []), ([0.0, 0.0], [1.0, 0.0]),
             ([nan, 1.0], [1.0, 0.0]), ([inf, 1.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])]
    df = spark.createDataFrame(pairs, "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == pytest.approx([1, -1, 0]) and got[3:] == [None] * 5


@pytest.mark.parametrize("threshold", [0.2, 0.9])
def test_block_search_equals_brute_force(spark, monkeypatch, threshold):
    # A third of the gallery are copies of one vector; blocks are small.
    monkeypatch.setattr(faces, "GALLERY_BLOCK", 16)
    monkeypatch.setattr(faces, "QUERY_BLOCK", 32)
    monkeypatch.setattr(faces, "PIVOTS", 5)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 12))
    data = centres[rng.integers(0, 8, 300)] + 0.2 * rng.normal(size=(300, 12))
    data[::3] = data[0]
    labels = rng.integers(0, 4, 300)
    rows = [(i, [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(data, labels, strict=True))]
    rows.append((999, [0.0] * 12, 0))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    refs, probes = df.filter(F.col("vec_id") < 200), df.filter(F.col("vec_id") >= 150)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    scores = unit[150:] @ unit[:200].T
    want = {}
    for q, row in enumerate(scores):
        if row.max() >= threshold:
            want[150 + q] = round(row.max(), 9)
    got = {r.query_id: (r.match_id, round(r.similarity, 9)) for r in faces.nearest(probes, refs, threshold).collect()}
    assert {k: v[1] for k, v in got.items()} == want
    rates = {r.threshold: r for r in faces.grid_error_rates(refs, probes, [threshold, 0.95]).collect()}
    same = labels[150:, None] == labels[None, :200]
    for t, r in rates.items():
        hit = scores >= t - 1e-12
        assert (r.tp, r.fp, r.fn, r.tn) == ((hit & same).sum(), (hit & ~same).sum(), (~hit & same).sum(), (~hit & ~same).sum())


# ------------------------------------------------------------------- forensics
def test_rollup(spark):
    scores = {"metadata": 1.0, "cnn": 1.0, "noise_splicing": 0.2, "photo_replacement": 0.1, "copy_move": 0.0, "font_inconsistency": 0.0}
    df = spark.createDataFrame([(1, n, "ok", s) for n, s in scores.items()], "doc_id int, name string, status string, score double")
    r = forensics.rollup(df).first()
    assert (r.spatial, r.spatial_complete, r.metadata, r.metadata_complete) == (0.2, True, 1.0, False)
    assert forensics.suspicion(df).first().suspicion_score == 1.0
    assert {f.code for f in forensics.detector_findings(df).collect()} == {"TAMPER_METADATA", "TAMPER_CNN"}


def test_metadata_score(spark):
    exif = spark.createDataFrame(
        [(1, 305, "Adobe Photoshop"), (1, 306, "2020:01:01 00:00:00"), (1, 36867, "2021:01:01 00:00:00"), (2, 36867, "2021:01:01 00:00:00")],
        "doc_id int, tag int, value string",
    )
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    got = {r.doc_id: (r.status, r.score) for r in forensics.metadata_score(exif, docs).collect()}
    assert got == {1: ("ok", 1.0), 2: ("ok", 0.0), 3: ("insufficient_evidence", None)}


def test_one_region(spark):
    cells = spark.createDataFrame([(1, x, y, 1.0) for y in range(20, 50) for x in range(100, 150)], "image_id bigint, x int, y int, v double")
    for tile in (7, 64, 256):
        r = forensics.regions(cells, 200, 100, tile=tile).collect()
        assert [(a.x, a.y, a.w, a.h) for a in r] == [(0.5, 0.2, 0.25, 0.3)]


def brute_regions(grid):
    h, w = grid.shape
    seen, out = set(), []
    for sy, sx in zip(*np.nonzero(grid), strict=True):
        if (sy, sx) in seen:
            continue
        todo, part = [(sy, sx)], []
        seen.add((sy, sx))
        while todo:
            y, x = todo.pop()
            part.append((x, y))
            for ny in range(max(0, y - 1), min(h, y + 2)):
                for nx in range(max(0, x - 1), min(w, x + 2)):
                    if grid[ny, nx] and (ny, nx) not in seen:
                        seen.add((ny, nx))
                        todo.append((ny, nx))
        xs, ys = [p[0] for p in part], [p[1] for p in part]
        if len(part) >= max(12, h * w * 0.001):
            out.append((len(part), min(xs) / w, min(ys) / h, (max(xs) - min(xs) + 1) / w, (max(ys) - min(ys) + 1) / h))
    return sorted(out, reverse=True)[:12]


def test_regions_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for image in range(6):
        grid = rng.random((50, 70)) < 0.18 + 0.05 * image
        want[image] = brute_regions(grid)
        rows += [(image, int(x), int(y), 0.8) for y, x in zip(*np.nonzero(grid), strict=True)]
    cells = spark.createDataFrame(rows, "image_id bigint, x int, y int, v double")
    for tile in (8, 33):
        got = {i: [] for i in want}
        for r in forensics.regions(cells, 70, 50, tile=tile).orderBy("image_id", "rank").collect():
            got[r.image_id].append((r.area, r.x, r.y, r.w, r.h))
        assert {k: [tuple(map(float, b)) for b in v] for k, v in got.items()} == {
            k: [tuple(map(float, b)) for b in v] for k, v in want.items()
        }


def test_copy_move_equals_brute_force(spark):
    # Random descriptors, near copies at a fixed shift and a large group of equal ones.
    rng = np.random.default_rng(2)
    words = [[int(x) for x in rng.integers(-(2**63), 2**63 - 1, 4)] for _ in range(30)]
    points = []
    for i in range(120):
        w = list(words[i % 30]) if i < 90 else list(words[0])
        for _ in range(int(rng.integers(0, 14))):
            k, bit = int(rng.integers(0, 4)), int(rng.integers(0, 64))
            w[k] ^= (1 << bit) if bit < 63 else -(2**63)
        points.append((1, i, float(i % 30 * 3 + 100 * (i // 30)), float(i % 7), *w))
    df = spark.createDataFrame(points, "image_id bigint, idx int, px double, py double, w0 bigint, w1 bigint, w2 bigint, w3 bigint")
    groups: dict = {}
    for q in points:
        near = sorted((sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(q[4:], t[4:], strict=True)), t[1], t) for t in points)[:5]
        for d, _, t in near:
            dx, dy = t[2] - q[2], t[3] - q[3]
            if q[1] < t[1] and d <= 24 and math.hypot(dx, dy) >= 30:
                key = (round(dx / 12), round(dy / 12))
                groups[key] = groups.get(key, 0) + 1
    want = {k: n for k, n in groups.items() if n >= 4}
    assert want and {(r.kx, r.ky): r.pairs for r in forensics.copy_move(df).collect()} == want


def test_order_statistics_with_a_hot_group(spark):
    rng = np.random.default_rng(3)
    values = {"hot": rng.exponential(100, 3000), "flat": np.full(50, 7.0), "neg": rng.normal(0, 5, 400), "one": np.array([3.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in ranks.quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}).collect()}
    top = {r.k: r.top_mean for r in ranks.top_fraction_mean(df, ["k"], "v", 0.01).collect()}
    for k, vs in values.items():
        assert (got[k].a, got[k].b, got[k].c, got[k].d) == pytest.approx(tuple(np.percentile(vs, [50, 95, 0, 100])))
        assert top[k] == pytest.approx(np.sort(vs)[-max(1, int(len(vs) * 0.01)):].mean())


# ----------------------------------------------------------------------- audit
EVENT = "chain_id bigint, ord int, event_id string, request_id string, fingerprint string, scan_id string, kind string, timestamp string, actor string, document_hash string, payload_json string"


def new_events(spark, n, chain=1):
    payload = json.dumps({"processing_status": "insufficient_evidence", "risk": {"missing_required_signals": ["liveness"]}, "note": 'é "q"'}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    rows = [(chain, i, f"e{i}", f"r{i}", f"f{i}", f"s{i}", "scan", "2026-10-03T00:00:00.000000+00:00", "REVIEWER", "a" * 64, payload) for i in range(n)]
    return spark.createDataFrame(rows, EVENT)


def no_head(spark):
    return spark.createDataFrame([], "chain_id bigint, seq bigint, event_hash string")


def test_append_equals_serial_hashing(spark):
    new = new_events(spark, 5)
    rows = audit.append(no_head(spark), new, ["ord"]).orderBy("seq").collect()
    last = audit.ZERO_HASH
    for i, (r, raw) in enumerate(zip(rows, new.orderBy("ord").collect(), strict=True)):
        body = {k: v for k, v in raw.asDict().items() if k not in ("chain_id", "ord")} | {"seq": i + 1, "previous_hash": last}
        text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r.previous_hash == last and r.seq == i + 1
        last = hashlib.sha256(text.encode()).hexdigest()
        assert r.event_hash == last


def judge(spark, events, head, anchor=None):
    anchors = spark.createDataFrame([anchor], "chain_id bigint, seq bigint, event_hash string") if anchor else None
    r = audit.verify(events, head, anchors).first()
    return r.valid, r.error, r.failed_seq


def test_verify(spark):
    empty = spark.createDataFrame([], audit.EVENT_SCHEMA)
    head0 = spark.createDataFrame([(1, 0, audit.ZERO_HASH)], "chain_id bigint, seq bigint, event_hash string")
    assert judge(spark, empty, head0) == (True, None, None)
    assert judge(spark, empty, head0, (1, 0, "0" * 64)) == (True, None, None)
    assert judge(spark, empty, head0, (1, 1, "1" * 64)) == (False, "TRUSTED_ANCHOR_MISMATCH", 1)
    events = audit.append(no_head(spark), new_events(spark, 4), ["ord"]).cache()
    head = audit.new_head(no_head(spark), events).cache()
    second = events.filter("seq = 2").first()
    assert judge(spark, events, head, (1, 2, second.event_hash)) == (True, None, None)
    edited = events.withColumn("payload_json", F.when(F.col("seq") == 3, "{}").otherwise(F.col("payload_json")))
    assert judge(spark, edited, head) == (False, "EVENT_CHAIN_MISMATCH", 3)
    assert judge(spark, events.filter("seq < 4"), head) == (False, "HEAD_MISMATCH", 4)
    assert judge(spark, events.filter("seq <> 2"), head) == (False, "EVENT_CHAIN_MISMATCH", 2)
    assert judge(spark, events.filter("seq <> 1"), head) == (False, "EVENT_CHAIN_MISMATCH", 1)
    short = events.filter("seq < 4")
    rewritten = audit.new_head(no_head(spark), short)
    assert judge(spark, short, rewritten) == (True, None, None)
    assert judge(spark, short, rewritten, (1, 4, "f" * 64)) == (False, "TRUSTED_ANCHOR_MISMATCH", 4)
    unreadable = new_events(spark, 2).withColumn("payload_json", F.lit("{broken"))
    events = audit.append(no_head(spark), unreadable, ["ord"])
    assert judge(spark, events, audit.new_head(no_head(spark), events)) == (False, "INVALID_PAYLOAD", 1)


def test_replay(spark):
    events = audit.append(no_head(spark), new_events(spark, 2), ["ord"])
    batch = spark.createDataFrame(
        [(0, "r0", "f0", "x"), (1, "r1", "other", "y"), (2, "r9", "a", "z"), (3, "r9", "a", "w"), (4, "r9", "b", "v")],
        "ord int, request_id string, fingerprint string, event_id string",
    )
    got = {r.ord: (r.status, r.stored_event_id) for r in audit.dedupe(events, batch, "ord").collect()}
    assert got == {0: ("replay", "e0"), 1: ("conflict", None), 2: ("new", None), 3: ("replay", "z"), 4: ("conflict", None)}


def test_decisions(spark):
    events = audit.append(no_head(spark), new_events(spark, 2), ["ord"]).cache()
    good = events.filter("scan_id = 's0'").first().event_hash
    rows = [
        (0, "s0", "approve", False, good, "d0"), (1, "s0", "reject", False, "0" * 64, "d1"), (2, "s0", "approve", True, good, "d2"),
        (3, "s0", "reject", False, good, "d3"), (4, "s0", "approve", True, good, "d2"), (5, "s9", "reject", False, good, "d5"), (6, "s1", "reject", False, good, "r1"),
    ]
    batch = spark.createDataFrame(rows, "ord int, scan_id string, decision string, acknowledge_incomplete boolean, expected_event_hash string, request_id string").withColumn("note", F.lit("n")).withColumn("actor", F.lit("A"))
    got = {r.ord: r.status for r in audit.accept(events, batch).collect()}
    assert got == {0: "incomplete", 1: "stale", 2: "accepted", 3: "stale", 4: "replay", 5: "not_found", 6: "conflict"}


def test_history(spark):
    events = audit.append(no_head(spark), new_events(spark, 5), ["ord"])
    page, total = audit.history(events, "REVIEW", "pending", 2, 1)
    assert [r.scan_id for r in page.collect()] == ["s3", "s2"] and total.first().total == 5
    assert audit.history(events, "", "approve")[1].first().total == 0
    assert [r.event_id for r in audit.scan_detail(events, "s1").collect()] == ["e1"]
    with pytest.raises(ValueError):
        audit.history(events, limit=101)


# --------------------------------------------------------- datasets and metrics
def test_split_and_leaks(spark):
    rows = [("g1", "same", None), ("g2", "same", "test"), ("g1", "x", "val"), ("g3", "y", None)]
    df = datasets.assign_split(spark.createDataFrame(rows, "grp string, content string, split string"))
    for r in df.collect():
        tenth = int(hashlib.sha256(r.grp.encode()).hexdigest()[:8], 16) % 10
        assert r.split in ("test", "val") or r.split == ("train" if tenth < 7 else "val" if tenth < 9 else "test")
    leaked = {r.grp for r in datasets.group_leakage(df).collect()}
    by_group = {}
    for r in df.collect():
        by_group.setdefault(r.grp, set()).add(r.split)
    assert leaked == {g for g, s in by_group.items() if len(s) > 1}


def test_labels(spark):
    rows = [("g", "train", "copy_move", None, None), ("g", "train", "clean", None, True), ("g", "train", "clean", None, False), ("g", "train", "clean", True, None), (" ", "odd", "copy_move", True, None)]
    df = spark.createDataFrame(rows, "grp string, split string, attack string, mask_nonempty boolean, verified_clean boolean")
    got = [r.problems for r in datasets.check_labels(df).collect()]
    assert got == [["unknown_is_not_clean"], [], ["unknown_is_not_clean"], ["label_disagrees_with_mask"], ["blank_group", "unknown_split"]]


def test_metrics(spark):
    df = spark.createDataFrame([(True, True, 0.9), (True, False, 0.5), (False, True, 0.9), (False, False, 0.1)], "t boolean, p boolean, s double")
    r = evaluation.binary(df, "t", "p").first()
    assert (r.tn, r.fp, r.fn, r.tp) == (1, 1, 1, 1) and r.precision == r.recall == r.f1 == 0.5
    r = evaluation.binary(df.limit(0), "t", "p").first()
    assert r.n == 0 and r.precision is None and r.false_positive_rate is None
    points = evaluation.roc(df, "t", "s").orderBy(F.desc_nulls_first("threshold")).collect()
    assert [tuple(p) for p in points] == [(None, 0, 0), (0.9, 0.5, 0.5), (0.5, 0.5, 1), (0.1, 1, 1)]
    assert evaluation.roc(df.filter("t"), "t", "s").count() == 0
    cells = spark.createDataFrame([(1, True, False), (1, True, True), (1, False, True), (2, False, False)], "i int, a boolean, b boolean")
    got = {r.i: r.iou for r in evaluation.iou(cells, F.col("a"), F.col("b"), ["i"]).collect()}
    assert got == {1: pytest.approx(1 / 3), 2: None}
    times = spark.createDataFrame([("x", v) for v in (100.0, 200.0, 300.0, -1.0, float("nan"), None)], "k string, v double")
    good, bad = evaluation.latency(times, "v", ["k"])
    r = good.first()
    assert (r.n, r.median_ms, r.p95_ms, r.min_ms, r.max_ms, bad.count()) == (3, 200, pytest.approx(290), 100, 300, 3)


# ----------------------------------------------------------------------- files
def png(pixels: np.ndarray) -> bytes:
    """RGB image file."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_documents_and_images(spark, tmp_path):
    rng = np.random.default_rng(5)
    pixels = rng.integers(0, 256, (20, 30, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(pixels))
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n broken")
    (tmp_path / "c.bin").write_bytes(b"text")
    (tmp_path / "e.webp").write_bytes(b"RIFF0000WEBP....")
    good, bad = readers.read_documents(spark, str(tmp_path))
    name = lambda p: p.rsplit("/", 1)[1]
    hashes = {name(r.path): r.document_hash for r in good.collect()}
    assert set(hashes) == {"a.png", "b.png", "e.webp"}
    assert hashes["a.png"] == hashlib.sha256(png(pixels)).hexdigest()
    assert {name(r.path): r.reason for r in bad.collect()} == {"c.bin": "unsupported_type"}
    empty = spark.createDataFrame([(b"",), (None,), (b"x" * 50,)], "content binary")
    assert [r.reason for r in readers.judge_payloads(empty, 40).collect()] == ["empty", "empty", "too_large"]
    images, refused = readers.read_images(spark, str(tmp_path))
    row = imaging.features(images).first()
    grey = np.rint(pixels @ np.array([0.299, 0.587, 0.114]))
    p = np.pad(grey, 1, mode="reflect")
    lap = [[p[y - 1, x] + p[y + 1, x] + p[y, x - 1] + p[y, x + 1] - 4 * p[y, x] for x in range(1, 31)] for y in range(1, 21)]
    assert (row.width, row.height) == (30, 20)
    assert row.laplacian_variance == pytest.approx(np.var(lap), abs=1e-3) and row.brightness == pytest.approx(grey.mean(), abs=1e-3)
    assert {name(r.doc_id): r.reason for r in refused.collect()}["e.webp"] == "unsupported"
    digests = readers.file_digests(spark, str(tmp_path))
    listed = digests.filter("name <> 'c.bin'").unionByName(spark.createDataFrame([("gone", 1, "x")], digests.schema))
    status = {r.name: r.status for r in readers.verify_integrity(digests, listed.withColumn("size", F.when(F.col("name") == "a.png", 1).otherwise(F.col("size")))).collect()}
    assert status["gone"] == "unavailable" and status["a.png"] == "mismatch" and status["b.png"] == "ok"


def test_words_and_manifest(spark, tmp_path):
    (tmp_path / "w.tsv").write_text(
        "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
        '5\t1\t1\t1\t1\t1\t0\t0\t1\t1\t96.5\t"P<UTO\n5\t1\t1\t1\t1\t2\t0\t0\t1\t1\t-1\t \n'
    )
    rows = readers.read_ocr_words(spark, str(tmp_path / "w.tsv")).collect()
    assert [(r.text, r.conf) for r in rows] == [('"P<UTO', 96.5)]
    items = [{"image": "a.png", "group": "g", "attack": "clean", "verified_clean": True}, {"image": "../b.png", "group": "g", "attack": "x"}, {"image": "a.png", "mask": "/etc/m.png", "group": "g", "attack": "x"}]
    (tmp_path / "m.json").write_text(json.dumps(items))
    good, bad = readers.read_manifest(spark, str(tmp_path / "m.json"), "/data/root")
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["image_outside_root", "mask_outside_root"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "n int")
    for name, protocol in (("a", {"v": 1}), ("b", {"v": 1}), ("c", {"v": 2})):
        reports.write(df, str(tmp_path / name), reports.provenance(protocol, {"t": {"x": 1}}))
    read = [spark.read.parquet(str(tmp_path / n)) for n in "abc"]
    assert reports.same_protocol(read[:2]) and not reports.same_protocol(read)
    assert {"protocol_sha256", "t_sha256", "generated_at"} <= set(read[0].columns)


# --------------------------------------------------------------------- streams
def test_append_stream_replays_a_batch(spark, tmp_path):
    write = jobs.appender(spark, str(tmp_path), ["ord"])
    new = new_events(spark, 6)
    first, second = new.filter("ord < 3"), new.filter("ord >= 3")
    write(first, 0)
    write(second, 1)
    write(second, 1)
    got = jobs.read_log(spark, str(tmp_path)).orderBy("seq").collect()
    want = audit.append(no_head(spark), new, ["ord"]).orderBy("seq").collect()
    assert [r.event_hash for r in got] == [r.event_hash for r in want]


def test_signals_of_layers(spark):
    face = spark.createDataFrame(
        [(1, "ok", 0.4, 0.6, 1, 1), (2, "ok", 0.9, 0.6, 1, 1), (3, "insufficient_evidence", None, 0.6, 0, 1)],
        "doc_id int, face_status string, cosine_similarity double, threshold double, document_face_count int, live_face_count int",
    )
    got = {r.doc_id: (r.s_face.value, r.s_face.complete) for r in risk.face_signal(face).collect()}
    assert got == {1: (1.0, True), 2: (0.0, True)}


def test_tiles_are_labelled_a_batch_at_a_time():
    # 4 000 tiles of one cell and one of 256, cut anywhere by batches; images may be unknown.
    rows = [(None if t % 1000 == 7 else t // 16, t % 16, 0, 3, t % 16 * 16 + 5) for t in range(4000)]
    rows += [(9999, 0, 0, y, x) for y in range(16) for x in range(16)]
    rows.sort(key=lambda r: (r[0] is not None, r))
    names = ["image_id", "_tx", "_ty", "y", "x"]
    for step in (1000, 4256, 333):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + step], strict=True)], names=names) for k in range(0, len(rows), step)]
        out = list(forensics._tile_components(16, 256)(iter(batches)))
        assert len(out) <= len(batches) + 1
        got = pa.Table.from_batches(out).to_pylist()
        assert len(got) == 4001 and sum(g["image_id"] is None for g in got) == 4
        assert [(g["comp"], g["area"], g["max_x"], g["max_y"], len(g["rim_x"])) for g in got if g["image_id"] == 9999] == [(0, 256, 15, 15, 60)]
        assert {(g["comp"], g["area"], len(g["rim_x"])) for g in got if g["image_id"] == 3} == {(3 * 256 + t * 16 + 5, 1, 0) for t in range(16)}


def test_glyphs_are_compared_across_tiles_and_without_pairs(spark):
    # Positions around tile edges, halves and negative ones, repeated glyphs, an unknown image and a crowd at one place.
    rng = np.random.default_rng(5)
    rows = [(int(i), float(rng.integers(-500, 4200)) / 2, float(rng.integers(60, 100)) / 2 - 0.5, int(rng.integers(3, 38)), int(rng.integers(1, 32))) for i in rng.integers(0, 3, 900)]
    rows += [(0, 960.0, 40.0, 10, 5)] * 300 + [(None, 1.0, 1.0, 30, 5)] * 9 + [(2, 1079.5, 44.5, 36, 9)] * 2
    glyphs = spark.createDataFrame(rows, "image_id long, cx double, cy double, h int, w int")
    kept = [r for r in rows if r[0] is not None and 4 <= r[3] <= 36 and 2 <= r[4] <= 30]
    want = {}
    for i, x, y, h, _ in kept:
        around = [b[3] for b in kept if b[0] == i and abs(b[1] - x) < 120 and abs(b[2] - y) < 5]
        typical = float(np.median(around))
        if len(around) >= 6 and abs(h - typical) / max(typical, 1) > 0.6:
            n = sum(b[:4] == (i, x, y, h) for b in kept)
            want[i, x, y, h] = (n, len(around), typical, min(1.0, abs(h - typical) / max(typical, 1)))
    result = forensics.font_outliers(glyphs)
    got = {tuple(r)[:4]: tuple(r)[4:] for r in result.collect()}
    assert len(want) > 50 and got == want
    assert "Join" not in result._jdf.queryExecution().optimizedPlan().toString()


def test_detector_rows_are_made_by_many_tasks(spark, sf_dir, monkeypatch):
    from idsift.plans import views

    monkeypatch.setattr(views, "ROWS_PER_TASK", 50)
    rows = views.detectors(spark, sf_dir)
    assert rows.groupBy("doc_id").count().filter("count <> 9").count() == 0
    assert "exchange" in rows._jdf.queryExecution().executedPlan().toString().lower()
