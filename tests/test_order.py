"""Results that must not depend on how rows are dealt, numbered, repeated or grouped."""

import datetime
import hashlib
import pathlib
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from idsift.operators import audit, evaluation, faces, mrz, ocr, ranks, sequences
from idsift.plans import log, streams, views
from idsift.session import kept, materialize
from idsift.streaming import jobs


def frames(spark, positions):
    rows = [(1, p, float(i * 100), 1, 2, True, True, 20.0, 0.1, str(i)) for i, p in enumerate(positions)]
    names = "seq_id long, idx int, timestamp_ms double, face_count int, eyes_visible int, quality_ok boolean, same_face_as_first boolean, texture_contrast double, periodic_energy_ratio double, digest string"
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("positions, reason", [
    ([7, 8, 9, 10, 11, 12], None), ([0, 5, 50, 51], None), ([0, 1, 1], "frame_positions"),
    ([0, None, 2], "frame_positions"), (list(range(30, 43)), "too_many_frames"),
])
def test_positions_are_an_order(spark, positions, reason):
    row = sequences.validate(sequences.gather(frames(spark, positions))).first()
    assert (row["n"], row["reason"]) == (len(positions), reason)


@pytest.mark.parametrize("files", [1, 3, 17])
def test_decisions_in_any_number_of_files(spark, sf_dir, tmp_path, files):
    rows = streams.decision_rows(spark, sf_dir).filter("crc32(scan_id) % 40 = 0 or scan_id like 'missing-%'").cache()
    path = f"{tmp_path}/in"
    rows.repartition(files, F.rand(files)).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.run_to_table(jobs.decisions(stream), str(tmp_path))
    streams.closing(rows, "scan_id").write.mode("append").parquet(path)
    jobs.run_to_table(jobs.decisions(stream), str(tmp_path))
    got = {(r["scan_id"], r["ord"]): r["status"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    events = log.stored(spark, sf_dir)
    want = audit.accept(events, log.decisions(spark, sf_dir, events)).filter("crc32(scan_id) % 40 = 0 or scan_id like 'missing-%'")
    assert got == {(r["scan_id"], r["ord"]): r["status"] for r in want.collect()}
    assert "not_found" in got.values() and "accepted" in got.values()


@pytest.mark.parametrize("files", [1, 2])
def test_intake_takes_the_earliest_of_repeated_requests(spark, tmp_path, files):
    # Each request comes with fp-1 at 5, then fp-2 at 3, then fp-1 at 1, in this order of files' rows.
    at = lambda d: datetime.datetime(2026, 1, d)
    rows = [(i, fp, at(day)) for fp, day in (("1", 5), ("2", 3), ("1", 1)) for i in range(40)]
    path = f"{tmp_path}/events.parquet"
    names = "user_id long, fp string, ts timestamp"
    event = (F.col("fp").cast("long") + 3 * F.col("user_id")).alias("event_id")
    for k in range(files):
        part = rows if files == 1 else [r for r in rows if (r[1] == "1" and r[2] == at(5)) == (k == 1)]
        spark.createDataFrame(part, names).select(event, "user_id", "ts").coalesce(1).write.mode("append").parquet(path)
    got = {(r["request_id"], r["fingerprint"]): r["status"] for r in streams.st1(spark, str(tmp_path)).collect()}
    assert got == {(f"req-{i}", f"fp-{k}"): "new" if k == 1 else "conflict" for i in range(40) for k in (1, 2)}


def test_append_finds_the_heads_of_chains_dealt_alike(spark):
    # Rows and heads both come dealt by chain; adaptive execution joins more of the small parts.
    for name, value in {"autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "200kb", "adaptive.coalescePartitions.minPartitionSize": "1kb"}.items():
        spark.conf.set(f"spark.sql.{name}", value)
    try:
        chain = (F.col("id") % 500).alias("chain_id")
        head = spark.range(500).groupBy(chain).agg(F.max(F.lit(3).cast("bigint")).alias("seq"), F.max(F.lit("a" * 64)).alias("event_hash"))
        bad = spark.range(0).select(chain)
        rows = spark.range(20000).select(chain, "id", *[F.concat(F.lit(c), F.col("id").cast("string")).alias(c) for c in audit.NEW_COLUMNS])
        got = audit.append(head, rows.repartition("chain_id").join(bad, "chain_id", "left_anti"), ["id"])
        ends = got.groupBy("chain_id").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("*").alias("n"), F.min_by("previous_hash", "seq").alias("h"))
        assert [tuple(r) for r in ends.drop("chain_id").distinct().collect()] == [(4, 43, 40, "a" * 64)]
    finally:
        for name in ("autoBroadcastJoinThreshold", "adaptive.advisoryPartitionSizeInBytes", "adaptive.coalescePartitions.minPartitionSize"):
            spark.conf.unset(f"spark.sql.{name}")


def test_verification_moves_links_and_not_payloads(spark):
    long, names = "x" * 2000, "chain_id long, no long, " + ", ".join(f"{c} string" for c in audit.NEW_COLUMNS)
    rows = [(i % 5, i, *[f'{{"a":"{long}{i}"}}' if c == "payload_json" else f"{c}{i}" for c in audit.NEW_COLUMNS]) for i in range(50)]
    events = audit.append(log.empty_head(spark), spark.createDataFrame(rows, names), ["no"]).cache()
    plan = audit.verify(events, audit.new_head(log.empty_head(spark), events))._jdf.queryExecution().optimizedPlan().toString()
    aggregates = [line for line in plan.splitlines() if "Aggregate" in line]
    assert aggregates and not any("payload_json" in line or "Join LeftAnti" in line for line in aggregates)
    assert plan.count("Join LeftAnti") == 0
    assert audit.verify(events, audit.new_head(log.empty_head(spark), events)).filter("valid").count() == 5


def test_intake_judges_a_repeated_request_once(spark, tmp_path):
    make = lambda *r: spark.createDataFrame([(q, f, datetime.datetime(2026, 1, d)) for q, f, d in r], "request_id string, fingerprint string, ts timestamp")
    write = jobs.intake_writer(str(tmp_path))
    for _ in range(2):
        write(make(("a", "x", 1), ("b", "x", 2), ("a", "y", 2)), 0)
        write(make(("a", "x", 3), ("b", "z", 3), ("a", "y", 1), ("c", "x", 4)), 1)
    got = sorted((r["request_id"], r["fingerprint"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", "x", "new"), ("a", "y", "conflict"), ("b", "x", "new"), ("b", "z", "conflict"), ("c", "x", "new")]


def test_decision_state_goes_when_a_scan_is_old(spark, tmp_path):
    schema = (
        "ts timestamp, scan_id string, kind string, ord long, request_id string, fingerprint string, event_hash string, "
        "incomplete boolean, decision string, expected_event_hash string, acknowledge_incomplete boolean"
    )
    day = lambda d: datetime.datetime(2026, 1, d, 12)
    scan = lambda d, s: (day(d), s, "scan", -1, f"q{s}", "f", f"h{s}", False, None, None, None)
    choice = lambda d, s, n: (day(d), s, "decision", n, f"r{s}{n}", "f", f"d{s}{n}", None, "reject", f"h{s}", None)
    batches = [[scan(1, "a"), choice(1, "a", 1)], [scan(4, "b"), choice(5, "b", 1)], [scan(20, "c")], [scan(28, "d")]]
    sizes = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        jobs.run_to_table(jobs.decisions(stream, retention_days=5), str(tmp_path))
        state = spark.read.format("statestore").option("stateVarName", "requests").load(f"{tmp_path}/state")
        sizes.append(sorted({r["key"]["scan_id"] for r in state.collect()}))
    got = {(r["scan_id"], r["ord"]): r["status"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 1): "accepted", ("b", 1): "accepted"}
    assert "a" not in sizes[2] and sizes[3] == ["c"]


def test_verification_goes_on_from_a_trusted_row(spark):
    make = lambda n: [(c, i, f"e{c}-{i}", f"r{c}-{i}", "f", "s", "scan", "t", "a", "d", "{}") for c in (1, 2, 3) for i in range(n)]
    names = "chain_id long, no long, event_id string, request_id string, fingerprint string, scan_id string, kind string, timestamp string, actor string, document_hash string, payload_json string"
    events = audit.append(log.empty_head(spark), spark.createDataFrame(make(9), names), ["no"]).cache()
    head = audit.new_head(log.empty_head(spark), events)
    early = events.filter("seq <= 6")
    trusted = audit.trusted_prefix(audit.verify(early, audit.new_head(log.empty_head(spark), early)))
    result = lambda rows, known=trusted, heads=head: {
        r["chain_id"]: (r["error"], r["failed_seq"], r["hashed"]) for r in audit.verify_resumed(rows, heads, known).collect()
    }
    fine = (None, None, 3)
    assert result(events) == {1: fine, 2: fine, 3: fine}
    assert result(events, trusted.filter("chain_id > 1")) == {1: (None, None, 9), 2: fine, 3: fine}
    edit = lambda where, column, value: events.withColumn(column, F.when(F.expr(where), value).otherwise(F.col(column)))
    assert result(edit("chain_id = 1 and seq = 8", "actor", "x"))[1] == ("EVENT_CHAIN_MISMATCH", 8, 3)
    assert result(edit("chain_id = 1 and seq = 7", "previous_hash", "0" * 64))[1] == ("EVENT_CHAIN_MISMATCH", 7, 3)
    assert result(events.filter("not (chain_id = 2 and seq = 8)"))[2] == ("EVENT_CHAIN_MISMATCH", 8, 2)
    assert result(events.filter("not (chain_id = 2 and seq = 9)"))[2] == ("HEAD_MISMATCH", 9, 2)
    assert result(events.filter("not (chain_id = 2 and seq > 6)"))[2] == ("HEAD_MISMATCH", 7, 0)
    assert result(events.filter("not (chain_id = 3 and seq = 6)"))[3] == ("TRUSTED_ANCHOR_MISMATCH", 6, 3)
    assert result(events.unionByName(events.filter("chain_id = 3 and seq = 6")))[3] == ("TRUSTED_ANCHOR_MISMATCH", 6, 3)
    # A forged prefix that was hashed again, row by row, up to the trusted position.
    other = audit.append(log.empty_head(spark), spark.createDataFrame(make(6), names).withColumn("actor", F.lit("x")), ["no"])
    forged = other.filter("chain_id = 1").unionByName(events.filter("chain_id > 1 or seq > 6"))
    assert result(forged)[1] == ("TRUSTED_ANCHOR_MISMATCH", 6, 3)
    assert result(early, heads=audit.new_head(log.empty_head(spark), early)) == {c: (None, None, 0) for c in (1, 2, 3)}


def test_states_are_kept_batch_by_batch(spark, sf_dir, tmp_path):
    events = log.full_log(spark, sf_dir)
    whole = sorted(map(str, audit.latest(events).collect()))
    part = F.crc32("scan_id") % 3
    batches = [
        events.filter((part == 0) & (F.col("kind") == "scan")), events.filter(part == 1),
        events.filter((part == 0) & (F.col("kind") != "scan")), events.filter(part == 2), events.limit(0),
    ]
    names = audit.latest(events).columns
    for number, batch in enumerate([*batches[:3], batches[2], *batches[3:]]):
        # The third batch comes twice, under its own number.
        states = audit.keep_states(spark, str(tmp_path), batch, number - (number > 2))
    assert sorted(map(str, states.select(names).collect())) == whole
    pages, after = [], None
    while not pages or len(pages[-1]) == 90:
        pages.append(audit.history_page(states, "", None, 90, after=after)[0].collect())
        after = tuple(pages[-1][-1][c] for c in ("timestamp", "chain_id", "seq", "scan_id")) if pages[-1] else None
        if len(pages) == 4:
            break
    for number, page in enumerate(pages):
        want = audit.history(events, "", None, 90, 90 * number)[0].collect()
        assert [r["scan_id"] for r in page] == [r["scan_id"] for r in want]
    assert len(pages) > 2


def test_a_log_has_one_writer(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, 1, "e", "r", "f", "s", "scan", "t", "a", "d", "{}")],
        "chain_id long, no long, event_id string, request_id string, fingerprint string, scan_id string, kind string, timestamp string, actor string, document_hash string, payload_json string",
    )
    jobs.appender(spark, str(tmp_path), ["no"], "first")(rows, 0)
    with pytest.raises(ValueError, match="belongs"):
        jobs.appender(spark, str(tmp_path), ["no"], "second")(rows, 0)
    assert jobs.read_log(spark, str(tmp_path)).count() == 1


def test_one_request_wins_for_one_scan(spark):
    head = log.empty_head(spark)
    new = spark.createDataFrame(
        [(1, i, f"e{i}", f"q{i}", "f", f"s{i}", "scan", "t", "a", "d", '{"processing_status":"ok","risk":{"missing_required_signals":[]}}') for i in (1, 2)],
        "chain_id long, no long, event_id string, request_id string, fingerprint string, scan_id string, kind string, timestamp string, actor string, document_hash string, payload_json string",
    )
    events = audit.append(head, new, ["no"])
    hashes = {r["scan_id"]: r["event_hash"] for r in events.collect()}
    rows = [("s1", 2, "same"), ("s2", 1, "same"), ("s2", 3, "other"), ("s1", 4, "third")]
    decisions = spark.createDataFrame(
        [(s, o, q, "reject", False, hashes[s], "n", "a") for s, o, q in rows],
        "scan_id string, ord int, request_id string, decision string, acknowledge_incomplete boolean, expected_event_hash string, note string, actor string",
    )
    got = {(r["scan_id"], r["ord"]): r["status"] for r in audit.accept(events, decisions).collect()}
    assert got == {("s2", 1): "accepted", ("s1", 2): "conflict", ("s2", 3): "stale", ("s1", 4): "accepted"}


def chain(spark, n):
    new = spark.createDataFrame(
        [(1, i, f"e{i}", f"q{i}", "f", f"s{i}", "scan", "t", "a", "d", "{}") for i in range(n)],
        "chain_id long, no long, event_id string, request_id string, fingerprint string, scan_id string, kind string, timestamp string, actor string, document_hash string, payload_json string",
    )
    return audit.append(log.empty_head(spark), new, ["no"]).cache()


def test_repeated_event_rows(spark):
    events = chain(spark, 3)
    again = events.unionByName(events.filter("seq = 2"))
    assert audit.linked(again).count() == 4
    row = audit.verify(again, audit.new_head(log.empty_head(spark), events)).first()
    assert (row["valid"], row["failed_seq"], row["event_count"]) == (False, 3, 4)
    good, bad = audit.guard(audit.verify(again, audit.new_head(log.empty_head(spark), events)), events)
    assert good.count() == 0 and {r["reason"] for r in bad.collect()} == {audit.INTEGRITY}


def test_groups_without_keys_and_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None)], "g string, v double")
    each, rejected = evaluation.latency(df, "v", ["g"])
    assert {(r["g"], r["n"], r["median_ms"]) for r in each.collect()} == {(None, 2, 2.0), ("a", 1, 2.0)}
    assert rejected.count() == 1
    assert evaluation.latency(df, "v")[0].first()["median_ms"] == 2.0
    scored = spark.createDataFrame([(None, True, 0.9), (None, False, 0.1), (None, True, None)], "g string, t boolean, s double")
    points = {(r["threshold"], r["fpr"], r["tpr"]) for r in evaluation.roc(scored, "t", "s", ["g"]).collect()}
    assert points == {(None, 0.0, 0.0), (0.9, 0.0, 1.0), (0.1, 1.0, 1.0)}
    assert evaluation.unscored(scored, "t", "s").count() == 1


def test_bins_of_close_values_stay_small(spark):
    v = F.col("id") / 1e7
    df = spark.range(40_000).select(F.when(F.col("id") % 20 == 0, v * 1e6).otherwise(0.99 + v).alias("_v")).select(
        ranks.group_of([]), "_v"
    )
    largest = ranks.binned(df, "_v").groupBy("_bin").count().agg(F.max("count")).first()[0]
    assert largest <= 3 * 40_000 / ranks.BINS


def test_a_stray_bar_hides_no_zone(spark):
    first = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"
    second = "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
    texts = [first, second + "|", first, second]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, first), (2, 1, second + "|")], "doc_id long, line_no int, text string")
    records, _, _, quarantine = mrz.parse_corpus(lines)
    assert [r["doc_id"] for r in records.collect()] == [1]
    assert [(r["doc_id"], r["reason"]) for r in quarantine.collect()] == [(2, "no_supported_zone")]


def test_documents_without_readable_lines_stay(spark):
    lines = spark.createDataFrame(
        [(1, "full", 0, "  ", 0.5), (2, "full", 0, "PASSPORT", 0.5)], "doc_id long, pass string, line_no int, text string, confidence double"
    )
    got = {r["doc_id"]: (r["ocr_status"], r["ocr_codes"]) for r in ocr.resolve(lines).collect()}
    assert got[1] == ("insufficient_evidence", ["MRZ_NOT_EXTRACTED", "VIZ_NOT_EXTRACTED"]) and len(got) == 2


def test_vector_search_compares_few_pairs_of_clusters():
    rnd = np.random.default_rng(1)
    centers = rnd.normal(size=(20, 64))
    make = lambda n: faces._unit(pd.Series(list(centers[rnd.integers(0, 20, n)] + rnd.normal(scale=0.2, size=(n, 64)))))
    a, b = make(400), make(500)
    got, compared = faces.similarities(a, b, faces._axes(a), 0.8)
    want = np.round(a @ b.T, 9)
    assert compared < a.shape[0] * b.shape[0] / 2
    assert ((want >= 0.8) == (got >= 0.8)).all() and np.allclose(got[got >= 0.8], want[got >= 0.8])


def test_small_groups_of_vectors_share_blocks(monkeypatch):
    monkeypatch.setattr(faces, "GALLERY_BLOCK", 10)
    first, splits = faces._packing([3, 4, 3, 1, 25, 2, 8, 10])
    assert first.tolist() == [0, 0, 0, 1, 2, 5, 5, 6] and splits.tolist() == [1, 1, 1, 1, 3, 1, 1, 1]


def test_queries_are_routed_in_small_pieces(spark, monkeypatch):
    # Vectors in all directions, so that every query asks for every group: 40 rows for each before.
    monkeypatch.setattr(faces, "ROUTED_ROWS", 64)
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=8)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def count(q, g, axes):
        return pd.DataFrame({"q": [len(q)], "g": [len(g)]})

    got = faces._blocks(df, df, 0.2, [], count, "q long, g long").collect()
    sent = sum(r["q"] for r in got)
    assert sent == 1500 and [r["g"] for r in got] == [1500]


def test_similarity_is_not_rounded_twice(spark):
    # 0.35269849960 rounds to 0.352698, but not by way of nine digits.
    c = 0.3526984996
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [c, (1 - c * c) ** 0.5])], "vec_id long, embedding array<double>")
    row = faces.nearest(df.filter("vec_id = 1"), df.filter("vec_id = 0"), 0.25).first()
    assert round(row["similarity"], 6) == 0.352698


def test_a_packed_file_of_keys_is_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "ROWS_PER_TASK", 50)
    spark.range(1, 501).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for rows, each in ((views.signals(spark, str(tmp_path)), 10), (views.ids(spark, str(tmp_path)), 1)):
        sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 5 and sum(sizes) == 500 * each and max(sizes) < 150 * each


def test_vectors_of_other_lengths_are_left_out(spark):
    rows = [(i, [float(i + 1), 1.0, 2.0]) for i in range(5)] + [(9, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = faces.nearest(df, df, 0.9).collect()
    assert {r["query_id"] for r in got} == set(range(5)) and all(r["match_id"] == r["query_id"] for r in got)


def test_many_scans_are_judged_in_one_pass_over_sorted_rows(spark, sf_dir, tmp_path):
    # Decisions quote the ones before them, come in any batch, and some scans rest for longer than they are kept.
    schema = (
        "ts timestamp, scan_id string, kind string, ord long, request_id string, fingerprint string, event_hash string, "
        "incomplete boolean, decision string, expected_event_hash string, acknowledge_incomplete boolean"
    )
    start = datetime.datetime(2026, 1, 1)
    rows = []
    for i in range(60):
        s = f"s{i}" if i else None
        at = lambda h: start + datetime.timedelta(hours=i + h)  # noqa: B023, E731
        if i % 5:
            rows.append((at(0), s, "scan", -1, f"q{i}", "f", f"h{i}", i % 3 == 0, None, None, None))
        for k in range(4):
            expected = f"h{i}" if k == 0 else f"d{i}-{k - 1}" if k < 3 else "?"
            late = 24 * 9 if i % 7 == 3 and k == 3 else 0
            request = f"r{i}-{0 if k == 3 else k}"
            rows.append((at(k + 1 + late), s, "decision", k, request, f"f{k % 2}", f"d{i}-{k}", None, "approve" if k % 2 else "reject", expected, i % 2 == 0))
    results = []
    for folder, steps in (("one", 1), ("many", 3)):
        path, order = f"{tmp_path}/{folder}", sorted(rows, key=lambda r: r[0])
        for n in range(steps):
            part = order[n * len(order) // steps : (n + 1) * len(order) // steps]
            spark.createDataFrame(part, schema).write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(schema).parquet(f"{path}/in")
            jobs.run_to_writer(jobs.passed(stream), path, jobs.decision_writer(path, 8))
        end = (datetime.datetime(2200, 1, 1), "end", "scan", -1, "q", "f", "h", False, None, None, None)
        spark.createDataFrame([end], schema).write.mode("append").parquet(f"{path}/in")
        jobs.run_to_writer(jobs.passed(spark.readStream.schema(schema).parquet(f"{path}/in")), path, jobs.decision_writer(path, 8))
        results.append({(r["scan_id"], r["ord"]): (r["request_id"], r["status"], r["latest_event_hash"]) for r in jobs.verdicts(spark, path).collect()})
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/one/in")
    jobs.run_to_table(jobs.decisions(stream, retention_days=100), f"{tmp_path}/own")
    own = {(r["scan_id"], r["ord"]): (r["request_id"], r["status"], r["latest_event_hash"]) for r in spark.read.parquet(f"{tmp_path}/own/out").collect()}
    assert results[0] == results[1] and len(results[0]) == 240
    rested = {(f"s{i}", 3) for i in range(60) if i % 7 == 3}
    assert {k for k, v in own.items() if v != results[0][k]} <= rested
    assert {results[0][k][1] for k in rested} == {"not_found"}
    assert {v[1] for v in results[0].values()} >= {"accepted", "conflict", "not_found", "incomplete", "stale"}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_sequences_share_states_and_close_by_themselves(spark, tmp_path, kind):
    # Long, unknown and interleaved sequences in three batches; one state holds several of them.
    schema = f"ts timestamp, seq_id {kind}, idx int, timestamp_ms double, face_count int, eyes_visible int, quality_ok boolean, same_face_as_first boolean, texture_contrast double, periodic_energy_ratio double, digest string"
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    name = lambda i: None if i == 3 else i + 2**60 if kind == "long" else f"s{i}"
    rows = [(at(i * 15 + k / 10), name(i), 60 - k, float(k * 100), 1, 2, True, True, 20.0, 0.1, str(k)) for i in range(12) for k in range(60 if i == 5 else i + 1)]
    rows.append((at(10**6), name(99), 0, 0.0, 1, 2, True, True, 20.0, 0.1, "end"))
    calls = []
    for part in (rows[:40], rows[40:90], rows[90:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        jobs.run_to_table(jobs.gather_sequences(stream, groups=3), str(tmp_path))
        calls.append(spark.read.format("statestore").load(f"{tmp_path}/state").count())
    assert max(calls) <= 3
    got = {r["seq_id"]: (r["n"], [f["idx"] for f in r["frames"]]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {name(i): (n, list(range(61 - n, 61))[:12]) for i in range(12) for n in [60 if i == 5 else i + 1]}
    assert got == want


def test_words_are_joined_where_their_documents_are(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(views, "DOCUMENTS_PER_TASK", 20)
    out = ocr.lines(views.ocr_words(spark, sf_dir), ["doc_id", *ocr.LINE_KEYS])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


def shuffled(spark):
    """Bytes of shuffles on local disk."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for d in folders for f in pathlib.Path(d).rglob("shuffle_*.data"))


def test_a_stored_table_leaves_nothing_shuffled(spark, sf_dir):
    rows, name = log.log(spark, sf_dir), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own, before = spark.conf.get(name), shuffled(spark)
    materialize(rows, "first")
    kept(spark, sf_dir, "second", lambda: rows)
    deadline = time.time() + 20
    while shuffled(spark) > before and time.time() < deadline:  # Executors remove files by themselves.
        time.sleep(0.2)
    assert shuffled(spark) <= before and spark.conf.get(name) == own
    before = shuffled(spark)
    assert rows.count() and shuffled(spark) > before


def test_rows_stay_where_they_are_for_few_refused_chains(spark):
    events = chain(spark, 3)
    rows = spark.range(20000).select((F.col("id") % 7).alias("chain_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).cache()
    edited = events.withColumn("actor", F.lit("x"))
    good, bad = audit.guard(audit.verify(edited, audit.new_head(log.empty_head(spark), events)), rows)
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert good.count() == rows.filter("chain_id <> 1").count() and bad.count() == rows.filter("chain_id = 1").count()


def test_digests_move_as_bytes_and_stay_what_they_were(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = [sha("a"), sha("a").upper(), sha("b")[:-2], sha("c") + "\n", "é", "", None, "0" * 64]
    new = spark.createDataFrame(
        [(1, i, f"e{i}", f"q{i}", t, f"s{i}", "scan", "t", "a", texts[-1 - i], "{}") for i, t in enumerate(texts)],
        "chain_id long, no long, event_id string, request_id string, fingerprint string, scan_id string, kind string, timestamp string, actor string, document_hash string, payload_json string",
    )
    events = audit.append(log.empty_head(spark), new, ["no"])
    found = events.orderBy("seq").collect()
    assert [(r["fingerprint"], r["document_hash"]) for r in found] == list(zip(texts, texts[::-1], strict=True))
    assert [r["h"] for r in spark.createDataFrame(found, events.schema).orderBy("seq").select(audit.row_hash().alias("h")).collect()] == [r["event_hash"] for r in found]
    moved = events._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert "unhex(document_hash" in moved[1] and "unhex(fingerprint" in moved[1]
    # Decisions quote hashes that are no digests, and none.
    quoted = [found[0]["event_hash"], found[1]["event_hash"].upper(), "é", None]
    asked = spark.createDataFrame(
        [(f"s{i}", 1, f"d{i}", "reject", False, q, "n", "a") for i, q in enumerate(quoted)],
        "scan_id string, ord int, request_id string, decision string, acknowledge_incomplete boolean, expected_event_hash string, note string, actor string",
    )
    judged = audit.accept(events, asked).orderBy("scan_id").collect()
    assert [r["expected_event_hash"] for r in judged] == quoted and judged[0]["latest_event_hash"] == quoted[0]
    # A missing hash is no other hash, as before.
    assert [r["status"] for r in judged] == ["accepted", "stale", "stale", "accepted"]


def test_states_are_dealt_once_and_old_versions_go(spark, sf_dir, tmp_path):
    events = log.full_log(spark, sf_dir)
    unknown = events.filter("kind = 'scan'").limit(1).withColumn("scan_id", F.lit(None).cast("string"))
    scans = events.filter("kind = 'scan'").unionByName(unknown)
    states = audit.keep_states(spark, str(tmp_path), scans, 0)
    chosen = events.filter("kind = 'decision'").unionByName(unknown)
    merged = audit.merged_states(states.drop("part"), chosen)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "hashpartitioning(scan_id" not in plan and "Join" not in plan.replace("BroadcastHashJoin", "")
    audit.keep_states(spark, str(tmp_path), chosen, 1)
    states = audit.drop_versions(spark, str(tmp_path))
    left = list(tmp_path.glob("part=*/version=*"))
    assert len(left) == len({f.parent for f in left}) == states.select("part").distinct().count()
    want = audit.latest(events)
    assert sorted(map(str, states.filter("scan_id is not null").select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert states.filter("scan_id is null").count() == 2


def test_decisions_wait_in_files_and_come_once(spark, tmp_path):
    schema = (
        "ts timestamp, scan_id string, kind string, ord long, request_id string, fingerprint string, event_hash string, "
        "incomplete boolean, decision string, expected_event_hash string, acknowledge_incomplete boolean"
    )
    at = lambda m: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=m)
    scan = lambda m, s: (at(m), s, "scan", -1, f"q{s}", "f", f"h{s}", False, None, None, None)
    chosen = lambda m, s, k: (at(m), s, "decision", k, f"r{s}{k}", "f", f"d{s}{k}", None, "approve", f"h{s}", True)
    batches = [
        [chosen(5, "a", 0), scan(1, "a"), scan(2, "b"), (None, *chosen(5, "a", 9)[1:])],
        [chosen(61.5, "b", 0), chosen(62, "a", 1)],  # The first three minutes at most have passed, so that the next is late for one.
        [chosen(0.5, "b", 1), chosen(6, "b", 2), chosen(200, "c", 0)],
        [chosen(400, "c", 1)], [chosen(800, "c", 2)], [chosen(5000, "end", 0)],
    ]
    seen = []
    write = jobs.decision_writer(str(tmp_path))
    for number, rows in enumerate(batches):
        rows = jobs.passed(spark.createDataFrame(rows, schema))
        for _ in range(2):  # A batch that is repeated replaces itself.
            write(rows, number)
        found = [(r["scan_id"], r["ord"], r["status"]) for r in jobs.verdicts(spark, str(tmp_path)).collect()]
        assert len(found) == len(set(found))
        seen.append({f for f in found if not any(f in s for s in seen)})
    assert seen == [
        set(), set(), {("a", 0, "accepted"), ("b", 2, "accepted"), ("b", 0, "stale"), ("a", 1, "stale")}, {("c", 0, "not_found")},
        {("c", 1, "not_found")}, {("c", 2, "not_found")},
    ]
    assert not (tmp_path / "waiting" / "arrived=0").exists() and (tmp_path / "waiting" / "arrived=5").exists()
    # A stream keeps no state beside the files.
    spark.createDataFrame(batches[0], schema).write.parquet(f"{tmp_path}/in")
    jobs.run_to_writer(jobs.passed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/own", jobs.decision_writer(f"{tmp_path}/own"))
    assert not list(tmp_path.rglob("own/state/state/*")) and list(tmp_path.rglob("own/waiting/arrived=0/*.parquet"))
