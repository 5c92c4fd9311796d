"""Streaming jobs run to the end of the driver tables, checked like batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from idsift.operators import audit, sequences
from idsift.plans import log, oracle as O, scoring, signals, views
from idsift.session import released, shared_dir
from idsift.streaming import jobs

QUERIES: dict = {}
SQL: dict = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def source(spark, sf, name) -> DataFrame:
    """A driver table as a file stream."""
    return spark.readStream.schema(views.table(spark, sf, name).schema).parquet(f"{sf}/{name}*.parquet")


@query("st1_intake", O.query("""
SELECT request_id, fingerprint, CASE WHEN fingerprint = first_value(fingerprint) OVER (PARTITION BY request_id ORDER BY ts, fingerprint) THEN 'new' ELSE 'conflict' END AS status
FROM (SELECT 'req-' || user_id AS request_id, 'fp-' || (event_id % 3) AS fingerprint, min(ts) AS ts FROM events GROUP BY ALL) q"""))
def st1(spark, sf):
    stream = source(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("req-"), F.col("user_id").cast("string")).alias("request_id"),
        F.concat(F.lit("fp-"), (F.col("event_id") % 3).cast("string")).alias("fingerprint"),
    )
    folder = shared_dir(spark, "intake")
    (
        stream.writeStream.option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).foreachBatch(jobs.intake_writer(folder)).start().awaitTermination()
    )
    return spark.read.parquet(f"{folder}/out").select("request_id", "fingerprint", "status")


@query("st2_decisions", O.query("SELECT scan_id, ord, status FROM decided"))
def st2(spark, sf):
    """Scans and decisions through state, in order of their times. A last row far in the
    future lets the watermark pass all others and waits itself."""
    folder = shared_dir(spark, "decisions")
    rows = decision_rows(spark, sf)
    with released(spark):
        rows.write.option("compression", "zstd").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    jobs.run_to_writer(jobs.passed(stream), folder, jobs.decision_writer(folder))
    closing(spark.read.schema(rows.schema).parquet(f"{folder}/in"), "scan_id").write.mode("append").parquet(f"{folder}/in")
    jobs.run_to_writer(jobs.passed(stream), folder, jobs.decision_writer(folder))
    return jobs.verdicts(spark, folder).select("scan_id", F.col("ord").cast("int").alias("ord"), "status")


def decision_rows(spark, sf) -> DataFrame:
    events = log.stored(spark, sf)
    start = F.lit("2026-10-03 00:00:00").cast("timestamp")
    scans = events.select(
        start.alias("ts"), "scan_id", "kind", F.lit(-1).cast("bigint").alias("ord"), "request_id", "fingerprint", "event_hash",
        audit.incomplete(F.col("payload_json")).alias("incomplete"), F.lit(None).cast("string").alias("decision"),
        F.lit(None).cast("string").alias("expected_event_hash"), F.lit(None).cast("boolean").alias("acknowledge_incomplete"),
    )
    chosen = log.decisions(spark, sf, events).select(
        (start + F.make_dt_interval(secs=F.col("ord") + 1)).alias("ts"), "scan_id", F.lit("decision").alias("kind"),
        F.col("ord").cast("bigint").alias("ord"), "request_id",
        audit.decision_fingerprint().alias("fingerprint"), F.sha2("request_id", 256).alias("event_hash"),
        F.lit(None).cast("boolean").alias("incomplete"), "decision", "expected_event_hash", "acknowledge_incomplete",
    )
    return scans.unionByName(chosen)


def closing(rows: DataFrame, key: str) -> DataFrame:
    """One row of a key of its own, later than all others."""
    end = F.lit("2200-01-01").cast("timestamp")
    return rows.limit(1).withColumn(key, F.lit("end" if dict(rows.dtypes)[key] == "string" else -1).cast(dict(rows.dtypes)[key])).withColumn("ts", end)


@query("st3_score", O.query(f"SELECT {scoring.SCORE_COLUMNS} FROM scored_docs", **scoring.SIGNAL_SCORE))
def st3(spark, sf):
    folder = shared_dir(spark, "score")
    keys = source(spark, sf, "customer").select("c_custkey")
    stream = views.signals_of(views.spread(keys, views.table(spark, sf, "customer"), "c_custkey"))
    out = jobs.run_to_table(jobs.score(stream).drop("contributions"), folder, "update")
    newest = out.groupBy("doc_id").agg(F.max("_batch").alias("_batch"))
    return out.join(newest, ["doc_id", "_batch"]).select(*scoring.SCORE_COLUMNS.split(", "))


@query("st4_sequences", O.query("SELECT * FROM seq_outcome"))
def st4(spark, sf):
    """Frames stamped by sequence, so that sequences never overlap in time."""
    folder = shared_dir(spark, "sequences")
    path = f"{folder}/in"
    # A day after the epoch, where every watermark begins.
    at = (F.col("seq_id") * 60000 + F.col("timestamp_ms") + 86_400_000).cast("bigint")
    frames = views.frames(spark, sf).withColumn("ts", F.timestamp_millis(at))
    frames.write.parquet(path)
    stream = spark.readStream.schema(frames.schema).parquet(path)
    jobs.run_to_table(jobs.gather_sequences(stream), folder)
    # One row far in the future, in a later batch, closes the last open sequences
    # and stays open itself.
    closing(frames, "seq_id").write.mode("append").parquet(path)
    jobs.run_to_table(jobs.gather_sequences(stream), folder)
    gathered = spark.read.parquet(f"{folder}/out").filter(F.col("seq_id") >= 0)
    return sequences.outcome_of(gathered).select(
        "seq_id", F.col("liveness_status").alias("status"), F.array_join("liveness_codes", ",").alias("codes")
    )


@query("st5_append", log.chained(f"SELECT {log.EVENT} FROM log"))
def st5(spark, sf):
    folder = shared_dir(spark, "append")
    rows = log.new_scans(spark, sf)
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    (
        stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        .foreachBatch(jobs.appender(spark, folder, ["scan_no"], f"{folder}/state")).start().awaitTermination()
    )
    return jobs.read_log(spark, folder).select(*log.EVENT.split(", "))
