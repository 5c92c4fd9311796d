"""Structured Streaming forms of intake, decisions, scoring, sequences and append.

Every job takes a streaming DataFrame and returns one, or a writer for
``foreachBatch``; the batch operators do the work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from idsift.operators import audit, risk, sequences
from idsift.policy import RiskPolicy, SEQUENCE_LIMITS
from idsift.session import discard, released

EVENT_TABLE, HEAD_TABLE = "events", "heads"


def intake(stream: DataFrame, time: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """Drop repeated requests; the same key with another content passes through
    as its own row, so that ``audit.dedupe`` can report the conflict.

    State is bounded by the watermark, not by the length of the stream. Of repeated rows
    any one passes, with its own time; where the earliest counts, ``intake_writer`` takes
    the stream as it is.
    """
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(
        ["request_id", "fingerprint"]
    )


def intake_writer(folder: str):
    """``foreachBatch`` function that judges requests against the stored ones.

    Rows ``request_id, fingerprint, ts``, repeated ones included: a batch takes the
    earliest time of each, and leaves out those that an earlier batch has judged. Each batch leaves its verdicts below ``out`` and
    its new requests below ``requests``, both under its own number, so a repeated batch
    replaces itself and is judged against the batches before it only. Within a batch
    the earliest time counts, then the lower fingerprint.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = "request_id string, fingerprint string, event_id string"
        known = spark.createDataFrame([], schema)
        if batch_id > 0:
            known = spark.read.schema(schema + ", batch long").parquet(f"{folder}/requests").filter(
                F.col("batch") < batch_id
            ).drop("batch")
        at = F.concat_ws("|", F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), "fingerprint")
        fresh = batch.groupBy("request_id", "fingerprint").agg(at.alias("at")).withColumn(
            "event_id", F.sha2(F.concat_ws("|", "request_id", "fingerprint"), 256)
        )
        if batch_id > 0:
            done = spark.read.schema("request_id string, fingerprint string, batch long").parquet(f"{folder}/out").filter(
                F.col("batch") < batch_id
            )
            same = [fresh[c].eqNullSafe(done[c]) for c in ("request_id", "fingerprint")]
            fresh = fresh.join(done, same, "left_anti")
        judged = audit.dedupe(known, fresh, "at").select("request_id", "fingerprint", "event_id", "status")
        judged.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
        new = spark.read.parquet(f"{folder}/out/batch={batch_id}").filter("status = 'new'")
        new.drop("status").write.mode("overwrite").parquet(f"{folder}/requests/batch={batch_id}")

    return write


# ------------------------------------------------------------------- decisions

DECISION_OUTPUT = "scan_id string, request_id string, ord long, status string, latest_event_hash string"
_DECISION_NAMES = [c.split()[0] for c in DECISION_OUTPUT.split(", ")]
_WAITING = {
    "ts": "timestamp", "ord": "bigint", "kind": "string", "request_id": "string", "fingerprint": "string",
    "event_hash": "string", "incomplete": "boolean", "decision": "string", "expected_event_hash": "string",
    "acknowledge_incomplete": "boolean",
}


def _milliseconds(row: tuple) -> int:
    """A row's time, rounded up."""
    return math.ceil(pd.Timestamp(row[0]).timestamp() * 1000)


class DecisionProcessor(StatefulProcessor):
    """One scan's rows, held until the watermark has passed them and then judged in order
    of time, so that the result doesn't depend on which rows share a micro-batch.

    State has three parts. New rows are added to a list, which isn't read for that; a
    timer at their time reads it once the watermark is there. The newest hash and gate
    are a value. Requests are a map, in which a decision looks up its own entry, however
    many there are. A last timer removes all, ``retention_ms`` after the last judgement.
    """

    def __init__(self, retention_ms: int):
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scan = handle.getValueState("scan", "latest string, incomplete boolean, judged_ms bigint")
        self.requests = handle.getMapState("requests", "request_id string", "fingerprint string")
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} {t}" for n, t in _WAITING.items()))

    def handleInputRows(self, key, rows, timerValues):
        new = [r for frame in rows for r in zip(*(_plain(frame[c]) for c in _WAITING), strict=True)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(map(_milliseconds, new)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        done = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[2] != "scan", r[1], r[3]))
        ready = [r for r in rows if _milliseconds(r) <= done]
        later = rows[len(ready) :]
        if ready:
            known = tuple(self.scan.get()) if self.scan.exists() else (None, None, 0)
            out, latest, incomplete = self._judge(key[0], ready, *known[:2])
            self.scan.update((latest, incomplete, done))
            self.handle.registerTimer(done + self.retention_ms)
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            if out:
                yield pd.DataFrame(out, columns=_DECISION_NAMES)
        if later:
            self.handle.registerTimer(_milliseconds(later[0]))
        elif not ready and self.scan.exists() and self.scan.get()[2] + self.retention_ms <= done:
            self.scan.clear()
            self.requests.clear()

    def _judge(self, scan_id: str, rows: list[tuple], latest, incomplete) -> tuple[list[tuple], str, bool]:
        """Apply rows, in order, to what is known of the scan."""
        out = []
        for _, at, kind, request, own_print, new_hash, gate, decision, expected, acknowledged in rows:
            if kind == "scan":
                if latest is None:
                    latest, incomplete = new_hash, bool(gate)
                    self.requests.updateValue((request,), (own_print,))
                continue
            if self.requests.containsKey((request,)):
                status = "replay" if self.requests.getValue((request,))[0] == own_print else "conflict"
            elif latest is None:
                status = "not_found"
            elif expected != latest:
                status = "stale"
            elif decision == "approve" and incomplete and not acknowledged:
                status = "incomplete"
            else:
                status, latest = "accepted", new_hash
                self.requests.updateValue((request,), (own_print,))
            out.append((scan_id, request, int(at), status, latest))
        return out, latest, incomplete

    def close(self) -> None:
        pass


def _plain(column: pd.Series) -> list:
    return [None if pd.isna(x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in column.tolist()]


def decisions(stream: DataFrame, watermark: str = "1 hour", retention_days: int = 30) -> DataFrame:
    """Judge decisions against the newest event of their scan.

    Rows: ``ts, scan_id, kind, ord, request_id, fingerprint, event_hash, incomplete,
    decision, expected_event_hash, acknowledge_incomplete``. A row is judged when the
    watermark has passed its time, in order of time, however the rows were dealt to
    micro-batches; a decision whose scan hasn't come by then is ``not_found``. State
    per scan is its newest hash, its gate, the accepted requests and waiting rows, and
    goes after ``retention_days`` without an event. It needs the RocksDB state store,
    which ``run_to_table`` chooses.
    """
    return stream.withWatermark("ts", watermark).groupBy("scan_id").transformWithStateInPandas(
        DecisionProcessor(retention_days * 86_400_000), DECISION_OUTPUT, "Append", "EventTime"
    )


_READY = ["scan_id", "rank", "batch", "ms", "ord", "kind", "request_id", "fingerprint", "event_hash", "incomplete", "decision", "expected_event_hash", "acknowledge_incomplete"]
JUDGED = f"{DECISION_OUTPUT}, fingerprint string, incomplete boolean, ms long, kind string"
_JUDGED_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
_JUDGED_SCHEMA = pa.schema([(c.split()[0], _JUDGED_TYPES[c.split()[1]]) for c in JUDGED.split(", ")])


def passed(stream: DataFrame, watermark: str = "1 hour", grain: str = "1 minute") -> DataFrame:
    """Rows as for ``decisions`` with the end of their ``grain`` of time, ``closes``, and the
    watermark that each brings, ``mark`` in milliseconds. ``decision_writer`` lets them wait
    until the watermark has passed their grain, and leaves out those that come later."""
    window = stream.withColumn("_window", F.window("ts", grain))
    return window.select(
        "scan_id", *_WAITING, F.col("_window.end").alias("closes"), F.unix_millis(F.col("ts") - F.expr(f"INTERVAL '{watermark}'")).alias("mark")
    )


def decision_writer(folder: str, retention_days: int = 30):
    """``foreachBatch`` function over ``passed``: judges as ``decisions`` does, for streams
    of very many scans, each of which costs ``decisions`` a dozen calls between Python and
    its state.

    Rows wait in files, below ``waiting`` under the number of the batch that they came with:
    written once and packed, where state would be held on local disks and again in its
    checkpoint. The watermark of each batch is below ``marks``. A batch judges the rows of all
    batches that its watermark has passed and that of the batch before hadn't; files go when
    all their rows were judged in batches before.

    Rows and what is known of their scans are sorted by scan and time and judged in one
    pass over each partition. A batch leaves its verdicts, and a new version of every scan
    that it touches, below ``judged`` under its own number, so a repeated batch replaces
    itself and reads the batches before it only. A scan without an event for
    ``retention_days`` is forgotten; versions of none but such scans are removed.
    """
    retention = retention_days * 86_400_000
    path = f"{folder}/judged"
    schema = "scan_id string, " + ", ".join(f"{n} {t}" for n, t in _WAITING.items()) + ", closes timestamp, mark bigint, arrived int"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema("mark long").parquet(f"{folder}/marks/batch={batch_id - 1}").first()[0] if batch_id > 0 else 0
        closed_by = lambda mark: F.col("closes") <= F.timestamp_millis(F.lit(mark))
        _save(batch.filter(~closed_by(before)), f"{folder}/waiting/arrived={batch_id}")
        waiting = spark.read.schema(schema).parquet(f"{folder}/waiting").filter(F.col("arrived") <= batch_id)
        mark = max(before, waiting.filter(F.col("arrived") == batch_id).agg(F.max("mark")).first()[0] or 0)
        _save(spark.createDataFrame([(mark,)], "mark long"), f"{folder}/marks/batch={batch_id}")
        us = F.unix_micros("ts")
        rows = ready = waiting.filter(closed_by(mark) & ~closed_by(before)).select("scan_id", *_WAITING).withColumns(
            {"rank": F.lit(1), "batch": F.lit(0), "us": us, "ms": F.ceil(us / 1000)}
        ).drop("ts")
        known = None
        if batch_id > 0:
            known = spark.read.schema(f"{JUDGED}, batch int").parquet(path).filter(
                (F.col("batch") < batch_id) & (F.col("kind") != "decided")
            )
            scans = ready.select(F.col("scan_id").alias("_scan")).distinct()
            mine = known.join(scans, F.col("scan_id").eqNullSafe(F.col("_scan")), "left_semi")
            rows = ready.unionByName(mine.select(
                "scan_id", "kind", "request_id", "fingerprint", F.col("latest_event_hash").alias("event_hash"), "incomplete",
                "ms", F.lit(0).alias("rank"), (-F.col("batch")).alias("batch"),
            ), allowMissingColumns=True)
        order = ["scan_id", "rank", "batch", "us", F.col("kind") != "scan", "ord", "request_id"]
        digests = ("fingerprint", "event_hash", "expected_event_hash")  # They move as bytes.
        moved = rows.withColumns({c: audit.packed(F.col(c)) for c in digests}).repartition("scan_id").sortWithinPartitions(*order)
        judged = moved.withColumns({c: audit.unpacked(F.col(c)) for c in digests}).select(*_READY).mapInArrow(
            lambda frames: _judge_sorted(frames, retention), JUDGED
        )
        _save(judged, f"{path}/batch={batch_id}", "kind")
        if known is not None:
            _forget(known, path, ready.agg(F.min("ms")).first()[0], retention)
            done = waiting.filter(F.col("arrived") < batch_id).groupBy("arrived").agg(F.max("closes").alias("closes")).filter(closed_by(before))
            for row in done.collect():
                discard(spark.read.parquet(f"{folder}/waiting/arrived={row['arrived']}"))

    return write


def _save(rows: DataFrame, path: str, *by: str) -> None:
    with released(rows.sparkSession):
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """What ``decision_writer`` judged."""
    return spark.read.schema(f"{JUDGED}, batch int").parquet(f"{folder}/judged").filter("kind = 'decided'").select(*_DECISION_NAMES)


def _judge_sorted(frames: Iterator[pa.RecordBatch], retention: int) -> Iterator[pa.RecordBatch]:
    """One pass over rows sorted by scan; of what is known, the newest version comes first."""
    scan, version, touched = object(), None, False
    latest = incomplete = newest = None
    requests: dict = {}

    def state() -> list[tuple]:
        if not touched:
            return []
        known = [(scan, q, None, None, None, f, None, newest, "request") for q, f in requests.items()]
        return [(scan, None, None, None, latest, None, incomplete, newest, "scan"), *known]

    for frame in frames:
        out = []
        for own, rank, batch, ms, at, kind, request, own_print, new_hash, gate, decision, expected, acknowledged in zip(
            *(c.to_pylist() for c in frame.columns), strict=True
        ):
            if own != scan:
                out += state()
                scan, version, touched = own, None, False
                latest = incomplete = newest = None
                requests = {}
            if rank == 0:
                version = batch if version is None else version
                if batch == version and kind == "scan":
                    latest, incomplete, newest = new_hash, gate, ms
                elif batch == version:
                    requests[request] = own_print
                continue
            if newest is not None and ms - newest >= retention:
                latest = incomplete = None
                requests = {}
            newest, touched = ms, True
            if kind == "scan":
                if latest is None:
                    latest, incomplete = new_hash, bool(gate)
                    requests[request] = own_print
                continue
            if request in requests:
                status = "replay" if requests[request] == own_print else "conflict"
            elif latest is None:
                status = "not_found"
            elif expected != latest:
                status = "stale"
            elif decision == "approve" and incomplete and not acknowledged:
                status = "incomplete"
            else:
                status, latest = "accepted", new_hash
                requests[request] = own_print
            out.append((own, request, at, status, latest, None, None, None, "decided"))
        yield _judged(out)
    yield _judged(state())


def _judged(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_JUDGED_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _JUDGED_SCHEMA, strict=True)], schema=_JUDGED_SCHEMA)


def _forget(known: DataFrame, path: str, first_ms: int | None, retention: int) -> None:
    """Remove versions of scans that were all forgotten before the first row of this batch."""
    if first_ms is None:
        return
    newest = known.groupBy("batch", "kind").agg(F.max("ms").alias("ms")).filter(F.col("ms") + retention <= first_ms)
    for row in newest.collect():
        discard(known.sparkSession.read.parquet(f"{path}/batch={row['batch']}/kind={row['kind']}"))


# --------------------------------------------------------------------- scoring


def score(stream: DataFrame, policy: RiskPolicy | None = None) -> DataFrame:
    """Running score per document over a stream of signal rows.

    Use with update or complete output mode. The policy is part of the plan.
    """
    return risk.score(stream, policy)


# ------------------------------------------------------------------- sequences


_FRAME_NAMES = ["idx", "timestamp_ms", "face_count", "eyes", "usable", "same_face", "contrast", "periodic", "digest"]
#: Groups of sequences that share one state and one call; fixed for the life of a checkpoint.
SEQUENCE_GROUPS = 512


_OPEN = f"open array<struct<seq_id:string,n:bigint,closes_ms:bigint,frames:array<{sequences.FRAME}>>>"


def _gather(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the twelve frames of smallest position of each open sequence, and count the others."""
    gap, most = SEQUENCE_LIMITS["max_timestamp_ms"], SEQUENCE_LIMITS["max_frames"]
    place = lambda f: (f[0] is None, f[0] or 0, f[1] is None, f[1] or 0)
    watermark = state.getCurrentWatermarkMs()
    # By sequence: number of frames, time of closing, frames.
    known = {s[0]: [s[1], s[2], [tuple(f) for f in s[3]]] for s in state.get[0]} if state.exists else {}
    if not state.hasTimedOut:
        for b in batches:
            for row in b["f"]:
                seq, ms, *frame = row.values() if isinstance(row, dict) else row
                entry = known.setdefault(seq, [0, 0, []])
                entry[0] += 1
                entry[1] = max(entry[1], max(ms, watermark) + gap)
                # Whole numbers of a batch with nulls come as floats.
                entry[2].append(tuple(None if v != v else v for v in frame))
                if len(entry[2]) >= 4 * most:
                    entry[2] = sorted(entry[2], key=place)[:most]
    for entry in known.values():
        entry[2] = sorted(entry[2], key=place)[:most]
    done = [seq for seq, entry in known.items() if entry[1] <= watermark]
    closed = [(seq, *known.pop(seq)) for seq in done]
    if known:
        state.update(([(seq, *entry) for seq, entry in known.items()],))
        state.setTimeoutTimestamp(min(entry[1] for entry in known.values()))
    elif state.exists:
        state.remove()
    yield pd.DataFrame({
        "seq_id": pd.Series([c[0] for c in closed], dtype=object), "n": pd.Series([c[1] for c in closed], dtype="int64"),
        "frames": pd.Series([[dict(zip(_FRAME_NAMES, f, strict=True)) for f in c[3]] for c in closed], dtype=object),
    })


def gather_sequences(stream: DataFrame, time: str = "ts", groups: int = SEQUENCE_GROUPS) -> DataFrame:
    """Close a frame sequence when none arrived for the sequence limit.

    State per open sequence is a count and at most twelve frames, those of the smallest
    positions, merged batch by batch. Sequences are dealt to ``groups``, each of which is
    one state and one call a batch, so that a sequence costs no call of its own; a batch
    rewrites the open sequences of the groups that it touches. ``sequences.outcome_of``
    evaluates the result.
    """
    gap = f"{SEQUENCE_LIMITS['max_timestamp_ms'] // 1000} seconds"
    seq_type = dict(stream.dtypes)["seq_id"]
    rows = stream.withWatermark(time, gap).select(
        F.pmod(F.xxhash64("seq_id"), F.lit(groups)).cast("int").alias("_group"), F.col(time).alias("ts"),
        # As text, since pandas makes floats of whole numbers beside nulls.
        F.struct(F.col("seq_id").cast("string").alias("seq_id"), F.unix_millis(F.col(time)).alias("ms"), sequences.frame_struct().alias("_f")).alias("f"),
    ).select("_group", "ts", F.struct("f.seq_id", "f.ms", "f._f.*").alias("f"))
    return rows.groupBy("_group").applyInPandasWithState(
        _gather, f"seq_id string, n long, frames array<{sequences.FRAME}>", _OPEN, "append", GroupStateTimeout.EventTimeTimeout
    ).withColumn("seq_id", F.col("seq_id").cast(seq_type))


# ---------------------------------------------------------------------- append


def appender(spark: SparkSession, folder: str, order: list[str], owner: str = ""):
    """``foreachBatch`` function that appends each batch to a log in ``folder``.

    Each batch writes its events and heads below its own number with overwrite, so
    a batch that is repeated after a failure replaces itself. Only batches before
    it are read as history. ``owner`` names the stream, best by its checkpoint: a log
    takes rows from its first owner only.
    """

    def path(table: str, batch_id: int) -> str:
        return f"{folder}/{table}/batch={batch_id}"

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        _own(session, folder, owner)
        head = session.createDataFrame([], "chain_id bigint, seq bigint, event_hash string")
        if batch_id > 0:
            # Batches are numbered without gaps and each one leaves a full head.
            head = session.read.parquet(path(HEAD_TABLE, batch_id - 1))
        events = audit.append(head, batch, order)
        events.write.mode("overwrite").parquet(path(EVENT_TABLE, batch_id))
        written = session.read.schema(audit.EVENT_SCHEMA).parquet(path(EVENT_TABLE, batch_id))
        audit.new_head(head, written).write.mode("overwrite").parquet(path(HEAD_TABLE, batch_id))

    return write


def _own(spark: SparkSession, folder: str, owner: str) -> None:
    """Bind the log to the stream that writes it. A stream with a new checkpoint counts
    its batches from 0 again, and must not replace those of another one."""
    try:
        found = spark.read.schema("owner string").parquet(f"{folder}/owner").first()
    except AnalysisException:
        found = None
    if found is None:
        spark.createDataFrame([(owner,)], "owner string").write.mode("overwrite").parquet(f"{folder}/owner")
    elif found[0] != owner:
        raise ValueError(f"the log belongs to {found[0]!r}; give {owner!r} a folder of its own")


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(audit.EVENT_SCHEMA).parquet(f"{folder}/{EVENT_TABLE}").drop("batch")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocksdb(spark: SparkSession):
    """State on local disks with checkpoints in the shared folder, unless the session
    names a store. A query keeps the store that it began with."""
    own = spark.conf.get(STORE, None)
    default = own is None or own.endswith(".HDFSBackedStateStoreProvider")
    if default:
        spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        if default:
            spark.conf.unset(STORE)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end into a Parquet table and read it back."""
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        with _rocksdb(spark):
            query = writer.format("parquet").option("path", f"{folder}/out").outputMode("append").start()
    else:
        # Update mode has no file sink: each batch is written whole and the
        # newest version of a key wins when reading.
        def save(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(
                f"{folder}/out/run={batch_id}"
            )

        query = writer.outputMode(mode).foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def run_to_writer(stream: DataFrame, folder: str, write) -> None:
    """Run a bounded stream to its end through a ``foreachBatch`` function."""
    with _rocksdb(stream.sparkSession):
        query = (
            stream.writeStream.option("checkpointLocation", f"{folder}/state").outputMode("append")
            .trigger(availableNow=True).foreachBatch(write).start()
        )
    query.awaitTermination()
