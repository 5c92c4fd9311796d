"""Hash-linked audit log as tables: append, verify, replay, decide, browse.

A chain is serial by nature, so the log is split into chains by ``chain_id``;
chains are independent. Verification needs no order at all: each row names its
predecessor's hash, so rows are compared with their predecessors by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from idsift.session import materialize, released

ZERO_HASH = "0" * 64
# Every stored column but the hash itself, in the order of its canonical text.
HASHED = (
    "actor", "document_hash", "event_id", "fingerprint", "kind", "payload_json", "previous_hash",
    "request_id", "scan_id", "seq", "timestamp",
)
NEW_COLUMNS = tuple(c for c in HASHED if c not in ("previous_hash", "seq"))
# Digests as a rule, which move as bytes.
DIGESTS = ("document_hash", "fingerprint")
EVENT_SCHEMA = (
    "chain_id bigint, seq bigint, event_id string, request_id string, fingerprint string, scan_id string, "
    "kind string, timestamp string, actor string, document_hash string, payload_json string, "
    "previous_hash string, event_hash string"
)


def canonical(columns: list[Column]) -> Column:
    """Compact JSON text; the caller lists columns in key order."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def row_hash() -> Column:
    return F.sha2(canonical([F.col(c) for c in HASHED]), 256)


def fingerprint() -> Column:
    """Digest of a request: content digests, options and actor, nulls kept.

    Region and timestamp numbers are arrays of text, so their spelling is the
    caller's and not a formatter's.
    """
    def sha(name: str) -> Column:
        return F.sha2(F.col(name), 256)

    return F.sha2(
        canonical(
            [
                F.col("actor"), sha("document").alias("document"), F.col("document_type"),
                F.transform("frames", lambda b: F.sha2(b, 256)).alias("frames"), sha("live").alias("live"),
                F.col("photo_region"), F.col("reference_date").cast("string").alias("reference_date"),
                F.col("timestamps_ms"),
            ]
        ),
        256,
    )


def chain_of(scan_id: Column, chains: int) -> Column:
    """Spread scans over a fixed number of chains; a scan stays in one chain."""
    return F.pmod(F.xxhash64(scan_id), F.lit(chains))


# --------------------------------------------------------------------- append


def _inner(columns: list[str]) -> Column:
    """``"key":value`` pairs without the braces."""
    text = canonical([F.col(c) for c in columns])
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number and hash rows that arrive sorted by chain and order.

    Only the current chain's last number and hash are kept, so the length of a
    chain does not matter for memory.
    """
    chain, seq, last = None, 0, ZERO_HASH
    for b in batches:
        seqs, before, hashes = [], [], []
        rows = zip(b.chain_id, b.is_head, b.head_seq, b.event_hash, b.text_a, b.text_b, b.text_c, strict=True)
        for key, is_head, head_seq, head_hash, a, mid, end in rows:
            if key != chain:
                chain, seq, last = key, 0, ZERO_HASH
            if is_head:
                seq, last = int(head_seq), head_hash
                continue
            seq += 1
            text = f'{{{a},"previous_hash":"{last}",{mid},"seq":{seq},{end}}}'
            before.append(last)
            last = hashlib.sha256(text.encode()).hexdigest()
            seqs.append(seq)
            hashes.append(last)
        if not seqs:
            continue
        if len(seqs) < len(b):
            # As objects, since a filtered column of Arrow strings may come in pieces.
            b = b[~b.is_head.astype(bool)].astype(object)
        out = b.assign(seq=seqs, previous_hash=before, event_hash=hashes)
        yield out[[c.split()[0] for c in EVENT_SCHEMA.split(", ")]]


def append(head: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Numbered, linked and hashed events for a batch of new rows.

    ``head``: ``chain_id, seq, event_hash``; ``new``: ``chain_id``, the event
    columns and ``order``. Chains run in parallel; inside a chain rows stream
    through one sorted partition, because each hash needs the one before.
    """
    by = [f"_by_{i}" for i in range(len(order))]
    rows = new.select("chain_id", F.lit(False).alias("is_head"), *NEW_COLUMNS, *[F.col(c).alias(n) for c, n in zip(order, by, strict=True)])
    # A chain's head is its first row, so the only shuffle is the one that brings a chain together.
    heads = head.filter(F.col("chain_id").isNotNull()).select(
        "chain_id", F.lit(True).alias("is_head"), F.col("seq").cast("bigint").alias("head_seq"), "event_hash"
    )
    # Dealt by a hash of the key: dealt by the key itself, it is left out where both parts
    # of the union are dealt so already, though adaptive execution may cut them differently.
    both = rows.unionByName(heads, allowMissingColumns=True).withColumns({c: packed(F.col(c)) for c in DIGESTS})
    ordered = both.repartition(F.xxhash64("chain_id")).sortWithinPartitions(
        "chain_id", F.desc("is_head"), *by
    ).withColumns({c: unpacked(F.col(c)) for c in DIGESTS})
    # The text of a row repeats its columns and is made behind the shuffle and the sort.
    return ordered.select(
        "chain_id", "is_head", "head_seq", "event_hash", *NEW_COLUMNS,
        _inner(["actor", "document_hash", "event_id", "fingerprint", "kind", "payload_json"]).alias("text_a"),
        _inner(["request_id", "scan_id"]).alias("text_b"), _inner(["timestamp"]).alias("text_c"),
    ).mapInPandas(_link, EVENT_SCHEMA)


def new_head(head: DataFrame, appended: DataFrame) -> DataFrame:
    """Head table after an append."""
    rows = head.select("chain_id", "seq", "event_hash").unionByName(
        appended.select("chain_id", "seq", "event_hash")
    )
    return rows.groupBy("chain_id").agg(
        F.max("seq").alias("seq"), F.max_by("event_hash", "seq").alias("event_hash")
    )


# --------------------------------------------------------------------- verify


def linked(events: DataFrame) -> DataFrame:
    """Add ``link_ok``: NULL where the predecessor row is missing.

    A position that is stored more than once has one predecessor hash here, so rows
    are never multiplied; ``verify`` reports the repetition.
    """
    before = events.groupBy("chain_id", (F.col("seq") + 1).alias("seq")).agg(F.min("event_hash").alias("_before"))
    joined = events.join(before, ["chain_id", "seq"], "left")
    expected = F.when(F.col("seq") == 1, F.lit(ZERO_HASH)).otherwise(F.col("_before"))
    return joined.withColumn("link_ok", expected == F.col("previous_hash")).drop("_before")


def verify(events: DataFrame, head: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """One row per chain: ``valid, error, failed_seq, event_count, head_hash``.

    The first failing position wins; then the head, then a trusted anchor
    ``chain_id, seq, event_hash``.
    """
    return _verified(events, row_hash() == F.col("event_hash"), head, anchors)


def packed(digest: Column) -> Column:
    """A text as bytes, a SHA-256 in hex as half as many; different texts stay different."""
    return F.when(digest.rlike(r"\A[0-9a-f]{64}\z"), F.concat(F.unhex(F.lit("01")), F.unhex(digest))).otherwise(
        F.concat(F.unhex(F.lit("00")), F.encode(digest, "UTF-8"))
    )


def unpacked(moved: Column) -> Column:
    rest = F.substring(moved, 2, 1 << 30)
    return F.when(F.substring(moved, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def _verified(events: DataFrame, hash_ok: Column, head: DataFrame, anchors: DataFrame | None) -> DataFrame:
    # Rows are hashed and parsed where they are stored. What moves is each row's link, to its
    # own position, and its hash, to the next one; positions are judged by aggregates.
    nothing = F.lit(None).cast("binary")
    own = F.struct(
        F.col("seq").cast("bigint").alias("seq"), F.lit(1).alias("own"), F.lit(0).alias("follows"), packed(F.col("previous_hash")).alias("link"),
        nothing.alias("before"), F.when(~hash_ok, 1).otherwise(0).alias("bad"),
        F.when(F.try_parse_json("payload_json").isNull(), 1).otherwise(0).alias("unreadable"),
    )
    next_one = F.struct(
        (F.col("seq") + 1).cast("bigint").alias("seq"), F.lit(0).alias("own"), F.lit(1).alias("follows"), nothing.alias("link"),
        packed(F.col("event_hash")).alias("before"), F.lit(0).alias("bad"), F.lit(0).alias("unreadable"),
    )
    both = events.filter(F.col("chain_id").isNotNull()).select("chain_id", F.inline(F.array(own, next_one)))
    positions = both.groupBy("chain_id", "seq").agg(
        F.sum("own").alias("own"), F.sum("follows").alias("follows"), F.min("link").alias("least"), F.max("link").alias("most"),
        F.min("before").alias("before"), F.max("bad").alias("bad"), F.max("unreadable").alias("unreadable"),
    )
    expected = F.when(F.col("seq") == 1, packed(F.lit(ZERO_HASH))).when(F.col("seq").isNotNull(), F.col("before"))
    unlinked = F.coalesce((F.col("least") != expected) | (F.col("most") != expected), F.lit(False))
    problem = F.when(unlinked | (F.col("bad") == 1), F.struct("seq", F.lit(0).alias("kind"))).when(
        F.col("unreadable") == 1, F.struct("seq", F.lit(1).alias("kind"))
    )
    per_chain = positions.groupBy("chain_id").agg(
        F.sum("own").alias("_n"), F.min(F.when(F.col("own") > 0, F.col("seq"))).alias("_first"),
        F.min(F.when(F.col("own") > 0, problem)).alias("_problem"),
        unpacked(F.max_by("before", F.when(F.col("follows") > 0, F.col("seq")))).alias("_last"),
        # A position that nothing follows, and one that is stored again, which breaks the count at the next one.
        F.min(F.when(F.col("own") == 0, F.col("seq") - 1)).alias("_end"),
        F.min(F.when(F.col("own") > 1, F.struct((F.col("seq") + 1).alias("seq"), F.lit(0).alias("kind")))).alias("_again"),
    )
    heads = head.select("chain_id", F.col("seq").alias("_head_seq"), F.col("event_hash").alias("_head_hash"))
    every = per_chain.join(heads, "chain_id", "full")
    n = F.coalesce("_n", F.lit(0))
    # First position without its number; a failure only if rows follow it.
    missing = F.when(F.col("_first") != 1, F.lit(1)).otherwise(F.col("_end") + 1)
    gap = F.when(missing <= n, F.struct(missing.cast("bigint").alias("seq"), F.lit(0).alias("kind")))
    first = F.least(F.col("_problem"), gap, F.col("_again"))
    last = F.when(n == 0, ZERO_HASH).otherwise(F.col("_last"))
    staged = every.select(
        "chain_id", n.alias("event_count"), last.alias("head_hash"), first.alias("_failure"),
        (F.col("_head_seq").eqNullSafe(n) & F.col("_head_hash").eqNullSafe(last)).alias("_head_ok"),
    )
    if anchors is not None:
        wanted = anchors.select(
            "chain_id", F.col("seq").alias("_anchor_seq"), F.col("event_hash").alias("_anchor_hash")
        )
        stored = events.select("chain_id", F.col("seq").alias("_anchor_seq"), F.col("event_hash").alias("_stored"))
        found = wanted.join(stored, ["chain_id", "_anchor_seq"], "left").select(
            "chain_id", "_anchor_seq",
            (F.when(F.col("_anchor_seq") == 0, ZERO_HASH).otherwise(F.col("_stored")).eqNullSafe(F.col("_anchor_hash"))).alias("_anchor_ok"),
        )
        staged = staged.join(found, "chain_id", "left")
    else:
        staged = staged.withColumn("_anchor_seq", F.lit(None).cast("bigint")).withColumn(
            "_anchor_ok", F.lit(None).cast("boolean")
        )
    failure = F.col("_failure")
    error = (
        F.when(failure.isNotNull(), F.when(failure["kind"] == 0, "EVENT_CHAIN_MISMATCH").otherwise("INVALID_PAYLOAD"))
        .when(~F.col("_head_ok"), "HEAD_MISMATCH")
        .when(~F.col("_anchor_ok"), "TRUSTED_ANCHOR_MISMATCH")
    )
    position = (
        F.when(failure.isNotNull(), failure["seq"]).when(~F.col("_head_ok"), F.col("event_count") + 1)
        .when(~F.col("_anchor_ok"), F.col("_anchor_seq"))
    )
    return staged.select(
        "chain_id", error.isNull().alias("valid"), error.alias("error"), position.alias("failed_seq"),
        "event_count", "head_hash", F.col("_anchor_seq").isNotNull().alias("anchor_checked"),
    )


def trusted_prefix(verified: DataFrame) -> DataFrame:
    """What a verification leaves to the next one: ``chain_id, seq, event_hash`` of the
    last row of every chain that it found valid."""
    return verified.filter("valid").select(
        "chain_id", F.col("event_count").alias("seq"), F.col("head_hash").alias("event_hash")
    )


def verify_resumed(events: DataFrame, head: DataFrame, trusted: DataFrame) -> DataFrame:
    """``verify`` from each chain's trusted row on: the columns of ``verify`` and
    ``hashed``, the number of rows whose hash was computed.

    ``trusted``: ``chain_id, seq, event_hash``, as ``trusted_prefix`` leaves it and as it
    is kept apart from the log. Rows up to it are not hashed or parsed; of them only the
    row at the trusted position is looked up, and must still have the trusted hash. Since
    every row names its predecessor's hash, an edit before that position can't reach the
    rows after it without changing that hash. Later rows are verified as a chain of their
    own that begins there. A chain without a trusted row is verified as a whole.
    """
    known = trusted.select(
        "chain_id", F.col("seq").alias("_base"), F.when(F.col("seq") == 0, F.lit(ZERO_HASH)).otherwise(F.col("event_hash")).alias("_base_hash")
    )
    # One small row per chain.
    rows = events.join(known, "chain_id", "left").withColumn("_base", F.coalesce("_base", F.lit(0)))
    later = rows.filter(F.col("seq") > F.col("_base"))
    # The first later row must name the trusted hash; then it counts as a chain's first.
    first = F.col("seq") == F.col("_base") + 1
    linked_to = F.when(first & (F.col("previous_hash") == F.coalesce("_base_hash", F.lit(ZERO_HASH))), F.lit(ZERO_HASH)).when(
        first, F.lit("")
    ).otherwise(F.col("previous_hash"))
    renumbered = later.select(
        *[c for c in events.columns if c not in ("seq", "previous_hash")], (F.col("seq") - F.col("_base")).alias("seq"),
        linked_to.alias("previous_hash"), (row_hash() == F.col("event_hash")).alias("_hash_ok"),
    )
    stored = events.select("chain_id", F.col("seq").alias("_base"), F.col("event_hash").alias("_found")).join(
        known, ["chain_id", "_base"], "left_semi"
    ).groupBy("chain_id", "_base").agg(F.min("_found").alias("_found"), F.count("*").alias("_times"))
    prefix = known.join(stored, ["chain_id", "_base"], "left").select(
        "chain_id", "_base", "_base_hash",
        (
            (F.col("_base") == 0)
            | (F.col("_found").eqNullSafe(F.col("_base_hash")) & F.coalesce(F.col("_times") == 1, F.lit(False)))
        ).alias("_kept"),
    )
    heads = head.join(known, "chain_id", "left").select(
        "chain_id", (F.col("seq") - F.coalesce("_base", F.lit(0))).alias("seq"),
        F.when(F.col("seq") == F.coalesce("_base", F.lit(0)), F.when(F.col("event_hash").eqNullSafe(F.coalesce("_base_hash", F.lit(ZERO_HASH))), ZERO_HASH))
        .otherwise(F.col("event_hash")).alias("event_hash"),
    )
    judged = _verified(renumbered, F.col("_hash_ok"), heads, None)
    every = judged.join(prefix, "chain_id", "full")
    base, count = F.coalesce("_base", F.lit(0)), F.coalesce("event_count", F.lit(0))
    kept = F.coalesce("_kept", F.lit(True))
    # Without later rows and without a head, only the prefix is left to stand.
    error = F.when(~kept, "TRUSTED_ANCHOR_MISMATCH").otherwise(
        F.when(F.col("event_count").isNull(), F.when(base > 0, "HEAD_MISMATCH")).otherwise(F.col("error"))
    )
    position = F.when(~kept, base).when(F.col("event_count").isNull(), base + 1).otherwise(F.col("failed_seq") + base)
    return every.select(
        "chain_id", error.isNull().alias("valid"), error.alias("error"), F.when(error.isNotNull(), position).alias("failed_seq"),
        (count + base).cast("bigint").alias("event_count"),
        F.when(count == 0, F.coalesce("_base_hash", F.lit(ZERO_HASH))).otherwise(F.col("head_hash")).alias("head_hash"),
        F.col("_base").isNotNull().alias("anchor_checked"), count.cast("bigint").alias("hashed"),
    )


INTEGRITY = "AUDIT_INTEGRITY"


def guard(verified: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of chains that ``verify`` found valid or doesn't know yet, and the others with
    a reason: nothing is appended to, or read from, a chain that fails its check. Their keys
    are stored, so that Spark knows how few they are and need not move the rows to them."""
    bad = materialize(verified.filter(~F.col("valid")).select("chain_id"), "refused")
    refused = rows.join(bad, "chain_id", "left_semi").withColumn("reason", F.lit(INTEGRITY))
    return rows.join(bad, "chain_id", "left_anti"), refused


def decision_events(accepted: DataFrame, state: DataFrame) -> DataFrame:
    """Accepted decisions as rows to append: each names the event that it supersedes, and
    that its actor is not verified. ``state``: ``scan_id, chain_id, document_hash``."""
    payload = canonical([
        F.col("acknowledge_incomplete"), F.lit(False).alias("actor_verified"), F.col("decision"), F.col("note"),
        F.col("expected_event_hash").alias("supersedes_event_hash"),
    ])
    chain = state.select("scan_id", "chain_id", packed(F.col("document_hash")).alias("_doc"))
    rest = [c for c in accepted.columns if c not in ("scan_id", "chain_id", "document_hash", "payload_json", "kind", "event_id")]
    return accepted.filter(F.col("status") == "accepted").join(chain, "scan_id").select(
        "chain_id", "scan_id", F.concat(F.lit("evt-"), "request_id").alias("event_id"), F.lit("decision").alias("kind"),
        unpacked(F.col("_doc")).alias("document_hash"), payload.alias("payload_json"), *rest,
    )


# ------------------------------------------------------------ replay, decisions


def dedupe(events: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Add ``status`` (``new``, ``replay``, ``conflict``) and ``stored_event_id``.

    A known request with the same fingerprint is a replay, another fingerprint a
    conflict; within the batch the first request counts as known to later ones.
    """
    stored = events.select(
        "request_id", F.col("fingerprint").alias("_known"), F.col("event_id").alias("stored_event_id")
    )
    # One small row per request is found by aggregation and joined back, so a
    # request repeated very often is never sorted in one place.
    first = new.groupBy("request_id").agg(
        F.min_by(F.struct(F.col(order).alias("at"), "fingerprint", "event_id"), F.col(order)).alias("_first")
    )
    joined = new.join(first, "request_id").join(stored, "request_id", "left")
    mine = F.col("_first.at") == F.col(order)
    reference = F.coalesce("_known", "_first.fingerprint")
    status = F.when(F.col("_known").isNull() & mine, "new").when(
        F.col("fingerprint") == reference, "replay"
    ).otherwise("conflict")
    return joined.withColumn("status", status).withColumn(
        "stored_event_id",
        F.when(status == "replay", F.coalesce("stored_event_id", "_first.event_id")),
    ).drop("_known", "_first")


PAYLOAD = "struct<processing_status:string,risk:struct<missing_required_signals:array<string>>>"


def latest(events: DataFrame) -> DataFrame:
    """State per scan: the scan event, its newest decision and newest hash."""
    return events.groupBy("scan_id").agg(*_newest()).select("scan_id", *_state())


def _newest() -> list[Column]:
    """Aggregates over a scan's events; rows without a kind and a number take no part."""
    decision, scan = F.col("kind") == "decision", F.col("kind") == "scan"
    body = F.from_json("payload_json", "struct<decision:string>")
    return [
        F.max(F.when(scan, F.struct("seq", "chain_id", "event_id", "actor", "document_hash", "payload_json", "timestamp"))).alias("s"),
        F.max_by(F.struct(body["decision"].alias("decision"), "actor"), F.when(decision, F.col("seq"))).alias("d"),
        F.max_by("event_hash", "seq").alias("latest_event_hash"),
        F.min_by("kind", "seq").alias("first_kind"),
    ]


def _state() -> list[Column]:
    """The columns of a state from the aggregates."""
    scan = ("seq", "chain_id", "event_id", "actor", "document_hash", "payload_json", "timestamp")
    return [
        *[F.col(f"s.{c}").alias(c) for c in scan],
        F.coalesce("d.decision", F.lit("pending")).alias("state"), F.col("d.actor").alias("latest_actor"),
        F.col("latest_event_hash"), F.col("first_kind"),
    ]


def decision_fingerprint() -> Column:
    return F.sha2(
        canonical(
            [F.col(c) for c in ("acknowledge_incomplete", "actor", "decision", "expected_event_hash", "note", "scan_id")]
        ),
        256,
    )


def incomplete(payload: Column) -> Column:
    body = F.from_json(payload, PAYLOAD)
    return (
        (F.size(body["risk"]["missing_required_signals"]) > 0) | (body["processing_status"] != "ok")
    )


def accept(events: DataFrame, decisions: DataFrame, order: str = "ord") -> DataFrame:
    """Judge a batch of decisions: ``accepted``, ``replay``, ``conflict``,
    ``not_found``, ``stale`` or ``incomplete``, in that order of checks.

    A decision quotes the hash of the scan's newest event. That hash changes with
    the first accepted decision, and nobody can quote a hash that was not yet
    published, so at most one decision per scan and batch is accepted: the first
    that passes. This is an aggregate per scan, not a serial fold.
    """
    scan = F.col("kind") == "scan"
    # Payloads are read where they are stored; one small row per scan moves.
    state = events.select(
        "scan_id", "seq", "kind", packed(F.col("event_hash")).alias("event_hash"),
        F.when(scan, F.struct("seq", "chain_id", "event_id", incomplete(F.col("payload_json")).alias("incomplete"))).alias("scan"),
    ).groupBy("scan_id").agg(
        F.max("scan").alias("scan"), F.max_by("event_hash", "seq").alias("latest_event_hash"), F.min_by("kind", "seq").alias("first_kind")
    ).filter(F.col("first_kind") == "scan").select("scan_id", "latest_event_hash", F.col("scan.incomplete").alias("_incomplete"))
    # Few requests are stored already or come for more than one scan. They are found from
    # ids alone, so that the rows themselves are dealt once, by scan.
    ids = decisions.filter(F.col("request_id").isNotNull()).groupBy("request_id").agg((F.countDistinct("scan_id") > 1).alias("shared"))
    special = materialize(
        ids.join(events.select("request_id", F.lit(True).alias("stored")).distinct(), "request_id", "left").withColumn(
            "stored", F.coalesce("stored", F.lit(False))
        ).filter("shared or stored"),
        "requests",
    )
    repeated = special.filter("stored").select("request_id")
    stored = materialize(
        events.select("request_id", F.col("fingerprint").alias("_known")).join(repeated, "request_id", "left_semi"), "known"
    )
    # Hashes move as bytes.
    digests = ("expected_event_hash", "latest_event_hash")
    moved = decisions.withColumn("expected_event_hash", packed(F.col("expected_event_hash"))).join(state, "scan_id", "left")
    joined = moved.withColumns({c: unpacked(F.col(c)) for c in digests}).withColumn("fingerprint", decision_fingerprint()).join(
        stored, "request_id", "left"
    )
    found = F.col("latest_event_hash").isNotNull()
    blocked = (F.col("decision") == "approve") & F.col("_incomplete") & ~F.col("acknowledge_incomplete")
    early = (
        F.when(F.col("_known").isNotNull(), F.when(F.col("_known") == F.col("fingerprint"), "replay").otherwise("conflict"))
        .when(~found, "not_found")
        .when(F.col("latest_event_hash") != F.col("expected_event_hash"), "stale")
        .when(blocked, "incomplete")
    )
    judged = joined.withColumn("_early", early)
    lost, shared = None, not special.filter("shared").isEmpty()
    while True:
        free = judged.filter(F.col("_early").isNull())
        if lost is not None:
            free = free.join(lost, ["request_id", "scan_id"], "left_anti")
        winners = free.groupBy("scan_id").agg(
            F.min_by(F.struct(F.col(order).alias("at"), "request_id", "fingerprint"), F.col(order)).alias("_won")
        )
        if not shared:
            break
        # One request may win for one scan: the earliest, then the lowest scan.
        by_request = winners.groupBy(F.col("_won.request_id").alias("request_id")).agg(
            F.min(F.struct(F.col("_won.at").alias("at"), "scan_id")).alias("_kept"), F.count("*").alias("_scans")
        ).filter("_scans > 1")
        more = winners.select("scan_id", F.col("_won.request_id").alias("request_id")).join(by_request, "request_id").filter(
            F.col("scan_id") != F.col("_kept.scan_id")
        ).select("request_id", "scan_id")
        if more.isEmpty():
            break
        lost = more if lost is None else lost.union(more)
    if lost is not None:
        marks = lost.distinct().withColumn("_lost", F.lit(True))
        judged = judged.join(marks, ["request_id", "scan_id"], "left").withColumn(
            "_early", F.coalesce("_early", F.when(F.col("_lost"), "conflict"))
        ).drop("_lost")
    decided = judged.join(winners, "scan_id", "left")
    won = F.col("_won.at")
    same_request = F.col("_won.request_id") == F.col("request_id")
    status = (
        F.when(F.col("_early").isin("replay", "conflict", "not_found"), F.col("_early"))
        .when(F.col(order) == won, "accepted")
        .when(
            (F.col(order) > won) & same_request,
            F.when(F.col("_won.fingerprint") == F.col("fingerprint"), "replay").otherwise("conflict"),
        )
        .when(F.col(order) > won, "stale")
        .otherwise(F.col("_early"))
    )
    return decided.withColumn("status", status).drop("_known", "_early", "_won", "_incomplete")


# --------------------------------------------------------------------- browse


STATE_PARTS = 64
# Columns of a state beside its scan, in the order of ``_state``.
STATE_SCHEMA = (
    "seq bigint, chain_id bigint, event_id string, actor string, document_hash string, payload_json string, "
    "timestamp string, state string, latest_actor string, latest_event_hash string, first_kind string"
)
_STATE_PACKED = "struct<" + STATE_SCHEMA.replace("_hash string", "_hash binary").replace(" ", ":").replace(",:", ",") + ">"


def merged_states(states: DataFrame | None, events: DataFrame) -> DataFrame:
    """``latest`` of old and new events from the old ones' ``states`` and the new events
    alone, with the ``part`` of the state table. New events come after the old ones of their
    scan. Both are dealt by part, once; an unknown scan of each is a row of its own."""
    part = F.pmod(F.xxhash64("scan_id"), F.lit(STATE_PARTS)).cast("int").alias("part")
    used = ("scan_id", "kind", "seq", "chain_id", "event_id", "actor", "document_hash", "payload_json", "timestamp", "event_hash")
    names = [c.split()[0] for c in STATE_SCHEMA.split(", ")]
    # Hashes move as bytes.
    pack = lambda rows, *own: rows.withColumns({c: packed(F.col(c)) for c in own})
    rows = pack(events.select(part, *used), "document_hash", "event_hash")
    if states is not None:
        old = pack(states.select(part, "scan_id", *names), "document_hash", "latest_event_hash")
        rows = rows.unionByName(old.select("part", "scan_id", F.struct(*names).alias("old")), allowMissingColumns=True)
    else:
        rows = rows.withColumn("old", F.lit(None).cast(_STATE_PACKED))
    side = F.when(F.col("scan_id").isNull(), F.col("old").isNull())
    dealt = rows.repartition("part").withColumns({c: unpacked(F.col(c)) for c in ("document_hash", "event_hash")})
    grouped = dealt.groupBy("part", "scan_id", side.alias("_side")).agg(F.first("old", ignorenulls=True).alias("old"), *_newest())
    old_first = {"seq", "chain_id", "event_id", "actor", "document_hash", "payload_json", "timestamp", "first_kind"}

    def pick(name: str, fresh: Column) -> Column:
        old = F.col(f"old.{name}")
        if name in ("document_hash", "latest_event_hash"):
            old = unpacked(old)
        if name in old_first:
            return F.coalesce(old, fresh)
        if name == "state":
            return F.when(fresh == "pending", F.coalesce(old, F.lit("pending"))).otherwise(fresh)
        return F.coalesce(fresh, old)

    return grouped.select("part", "scan_id", *[pick(n, c).alias(n) for n, c in zip(names, _state(), strict=True)])


def state_table(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The maintained states of ``keep_states``, those of earlier batches than ``before``
    if that is given, or None before the first batch."""
    try:
        rows = spark.read.parquet(folder)
    except AnalysisException:
        return None
    rows = rows if before is None else rows.filter(F.col("version") < before)
    # Folder names tell the newest version of each part; no file is read for that.
    newest = rows.groupBy("part").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["part", "version"]).drop("version")


def keep_states(spark: SparkSession, folder: str, events: DataFrame, batch: int) -> DataFrame:
    """Merges a batch of events into the state table below ``folder``.

    The table has STATE_PARTS parts by scan. Only parts that hold a scan of the batch are
    read, and written as version ``batch``, so a batch that is repeated replaces itself.
    Versions before the last are left for readers; ``drop_versions`` removes them when none
    is at work.
    """
    part = F.pmod(F.xxhash64("scan_id"), F.lit(STATE_PARTS)).cast("int")
    touched = [r[0] for r in events.select(part).distinct().collect()]  # STATE_PARTS numbers at most
    old = state_table(spark, folder, batch) if batch else None
    if old is not None:
        old = old.filter(F.col("part").isin(touched)).drop("part")
    parted = merged_states(old, events).withColumn("version", F.lit(batch))
    options = {"partitionOverwriteMode": "dynamic", "compression": "zstd"}
    with released(spark):
        parted.write.mode("overwrite").options(**options).partitionBy("part", "version").parquet(folder)
    return state_table(spark, folder)


def drop_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Removes the versions of parts that a later one has replaced, once nothing reads them,
    and returns the states anew: tables read before name files that are gone."""
    kept: dict[int, list[int]] = {}
    for part, version in spark.read.parquet(folder).select("part", "version").distinct().collect():
        kept.setdefault(part, []).append(version)
    context = spark.sparkContext
    for part, versions in kept.items():
        for version in sorted(versions)[:-1]:
            path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/part={part}/version={version}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return state_table(spark, folder)


def history(
    events: DataFrame, query: str = "", decision: str | None = None, limit: int = 20, offset: int = 0
) -> tuple[DataFrame, DataFrame]:
    """A page of scans, newest first, and the total before paging, from the events."""
    return history_page(latest(events), query, decision, limit, offset)


def history_page(
    states: DataFrame, query: str = "", decision: str | None = None, limit: int = 20, offset: int = 0, after: tuple | None = None
) -> tuple[DataFrame, DataFrame]:
    """A page of scans, newest first, and the total before paging, from their states.

    ``after``: ``timestamp, chain_id, seq, scan_id`` of the last row of the page before. The
    page then begins behind that row, and no earlier row is sorted to be skipped.
    """
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1..100 and offset not negative")
    text = F.lower(
        F.concat_ws(" ", "scan_id", "document_hash", "actor", F.coalesce("latest_actor", F.lit("")))
    )
    matching = states.filter(F.col("seq").isNotNull() & F.contains(text, F.lit(query.lower())))
    if decision is not None:
        matching = matching.filter(F.col("state") == decision)
    rest = matching
    if after is not None:
        behind, same = F.lit(False), F.lit(True)
        for name, value, falling in zip(("timestamp", "chain_id", "seq", "scan_id"), after, (True, False, True, False), strict=True):
            column = F.col(name)
            behind = behind | (same & (column < value if falling else column > value))
            same = same & (column == value)
        rest = matching.filter(behind)
    page = rest.orderBy(F.desc("timestamp"), "chain_id", F.desc("seq"), "scan_id").offset(offset).limit(limit)
    return page.drop("payload_json", "first_kind", "part"), matching.agg(F.count("*").alias("total"))


def scan_detail(events: DataFrame, scan_id: str) -> DataFrame:
    """All events of one scan in order."""
    return events.filter(F.col("scan_id") == scan_id).orderBy("seq")


def public(events: DataFrame) -> DataFrame:
    """Events without fingerprint and raw text, with the payload parsed."""
    return events.select(
        *[c for c in events.columns if c not in ("payload_json", "fingerprint")],
        F.try_parse_json("payload_json").alias("payload"),
    )
