"""Queries over the hash-linked audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from idsift.operators import audit
from idsift.plans import oracle as O, views
from idsift.session import discard, materialize, shared_dir

QUERIES: dict = {}
SQL: dict = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


ZERO = audit.ZERO_HASH
_TS = "%Y-%m-%dT%H:%M:%S.000000+00:00"


def new_scans(spark, sf) -> DataFrame:
    """Scan events to append, one per order; one chain per customer."""
    scans = views.log_scans(spark, sf, "o_orderdate").filter(F.col("scan_no").isNotNull())
    missing = F.when(F.col("processing_status") == "ok", F.array().cast("array<string>")).otherwise(
        F.array(F.lit("liveness"))
    )
    payload = audit.canonical(
        [F.col("processing_status"), F.struct(missing.alias("missing_required_signals")).alias("risk")]
    )
    sha = lambda prefix: F.sha2(F.concat(F.lit(prefix), F.col("scan_no").cast("string")), 256)
    return scans.select(
        "chain_id", "scan_no", F.concat(F.lit("evt-"), F.col("scan_no").cast("string")).alias("event_id"),
        "request_id", sha("fp-").alias("fingerprint"), "scan_id", F.lit("scan").alias("kind"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000000+00:00")).alias("timestamp"), "actor",
        sha("doc-").alias("document_hash"), payload.alias("payload_json"),
    )


def empty_head(spark) -> DataFrame:
    return spark.createDataFrame([], "chain_id bigint, seq bigint, event_hash string")


def log(spark, sf) -> DataFrame:
    return audit.append(empty_head(spark), new_scans(spark, sf), ["scan_no"])


_KEPT: dict[tuple, DataFrame] = {}


def kept(spark, sf, name: str, make, order: tuple = ("scan_id", "seq")) -> DataFrame:
    """The stored log of a table folder, written once per application and folder. Rows
    are sorted by scan inside each file, so a scan's rows are found by file statistics.
    Tables that ``make`` returns beside the rows are removed when those are written."""
    at = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), sf, name)
    if at not in _KEPT:
        rows, *used = made if isinstance(made := make(), tuple) else (made,)
        _KEPT[at] = materialize(rows.sortWithinPartitions(*order) if order else rows, name)
        for table in used:
            discard(table)
    return _KEPT[at]


def stored(spark, sf) -> DataFrame:
    """The log as the stored table it is; readers must not hash it again."""
    return kept(spark, sf, "log", lambda: log(spark, sf))


O.define("new_scans", f"""
SELECT s.chain_id, s.scan_no, 'evt-' || s.scan_no AS event_id, s.request_id, sha256('fp-' || s.scan_no) AS fingerprint, s.scan_id, 'scan' AS kind,
  strftime(o_orderdate, '{_TS}') AS timestamp, s.actor, sha256('doc-' || s.scan_no) AS document_hash,
  '{{"processing_status":"' || processing_status || '","risk":{{"missing_required_signals":' || CASE processing_status WHEN 'ok' THEN '[]' ELSE '["liveness"]' END || '}}}}' AS payload_json,
  row_number() OVER (PARTITION BY s.chain_id ORDER BY s.scan_no) AS seq
FROM log_scans s JOIN orders o ON o.o_orderkey = s.scan_no""")


def _hash(prev: str, t: str = "n") -> str:
    esc = f"replace({t}.payload_json, '\"', '\\\"')"
    return (
        f"sha256('{{\"actor\":\"' || {t}.actor || '\",\"document_hash\":\"' || {t}.document_hash || '\",\"event_id\":\"' || {t}.event_id || '\",\"fingerprint\":\"' || {t}.fingerprint"
        f" || '\",\"kind\":\"' || {t}.kind || '\",\"payload_json\":\"' || {esc} || '\",\"previous_hash\":\"' || {prev} || '\",\"request_id\":\"' || {t}.request_id"
        f" || '\",\"scan_id\":\"' || {t}.scan_id || '\",\"seq\":' || {t}.seq || ',\"timestamp\":\"' || {t}.timestamp || '\"}}')"
    )


def chained(final: str, **local: str) -> str:
    """Queries over ``log``, which is a recursive expression."""
    body = O.query(final, log=f"""
SELECT n.*, '{ZERO}' AS previous_hash, {_hash(f"'{ZERO}'")} AS event_hash FROM new_scans n WHERE seq = 1
UNION ALL SELECT n.*, l.event_hash AS previous_hash, {_hash('l.event_hash')} AS event_hash FROM new_scans n JOIN log l ON l.chain_id = n.chain_id AND n.seq = l.seq + 1""", **local)
    return body.replace("WITH ", "WITH RECURSIVE ", 1)


EVENT = "chain_id, seq, event_id, previous_hash, event_hash"


@query("a1_row_hash", O.query(f"SELECT event_id, {_hash(chr(39) + ZERO + chr(39))} AS h FROM new_scans n"))
def a1(spark, sf):
    # Numbers per chain come from the log itself.
    rows = log(spark, sf).withColumn("previous_hash", F.lit(ZERO))
    return rows.select("event_id", audit.row_hash().alias("h"))


@query("a3_chain_append", chained(f"SELECT {EVENT} FROM log"))
def a3(spark, sf):
    return log(spark, sf).select(*EVENT.split(", "))


@query("a3_chain_head", chained("SELECT chain_id, max(seq) AS seq, arg_max(event_hash, seq) AS event_hash FROM log GROUP BY chain_id"))
def a3h(spark, sf):
    return audit.new_head(empty_head(spark), log(spark, sf))


def damaged(rows: DataFrame) -> DataFrame:
    """The log with edits, deletions and broken links."""
    c, s = F.col("chain_id"), F.col("seq")
    return rows.filter(~((c % 11 == 3) & (s == 2)) & ~((c % 13 == 4) & (s == 1))).withColumn(
        "actor", F.when((c % 7 == 1) & (s == 3), "intruder").otherwise(F.col("actor"))
    ).withColumn(
        "previous_hash", F.when((c % 17 == 5) & (s == 2), ZERO).otherwise(F.col("previous_hash"))
    )


O.define("damaged", f"""
SELECT * REPLACE (CASE WHEN chain_id % 7 = 1 AND seq = 3 THEN 'intruder' ELSE actor END AS actor, CASE WHEN chain_id % 17 = 5 AND seq = 2 THEN '{ZERO}' ELSE previous_hash END AS previous_hash)
FROM log WHERE NOT (chain_id % 11 = 3 AND seq = 2) AND NOT (chain_id % 13 = 4 AND seq = 1)""")
O.define("heads", "SELECT chain_id, CASE WHEN chain_id % 19 = 6 THEN max(seq) - 1 ELSE max(seq) END AS seq, arg_max(event_hash, seq) AS event_hash FROM log GROUP BY chain_id")
O.define("judged_rows", f"""
SELECT *, row_number() OVER w AS pos, seq = row_number() OVER w AND previous_hash = coalesce(lag(event_hash) OVER w, '{ZERO}') AND {_hash('n.previous_hash')} = event_hash AS ok
FROM damaged n WINDOW w AS (PARTITION BY chain_id ORDER BY seq)""")


@query("a2_verify_chains", chained(f"""
SELECT h.chain_id, CASE WHEN bad IS NOT NULL THEN 'EVENT_CHAIN_MISMATCH' WHEN h.seq <> coalesce(n, 0) OR h.event_hash <> coalesce(last, '{ZERO}') THEN 'HEAD_MISMATCH'
    WHEN h.chain_id % 5 = 2 THEN 'TRUSTED_ANCHOR_MISMATCH' END AS error,
  CASE WHEN bad IS NOT NULL THEN bad WHEN h.seq <> coalesce(n, 0) OR h.event_hash <> coalesce(last, '{ZERO}') THEN coalesce(n, 0) + 1 WHEN h.chain_id % 5 = 2 THEN 1 END AS failed_seq, coalesce(n, 0) AS event_count
FROM heads h LEFT JOIN (SELECT chain_id, count(*) AS n, min(pos) FILTER (NOT ok) AS bad, arg_max(event_hash, seq) AS last FROM judged_rows GROUP BY chain_id) j ON j.chain_id = h.chain_id"""))
def a2(spark, sf):
    whole = stored(spark, sf)
    c = F.col("chain_id")
    head = audit.new_head(empty_head(spark), whole).withColumn(
        "seq", F.when(c % 19 == 6, F.col("seq") - 1).otherwise(F.col("seq"))
    )
    anchors = head.filter(c % 5 == 2).select("chain_id", F.lit(1).cast("bigint").alias("seq"), F.lit("f" * 64).alias("event_hash"))
    out = audit.verify(damaged(whole), head, anchors)
    return out.select("chain_id", "error", "failed_seq", "event_count")


@query("a9_guarded_append", chained(f"""
SELECT n.chain_id, n.scan_no, j.bad IS NULL AS taken FROM new_scans n LEFT JOIN (SELECT chain_id, min(pos) FILTER (NOT ok) AS bad FROM judged_rows GROUP BY chain_id) j ON j.chain_id = n.chain_id"""))
def a9(spark, sf):
    """New rows for damaged chains are refused, those for whole chains are taken."""
    whole = stored(spark, sf)
    rows = damaged(whole)
    head = audit.new_head(empty_head(spark), rows)
    good, bad = audit.guard(audit.verify(rows, head), new_scans(spark, sf).select("chain_id", "scan_no"))
    return good.withColumn("taken", F.lit(True)).unionByName(bad.select("chain_id", "scan_no", F.lit(False).alias("taken")))


@query("w9_links", chained(f"""
SELECT d.chain_id, d.seq, CASE WHEN d.seq = 1 THEN d.previous_hash = '{ZERO}' ELSE p.event_hash = d.previous_hash END AS link_ok
FROM damaged d LEFT JOIN damaged p ON p.chain_id = d.chain_id AND p.seq = d.seq - 1"""))
def w9(spark, sf):
    return audit.linked(damaged(stored(spark, sf))).select("chain_id", "seq", "link_ok")


# -------------------------------------------------------------- replays
@query("a4_replay", O.query("""
SELECT l.rid, CASE WHEN stored THEN CASE WHEN fp = known THEN 'replay' ELSE 'conflict' END WHEN rid = first_rid THEN 'new' WHEN fp = first_fp THEN 'replay' ELSE 'conflict' END AS status
FROM (SELECT *, first_value(rid) OVER w AS first_rid, first_value(fp) OVER w AS first_fp FROM requests WINDOW w AS (PARTITION BY req ORDER BY rid)) l""",
    requests="""
SELECT event_id AS rid, 'req-' || user_id AS req, 'fp-' || (event_id % 3) AS fp, user_id % 4 = 0 AS stored, 'fp-1' AS known FROM events"""))
def a4(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    requests = views.table(spark, sf, "events").select(
        e.alias("rid"), F.concat(F.lit("req-"), u.cast("string")).alias("request_id"),
        F.concat(F.lit("fp-"), (e % 3).cast("string")).alias("fingerprint"), e.cast("string").alias("event_id"),
    )
    stored = views.table(spark, sf, "events").filter(u % 4 == 0).select(
        F.concat(F.lit("req-"), u.cast("string")).alias("request_id"), F.lit("fp-1").alias("fingerprint"),
        F.lit("old").alias("event_id"),
    ).distinct()
    return audit.dedupe(stored, requests, "rid").select("rid", "status")


# ------------------------------------------------------------- decisions
O.define("decisions", """
SELECT d.scan_no, d.ord, d.decision, d.acknowledge_incomplete AS ack, CASE WHEN d.scan_no % 50 = 3 THEN 'missing-' ELSE 'scan-' END || d.scan_no AS scan_id,
  (d.scan_no + d.ord) % 5 = 0 AS outdated FROM log_decisions d""")
O.define("decided", """
SELECT *, CASE WHEN s_id IS NULL THEN 'not_found' WHEN ord = won THEN 'accepted' WHEN ord > won THEN 'stale' ELSE early END AS status FROM (
  SELECT *, min(ord) FILTER (early IS NULL) OVER (PARTITION BY scan_no) AS won FROM (
    SELECT d.*, s.scan_id AS s_id, CASE WHEN s.scan_id IS NULL THEN 'not_found' WHEN outdated THEN 'stale' WHEN d.decision = 'approve' AND s.processing_status <> 'ok' AND NOT ack THEN 'incomplete' END AS early
    FROM decisions d LEFT JOIN log_scans s ON s.scan_id = d.scan_id) a) b""")


def decisions(spark, sf, events) -> DataFrame:
    """One batch of decisions per scan, some outdated, some for unknown scans."""
    rows = views.log_decisions(spark, sf)
    no = F.col("scan_no")
    known = events.select(
        F.substring("scan_id", 6, 30).cast("bigint").alias("scan_no"), F.col("event_hash").alias("_h")
    )
    return rows.join(known, "scan_no", "left").select(
        "scan_no", "ord", "decision", "acknowledge_incomplete",
        F.concat(F.when(no % 50 == 3, "missing-").otherwise("scan-"), no.cast("string")).alias("scan_id"),
        F.when((no + F.col("ord")) % 5 == 0, ZERO).otherwise(F.coalesce("_h", F.lit(ZERO))).alias("expected_event_hash"),
        F.concat_ws("-", F.lit("dec"), no.cast("string"), F.col("ord").cast("string")).alias("request_id"),
        F.lit("Reviewed.").alias("note"), F.lit("REVIEWER").alias("actor"),
    )


def batch(spark, sf, events) -> DataFrame:
    """``decisions`` as the stored table that a batch is, since it is read more than once."""
    return kept(spark, sf, "decisions", lambda: decisions(spark, sf, events), ())


@query("a5_accept_decisions", O.query("SELECT scan_no, ord, status FROM decided"))
def a5(spark, sf):
    events = stored(spark, sf)
    return audit.accept(events, batch(spark, sf, events)).select("scan_no", "ord", "status")


@query("a6_incomplete_gate", O.query("SELECT status, decision, ack AS acknowledge_incomplete, count(*) AS n FROM decided GROUP BY ALL"))
def a6(spark, sf):
    events = stored(spark, sf)
    judged = audit.accept(events, batch(spark, sf, events))
    return judged.groupBy("status", "decision", "acknowledge_incomplete").agg(F.count("*").alias("n"))


@query("a7_fingerprint", O.query("""
SELECT doc_id, sha256('{"actor":"' || lang || '","document":"' || sha256(text) || '","document_type":"passport","frames":' || CASE WHEN doc_id % 2 = 0 THEN '["' || sha256(source) || '","' || sha256(lang) || '"]' ELSE 'null' END
  || ',"live":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"' || sha256(source) || '"' END || ',"photo_region":["0.1","0.2"],"reference_date":"2026-10-03","timestamps_ms":null}') AS fingerprint FROM documents"""))
def a7(spark, sf):
    d = F.col("doc_id")
    rows = views.table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("actor"), F.col("text").alias("document"), F.lit("passport").alias("document_type"),
        F.when(d % 2 == 0, F.array("source", "lang")).alias("frames"), F.when(d % 3 != 0, F.col("source")).alias("live"),
        F.array(F.lit("0.1"), F.lit("0.2")).alias("photo_region"), F.lit("2026-10-03").alias("reference_date"),
        F.lit(None).cast("array<string>").alias("timestamps_ms"),
    )
    return rows.select("doc_id", audit.fingerprint().alias("fingerprint"))


@query("a8_public_events", O.query("SELECT event_id, processing_status AS status, CASE processing_status WHEN 'ok' THEN NULL ELSE 'liveness' END AS missing, n.kind, n.actor FROM new_scans n JOIN log_scans s ON s.scan_id = n.scan_id"))
def a8(spark, sf):
    out = audit.public(log(spark, sf))
    return out.select(
        "event_id", F.variant_get("payload", "$.processing_status", "string").alias("status"),
        F.try_variant_get("payload", "$.risk.missing_required_signals[0]", "string").alias("missing"), "kind", "actor",
    )


def full_log(spark, sf) -> DataFrame:
    """Scans plus their accepted decisions, appended as a second batch to whole chains."""
    first = stored(spark, sf)

    def second() -> tuple[DataFrame, ...]:
        judged = audit.accept(first, batch(spark, sf, first))
        rows = audit.decision_events(judged, first).select(
            "chain_id", "scan_no", "event_id", "request_id", "fingerprint", "scan_id", "kind",
            F.lit("2026-10-03T00:00:00.000000+00:00").alias("timestamp"), "actor", "document_hash", "payload_json",
        )
        head = materialize(audit.new_head(empty_head(spark), first), "heads")
        rows, _ = audit.guard(audit.verify(first, head), rows)
        # Stored, so that what their joins moved is gone before they move to their chains.
        rows = materialize(rows, "accepted")
        return audit.append(head, rows, ["scan_no"]), rows, head

    return first.unionByName(kept(spark, sf, "decided", second))


O.define("states", """
SELECT s.scan_id, s.chain_id, n.seq, n.timestamp, s.actor, n.document_hash, coalesce(a.decision, 'pending') AS state, CASE WHEN a.decision IS NOT NULL THEN 'REVIEWER' END AS latest_actor
FROM log_scans s JOIN new_scans n ON n.scan_id = s.scan_id LEFT JOIN (SELECT scan_no, decision FROM decided WHERE status = 'accepted') a ON a.scan_no = s.scan_no""")


def states(spark, sf) -> DataFrame:
    """The maintained states of the log: its scans, then its decisions, merged in."""
    at = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), sf, "states")
    if at not in _KEPT:
        rows, folder = full_log(spark, sf), shared_dir(spark, "states")
        audit.keep_states(spark, folder, stored(spark, sf), 0)
        audit.keep_states(spark, folder, rows.filter("kind = 'decision'"), 1)
        _KEPT[at] = audit.drop_versions(spark, folder)
    return _KEPT[at]


@query("w10_latest_state", O.query("SELECT scan_id, chain_id, seq, state, latest_actor FROM states"))
def w10(spark, sf):
    return audit.latest(full_log(spark, sf)).select("scan_id", "chain_id", "seq", "state", "latest_actor")


@query("a2_verify_full_log", O.query("SELECT chain_id, true AS valid, count(*) + count(*) FILTER (state <> 'pending') AS event_count FROM states GROUP BY chain_id"))
def a2f(spark, sf):
    rows = full_log(spark, sf)
    return audit.verify(rows, audit.new_head(empty_head(spark), rows)).select("chain_id", "valid", "event_count")


# Chains are trusted up to half of their rows. Some are damaged before that place, which
# nothing looks at again unless the trusted row itself is touched, and some after it.
O.define("trusted", "SELECT chain_id, max(seq) // 2 AS base FROM log GROUP BY chain_id")
O.define("resumed_rows", f"""
SELECT n.*, base, seq = base + row_number() OVER w AND previous_hash = coalesce(lag(event_hash) OVER w, base_hash, '{ZERO}') AND {_hash('n.previous_hash')} = event_hash AS ok, base + row_number() OVER w AS pos
FROM (SELECT d.*, t.base, l.event_hash AS base_hash FROM damaged d JOIN trusted t ON t.chain_id = d.chain_id LEFT JOIN log l ON l.chain_id = t.chain_id AND l.seq = t.base WHERE d.seq > t.base) n
WINDOW w AS (PARTITION BY chain_id ORDER BY seq)""")


@query("a2_verify_resumed", chained(f"""
SELECT chain_id, error, CASE WHEN error IS NULL THEN NULL WHEN error = 'TRUSTED_ANCHOR_MISMATCH' THEN base WHEN bad IS NOT NULL THEN bad ELSE base + coalesce(n, 0) + 1 END AS failed_seq,
  base + coalesce(n, 0) AS event_count, coalesce(n, 0) AS hashed FROM (
  SELECT h.chain_id, t.base, n, bad, CASE WHEN t.base > 0 AND x.seq IS NULL THEN 'TRUSTED_ANCHOR_MISMATCH' WHEN bad IS NOT NULL THEN 'EVENT_CHAIN_MISMATCH'
    WHEN h.seq <> t.base + coalesce(n, 0) OR h.event_hash <> coalesce(last, x.event_hash, '{ZERO}') THEN 'HEAD_MISMATCH' END AS error
  FROM heads h JOIN trusted t ON t.chain_id = h.chain_id LEFT JOIN damaged x ON x.chain_id = t.chain_id AND x.seq = t.base
    LEFT JOIN (SELECT chain_id, count(*) AS n, min(pos) FILTER (NOT ok) AS bad, arg_max(event_hash, seq) AS last FROM resumed_rows GROUP BY chain_id) j ON j.chain_id = h.chain_id) q"""))
def a2r(spark, sf):
    whole = stored(spark, sf)
    head = audit.new_head(empty_head(spark), whole)
    half = head.select("chain_id", F.floor(F.col("seq") / 2).alias("seq"))
    trusted = half.join(whole.select("chain_id", "seq", "event_hash"), ["chain_id", "seq"], "left")
    heads = head.withColumn("seq", F.when(F.col("chain_id") % 19 == 6, F.col("seq") - 1).otherwise(F.col("seq")))
    out = audit.verify_resumed(damaged(whole), heads, trusted)
    return out.select("chain_id", "error", "failed_seq", "event_count", "hashed")


@query("k1_history_page", O.query("""
SELECT scan_id, seq, state, (SELECT count(*) FROM states WHERE contains(lower(concat_ws(' ', scan_id, document_hash, actor, coalesce(latest_actor, ''))), 'urgent') AND state = 'pending') AS total FROM states
WHERE contains(lower(concat_ws(' ', scan_id, document_hash, actor, coalesce(latest_actor, ''))), 'urgent') AND state = 'pending' ORDER BY timestamp DESC, chain_id, seq DESC, scan_id LIMIT 50 OFFSET 5"""))
def k1(spark, sf):
    page, total = audit.history_page(states(spark, sf), "URGENT", "pending", 50, 5)
    # Both sides are bounded: one page and one row.
    return page.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k").select(
        "scan_id", "seq", "state", "total"
    )


@query("k2_scan_detail", O.query("""
SELECT event_id, kind FROM new_scans WHERE scan_id = 'scan-100' UNION ALL SELECT 'evt-dec-' || scan_no || '-' || ord, 'decision' FROM decided WHERE status = 'accepted' AND scan_id = 'scan-100'"""))
def k2(spark, sf):
    return audit.scan_detail(full_log(spark, sf), "scan-100").select("event_id", "kind")
