"""Input views derived from the driver tables.

The driver tables hold no documents, so these views turn each row into the kind
of record an operator expects. All of them are narrow (no window, no join) apart
from ``scored``, which joins two tables on their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from idsift.operators import lists, mrz
from idsift.session import kept

# Shared by Spark and DuckDB; {table} is the only placeholder.
IDS_SQL = """
SELECT c_custkey AS doc_id,
  split_part('EXAMPLE,SAMPLE,MOCK,TEST,DEMO,FICTION', ',', CAST(c_custkey % 6 AS INT) + 1) AS surname,
  split_part('ADA,ROBIN,SAM,ALEX,KAI', ',', CAST(c_custkey % 5 AS INT) + 1) AS given_names,
  CASE WHEN c_custkey % 20 = 9 THEN '12345' ELSE concat('Z', lpad(CAST(c_custkey AS STRING), 7, '0')) END AS number,
  CASE WHEN c_custkey % 97 = 5 THEN 'ZZZ' ELSE 'UTO' END AS country,
  DATE '1950-01-01' + CAST((c_custkey * 37) % 25000 AS INT) AS dob,
  DATE '2020-01-01' + CAST((c_custkey * 13) % 6000 AS INT) AS expiry,
  DATE '2020-01-01' + CAST((c_custkey * 13) % 6000 - 3652 AS INT) AS issue,
  split_part('M,F,X', ',', CAST(c_custkey % 3 AS INT) + 1) AS gender,
  CAST(c_custkey % 20 AS INT) AS variant
FROM {customer}"""

REF_SQL = """
SELECT 'UTO' AS country, concat('Z', lpad(CAST(c_custkey AS STRING), 7, '0')) AS number,
  c_custkey % 50 = 7 AS blacklisted, CAST(c_custkey % 5 + 1 AS INT) AS seen_count
FROM {customer} WHERE c_custkey % 50 = 7 OR c_custkey % 30 = 2"""

SCORED_SQL = """
SELECT d.doc_id, d.lang AS cohort, d.source AS grp, l.quality = 1 AS truth,
  CAST((d.doc_id * 7919) % 100 AS DOUBLE) / 100 AS score,
  CASE WHEN l.quality = 0 THEN 'clean' WHEN d.doc_id % 3 = 0 THEN 'text_replacement'
       WHEN d.doc_id % 3 = 1 THEN 'copy_move' ELSE 'stamp_edit' END AS attack
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id"""

SCANS_SQL = """
SELECT o_orderkey AS scan_no, o_custkey AS chain_id, concat('scan-', CAST(o_orderkey AS STRING)) AS scan_id,
  concat('req-', CAST(o_orderkey AS STRING)) AS request_id, o_orderpriority AS actor,
  CASE o_orderstatus WHEN 'F' THEN 'ok' ELSE 'insufficient_evidence' END AS processing_status
FROM {orders}"""

DECISIONS_SQL = """
SELECT l_orderkey AS scan_no, l_linenumber AS ord,
  CASE max(l_returnflag) WHEN 'R' THEN 'reject' WHEN 'A' THEN 'approve' ELSE 'secondary_inspection' END AS decision,
  min(l_suppkey) % 2 = 0 AS acknowledge_incomplete
FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""

MANIFEST_SQL = """
SELECT doc_id, source AS grp, text AS content, CASE WHEN doc_id % 17 = 0 THEN 'test' ELSE NULL END AS split,
  CASE WHEN doc_id % 5 = 0 THEN 'clean' ELSE 'copy_move' END AS attack, doc_id % 5 <> 0 AS mask_nonempty
FROM {documents}"""

CELLS_SQL = """
SELECT l_orderkey % 100 AS image_id, l_partkey % 64 AS x, l_suppkey % 64 AS y,
  l_discount * 10 AS v, l_returnflag = 'R' AS truth, l_quantity AS energy, l_tax * 100 AS err
FROM {lineitem}"""

GLYPHS_SQL = """
SELECT l_suppkey AS image_id, l_partkey % 600 AS cx, l_linenumber * 4 AS cy,
  CAST(4 + CAST(l_quantity AS INT) % 33 AS INT) AS h, CAST(2 + l_partkey % 29 AS INT) AS w
FROM {lineitem}"""

FEATURES_SQL = """
SELECT p_partkey AS doc_id, p_size * 40 AS width, p_size * 25 AS height, p_retailprice / 20 AS laplacian_variance,
  p_retailprice / 8 AS brightness, CAST(p_partkey % 100 AS DOUBLE) / 100 AS saturated_fraction
FROM {part}"""

# Each block of 24 events makes two sequences whose lengths add up to 24, so
# lengths run from 5 to 19 and no ordering window is needed.
FRAMES_SQL = """
SELECT CASE WHEN event_id % 24 < 5 + blk % 15 THEN blk * 2 ELSE blk * 2 + 1 END AS seq_id,
  CAST((CASE WHEN event_id % 24 < 5 + blk % 15 THEN event_id % 24 ELSE event_id % 24 - 5 - blk % 15 END) * (1 + blk % 3) + blk % 4 * 7 AS INT) AS idx,
  CAST(event_id % 24 * 100 + CASE WHEN blk % 9 = 0 AND event_id % 24 = 4 THEN 2000 ELSE 0 END
       - CASE WHEN event_id % 24 < 5 + blk % 15 THEN 0 ELSE (5 + blk % 15) * 100 END AS DOUBLE) AS timestamp_ms,
  CAST(1 + CASE WHEN event_id % 43 = 0 THEN 1 ELSE 0 END AS INT) AS face_count,
  CASE WHEN event_type = 'purchase' OR blk % 4 = 1 AND event_id % 24 = 2 THEN 0
       WHEN event_type = 'error' AND blk % 4 <> 1 THEN 1 ELSE 2 END AS eyes_visible,
  event_id % 29 <> 0 AS quality_ok, event_id % 31 <> 0 AS same_face_as_first,
  value AS texture_contrast, value / 500.0 AS periodic_energy_ratio,
  CASE WHEN blk % 6 = 0 THEN 'same' ELSE CAST(event_id % 40 AS STRING) END AS digest
FROM (SELECT *, CAST(floor(event_id / 24) AS BIGINT) AS blk FROM {events}) e"""

SIGNAL_ORDER = (
    "blacklist", "duplicate_identity", "face", "mrz", "cross_fields", "dates", "tampering",
    "liveness", "metadata", "format",
)
DETECTOR_NAMES = (
    "ela", "noise_splicing", "photo_replacement", "copy_move", "font_inconsistency", "metadata",
    "double_jpeg", "cnn", "stamp_similarity",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a key column that one task turns into records.
ROWS_PER_TASK = 20_000


def spread(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """``rows`` of the stored table ``of`` over as many tasks as their number asks for.

    A column of keys packs so well that millions are one split of a file; each becomes up to
    27 records, which would all be made, and sorted for an aggregate, in that one task. Dealt
    by a hash of the key, so that no later step takes them for dealt by the key itself.
    """
    tasks = -(-of.count() // ROWS_PER_TASK)
    return rows if tasks <= 1 else rows.repartition(tasks, F.xxhash64(key))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    return spread(keys, keys, "c_custkey")


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def ids(spark, sf_dir):
    return spark.sql(IDS_SQL, customer=customers(spark, sf_dir))


def ref_list(spark, sf_dir):
    raw = _sql(spark, sf_dir, REF_SQL, "customer")
    return raw.select(
        lists.document_key(F.col("country"), F.col("number")).alias("document_key"),
        "blacklisted", "seen_count",
    )


def scored(spark, sf_dir):
    return _sql(spark, sf_dir, SCORED_SQL, "labels", "documents")


def log_scans(spark, sf_dir, *more):
    """The scans of SCANS_SQL, with ``more`` columns of their orders."""
    text = SCANS_SQL.replace("\nFROM", "".join(f", {c}" for c in more) + "\nFROM")
    return _sql(spark, sf_dir, text, "orders")


def log_decisions(spark, sf_dir):
    return _sql(spark, sf_dir, DECISIONS_SQL, "lineitem")


def manifest(spark, sf_dir):
    return _sql(spark, sf_dir, MANIFEST_SQL, "documents")


def cells(spark, sf_dir):
    return _sql(spark, sf_dir, CELLS_SQL, "lineitem")


def glyphs(spark, sf_dir):
    return _sql(spark, sf_dir, GLYPHS_SQL, "lineitem")


def features(spark, sf_dir):
    return _sql(spark, sf_dir, FEATURES_SQL, "part")


def frames(spark, sf_dir):
    return _sql(spark, sf_dir, FRAMES_SQL, "events")


def signals(spark, sf_dir):
    return signals_of(customers(spark, sf_dir))


def signals_of(customers: DataFrame) -> DataFrame:
    """Ten rows per customer with NULL and incomplete cases."""
    c = F.col("c_custkey")
    rows = []
    for k, name in enumerate(SIGNAL_ORDER, 1):
        value = (
            F.when((c + k) % 7 == 0, F.lit(None).cast("double"))
            .when((c * k) % 11 == 0, 1.0).when((c * k) % 13 == 0, 0.5).otherwise(0.0)
        )
        complete = (c + k) % 7 != 0
        if k == 8:
            complete = complete & (c % 2 != 0)
        rows.append(F.struct(F.lit(name).alias("name"), value.alias("value"), complete.alias("complete")))
    return customers.select(
        c.alias("doc_id"), F.explode(F.array(*rows)).alias("s")
    ).select("doc_id", "s.*")


def detectors(spark, sf_dir):
    """Nine detector rows per part with arithmetic scores and missing cases."""
    p = F.col("p_partkey")
    rows = []
    for k, name in enumerate(DETECTOR_NAMES, 1):
        gone = (p * k + k) % 23 == 0
        rows.append(
            F.struct(
                F.lit(name).alias("name"),
                F.when(gone, "unavailable").otherwise("ok").alias("status"),
                F.when(~gone, ((p * (k + 6)) % 101).cast("double") / 100).alias("score"),
            )
        )
    keys = table(spark, sf_dir, "part").select("p_partkey")
    return spread(keys, keys, "p_partkey").select(
        p.alias("doc_id"), F.explode(F.array(*rows)).alias("d")
    ).select("doc_id", "d.*")


def zone_format() -> Column:
    kind = F.floor(F.col("doc_id") / 20) % 3
    return F.when(kind == 0, "TD3").when(kind == 1, "TD1").otherwise("TD2")


def zones(spark, sf_dir):
    """Encoded zone lines with the reading noise that ``variant`` asks for."""
    enc = mrz.encode(ids(spark, sf_dir), zone_format())
    v, td1 = F.col("variant"), F.col("fmt") == "TD1"
    r1, r2, r3 = F.col("r1"), F.col("r2"), F.col("r3")
    s = F.substring

    def patch(text: Column, at: Column | int, width: int, new: Column) -> Column:
        at = F.lit(at) if isinstance(at, int) else at
        return F.concat(
            F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + width, F.lit(60))
        )

    dob_at = F.when(td1, F.lit(1)).otherwise(F.lit(14))
    last = F.length(r2)
    digit = F.substring(r2, last, F.lit(1)).cast("int")
    sex_at = F.when(td1, F.lit(8)).otherwise(F.lit(21))
    spaced = lambda t: F.lower(F.concat(s(t, 1, 5), F.lit(" "), s(t, 6, 60)))
    letters_out = lambda t: F.translate(t, "OI", "01")
    n1 = (
        F.when(v == 4, spaced(r1)).when(v == 6, F.concat(F.lit("V"), s(r1, 2, 60)))
        .when((v == 10) & ~td1, F.concat(s(r1, 1, 5), letters_out(s(r1, 6, 60))))
        .when((v == 12) & td1, patch(r1, 15, 1, F.lit("<")))
        .otherwise(r1)
    )
    n2 = (
        F.when(v == 1, patch(r2, last, 1, ((digit + 1) % 10).cast("string")))
        .when(v == 2, patch(r2, dob_at, 6, F.translate(F.substring(r2, dob_at, F.lit(6)), "0", "O")))
        .when(v == 4, spaced(r2)).when(v == 5, F.substring(r2, F.lit(1), last - 1))
        .when(v == 11, patch(r2, sex_at, 1, F.lit("K")))
        .when((v == 12) & ~td1, patch(r2, 10, 1, F.lit("<")))
        .otherwise(r2)
    )
    n3 = F.when(v == 4, spaced(r3)).when((v == 10) & td1, letters_out(r3)).otherwise(r3)
    noisy = enc.withColumn("r1", n1).withColumn("r2", n2).withColumn("r3", n3)
    # A generator keeps later filters from being rewritten in terms of all of the above.
    return noisy.select(F.inline(F.array(F.struct(*noisy.columns))))


def _printed_date(day: Column, style: Column) -> Column:
    return (
        F.when(style == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(style == 1, F.date_format(day, "d MMM yyyy"))
        .when(style == 2, F.date_format(day, "dd/MM/yyyy"))
        .when(style == 3, F.date_format(day, "dd.MM.yyyy"))
        .otherwise(F.upper(F.date_format(day, "d MMMM yyyy")))
    )


def ocr_lines(spark, sf_dir):
    """Text lines of three reading passes for every customer."""
    d, v = F.col("doc_id"), F.col("variant")
    style = d % 5
    dob = F.when(v == 0, F.add_months("dob", 120)).otherwise(F.col("dob"))
    expiry = F.when(v == 7, F.lit("2020-10-03").cast("date")).otherwise(F.col("expiry"))
    td3, td1 = F.col("fmt") == "TD3", F.col("fmt") == "TD1"
    header = (
        F.when(v == 8, "VISA").when(d % 9 == 4, "SPECIMEN").when(td3, "PASSPORT")
        .when(td1, "NATIONAL").when(d % 2 == 0, "DRIVING LICENCE").otherwise("ENTRY PERMIT")
    )
    viz, visa = v != 3, (v != 3) & (v == 8)
    case = d % 7
    full_zone, rows_zone = case != 3, (case != 2) & (case != 3)
    L = F.lit
    # Some zones are read with a bar at the page's edge first and whole afterwards;
    # some documents have no readable line.
    stray, readable = d % 41 == 8, d % 43 != 11

    def line(which: str, no: int, text: Column, keep: Column | None = None) -> Column:
        row = F.struct(L(which).alias("pass"), L(no).alias("line_no"), text.alias("text"))
        if no != 13:
            keep = readable if keep is None else keep & readable
        return row if keep is None else F.when(keep, row)

    birth = F.when(d % 37 == 0, "31.02.1990").otherwise(_printed_date(dob, style))
    rows = [
        line("full", 0, header),
        line("full", 1, L("ID CARD"), td1 & (header == "NATIONAL")),
        line("full", 2, F.concat(L("Name:  "), "surname", L("  "), "given_names"), viz),
        line("full", 3, F.concat(L("  Document No. "), "number"), viz),
        line("full", 4, F.concat(L("NATIONALITY - "), "country"), viz),
        line("full", 5, F.concat(L("Date of Birth: "), birth), viz),
        line("full", 6, F.concat(L("EXPIRY: "), _printed_date(expiry, style)), viz),
        line("full", 7, F.concat(L("Date of issue: "), _printed_date(F.col("issue"), style)), viz),
        line("full", 8, F.concat(L("SEX: "), "gender"), viz),
        line("full", 9, F.concat(L("VALID FROM: "), F.when(d % 3 == 0, "2026-10-20").otherwise("2026-10-01")), visa),
        line("full", 10, F.concat(L("Valid until: "), F.when(d % 4 == 0, "2026-09-10").otherwise("2026-10-10")), visa),
        line("full", 11, L("STAY DURATION: 30 days"), visa),
        line("full", 12, F.concat(L("FULL NAME: ALIAS "), "surname"), viz & (d % 11 == 0)),
        line("full", 13, L("   ")),
        line("full", 14, F.col("r1"), full_zone),
        line("full", 15, F.when(stray, F.concat("r2", L("|"))).otherwise(F.col("r2")), full_zone),
        line("full", 16, F.col("r3"), full_zone & td1),
        line("full", 17, F.col("r1"), full_zone & stray),
        line("full", 18, F.col("r2"), full_zone & stray),
        line("full", 19, F.col("r3"), full_zone & td1 & stray),
        line("full", 20, L("FOOTER")),
        line("rows", 0, F.col("r1"), rows_zone & (case != 0)),
        line("rows", 1, L("X1"), case == 1),
        line("rows", 2, F.col("r2"), rows_zone),
        line("rows", 3, F.col("r3"), rows_zone & td1),
        line("crop", 0, F.col("r1"), case == 3),
        line("crop", 1, F.col("r2"), case == 3),
        line("crop", 2, F.col("r3"), (case == 3) & td1),
    ]
    no = F.col("l.line_no")
    conf = F.when((d + no) % 13 != 0, ((d * 31 + no * 7 + F.length("l.pass")) % 101).cast("double") / 100)
    return (
        zones(spark, sf_dir).select("doc_id", F.explode(F.array_compact(F.array(*rows))).alias("l"))
        .select("doc_id", "l.pass", "l.line_no", "l.text", conf.alias("confidence"))
    )


def stored_lines(spark, sf_dir):
    """The lines as the stored table they are: a reading of documents scans them six times,
    and they are not to be made anew by each scan."""
    return kept(spark, sf_dir, "ocr_lines", lambda: ocr_lines(spark, sf_dir))


#: Documents whose words one task makes and joins, so that they fit in its memory.
DOCUMENTS_PER_TASK = 2_000


def ocr_words(spark, sf_dir):
    """Words of whole documents with page, line and word numbers.

    Documents are dealt before they become words, which take several times their room; an
    aggregate by document and line finds its rows in place and moves none of them."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = texts.repartition(max(1, -(-texts.count() // DOCUMENTS_PER_TASK)), "doc_id").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "line_text")
    )
    words = lines.select("doc_id", "line", F.posexplode(F.split("line_text", " ")).alias("word_no", "text"))
    return words.filter(F.trim("text") != "").select(
        "doc_id", F.lit(1).alias("page"), F.lit(1).alias("block"), F.lit(1).alias("par"), "line",
        "word_no", "text",
        ((F.col("doc_id") * 31 + F.col("word_no")) % 101 - 1).cast("double").alias("conf"),
    )


def gallery(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 2 == 0)


def probes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 2 == 1)


def keypoints(spark, sf_dir):
    """Keypoints with 256-bit descriptors as four words.

    Rows of one image that share ``l_partkey % 40`` have descriptors a few bits
    apart, so that near copies exist.
    """
    base = F.col("l_partkey") % 40
    words = []
    for k in range(4):
        high = (base + 1) * (k + 3) * 2654435761 % 2147483648
        low = (base + 7) * (k + 11) * 2246822519 % 4294967296
        flip = F.when(F.col("l_suppkey") % 4 == k, F.col("l_linenumber").cast("bigint")).otherwise(F.lit(0))
        words.append(F.shiftleft(high, 32).bitwiseOR(low).bitwiseXOR(flip).alias(f"w{k}"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 100).alias("image_id"),
        # A total order inside the image; ties cannot occur.
        F.struct(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            "l_shipdate",
        ).alias("idx"),
        (F.col("l_partkey") * 7 % 900).cast("double").alias("px"),
        (F.col("l_suppkey") * 13 % 600).cast("double").alias("py"),
        *words,
    )
