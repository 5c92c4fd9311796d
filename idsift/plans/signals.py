"""Queries over detector, heat-cell, keypoint, glyph, face and frame tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from idsift.functions import vectors
from idsift.operators import evaluation, faces, forensics, risk, sequences
from idsift.plans import oracle as O, views

QUERIES: dict = {}
SQL: dict = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def r6(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ detectors
_spatial = ", ".join(f"'{n}'" for n in forensics.SPATIAL)
_core = ", ".join(f"'{n}'" for n in forensics.SPATIAL_CORE)
O.define("rolled", f"""
SELECT doc_id, max(score) FILTER (status = 'ok' AND name IN ({_spatial})) AS spatial, count(*) FILTER (status = 'ok' AND name IN ({_core})) = 4 AS spatial_complete,
  max(score) FILTER (status = 'ok' AND name IN ('metadata', 'double_jpeg')) AS metadata, count(*) FILTER (status = 'ok' AND name IN ('metadata', 'double_jpeg')) = 2 AS metadata_complete
FROM detectors GROUP BY doc_id""")


@query("g3_detector_rollup", O.query("SELECT * FROM rolled"))
def g3(spark, sf):
    return forensics.rollup(views.detectors(spark, sf))


@query("g9_forensic_signals", O.query("SELECT doc_id, 'tampering' AS name, spatial AS value, spatial_complete AS complete FROM rolled UNION ALL SELECT doc_id, 'metadata', metadata, metadata_complete FROM rolled"))
def g9f(spark, sf):
    wide = risk.forensic_signals(forensics.rollup(views.detectors(spark, sf)))
    return risk.to_long(wide, ["tampering", "metadata"]).select("doc_id", "name", "value", "complete")


@query("g4_suspicion", O.query("SELECT doc_id, max(score) FILTER (name <> 'cnn') AS suspicion_score, count(*) FILTER (score >= 0.55) AS n_findings FROM detectors GROUP BY doc_id"))
def g4(spark, sf):
    rows = views.detectors(spark, sf)
    n = forensics.detector_findings(rows).groupBy("doc_id").agg(F.count("*").alias("n"))
    return forensics.suspicion(rows).join(n, "doc_id", "left").select(
        "doc_id", "suspicion_score", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_findings")
    )


@query("g5_combine_heat", O.query("SELECT image_id, x, y, max(v) AS v FROM cells GROUP BY image_id, x, y"))
def g5(spark, sf):
    return forensics.combine(views.cells(spark, sf), ["image_id", "x", "y"])


@query("g6_top_fraction_mean", O.query("""
SELECT image_id, round(avg(v), 6) AS top_mean FROM (SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY v DESC) AS rn, count(*) OVER (PARTITION BY image_id) AS n
  FROM (SELECT image_id, v * energy / 50 AS v FROM cells) c) q WHERE rn <= greatest(1, floor(n * 0.01)) GROUP BY image_id"""))
def g6(spark, sf):
    heat = views.cells(spark, sf).select("image_id", (F.col("v") * F.col("energy") / 50).alias("v"))
    return r6(forensics.top_fraction_mean(heat, ["image_id"]), "top_mean")


O.define("ring_regions", "SELECT DISTINCT image_id, image_id % 20 AS x1, image_id % 16 AS y1, image_id % 20 + 12 + image_id % 24 AS x2, image_id % 16 + 16 + image_id % 18 AS y2 FROM cells")


@query("g7_ring_contrast", O.query("""
SELECT image_id, round(pn, 6) AS photo_noise, round(rn, 6) AS ring_noise, round(pe, 6) AS photo_error, round(re, 6) AS ring_error,
  round(CASE WHEN pn IS NOT NULL AND rn IS NOT NULL THEN greatest(0.0, least(1.0, (greatest(abs(ln((pn + 1) / (rn + 1))), abs(ln((pe + 1) / (re + 1)))) - 0.7) / 2)) END, 6) AS score FROM (
SELECT image_id, median(energy) FILTER (inside) AS pn, median(energy) FILTER (NOT inside) AS rn, avg(err) FILTER (inside) AS pe, avg(err) FILTER (NOT inside) AS re FROM (
  SELECT c.*, x >= x1 AND x < x2 AND y >= y1 AND y < y2 AS inside FROM cells c JOIN (SELECT *, greatest(8, floor(least(x2 - x1, y2 - y1) * 0.2)) AS m FROM ring_regions WHERE least(x2 - x1, y2 - y1) >= 16) r USING (image_id)
  WHERE x >= x1 - m AND x < x2 + m AND y >= y1 - m AND y < y2 + m) q GROUP BY image_id) s"""))
def g7(spark, sf):
    cells = views.cells(spark, sf)
    i = F.col("image_id")
    regions = cells.select("image_id").distinct().select(
        "image_id", (i % 20).alias("x1"), (i % 16).alias("y1"), (i % 20 + 12 + i % 24).alias("x2"), (i % 16 + 16 + i % 18).alias("y2")
    )
    out = forensics.ring_contrast(cells, regions)
    return r6(out, "photo_noise", "ring_noise", "photo_error", "ring_error", "score")


_EXIF = """
SELECT p_partkey AS doc_id, 305 AS tag, CASE p_partkey % 7 WHEN 0 THEN 'Adobe Photoshop 24' WHEN 1 THEN 'GIMP 2.10' WHEN 2 THEN 'Camera firmware' ELSE p_name END AS value FROM {part} WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, 306, concat(CAST(2019 + p_partkey % 4 AS STRING), ':01:0', CAST(1 + p_partkey % 9 AS STRING), ' 10:00:00') FROM {part} WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, 36867, CASE WHEN p_partkey % 8 = 0 THEN 'unknown' ELSE concat(CAST(2019 + p_partkey % 3 AS STRING), ':01:05 09:30:00') END FROM {part} WHERE p_partkey % 5 <> 0"""
O.define("exif", _EXIF.format(part="part"))


@query("g8_metadata_score", O.query("""
SELECT p.p_partkey AS doc_id, CASE WHEN e.doc_id IS NULL THEN 'insufficient_evidence' ELSE 'ok' END AS status, CASE WHEN e.doc_id IS NOT NULL THEN round(least(1.0, 0.35 * e.editing::INT + 0.65 * e.reversed::INT), 6)::DOUBLE END AS score,
  e.editing AS editing_software, e.reversed AS reversed_timestamps FROM part p LEFT JOIN (
SELECT doc_id, regexp_matches(lower(max(value) FILTER (tag = 305)), 'photoshop|gimp|affinity|paint|lightroom') AS editing,
  coalesce(try_strptime(max(value) FILTER (tag = 306), '%Y:%m:%d %H:%M:%S') < try_strptime(max(value) FILTER (tag = 36867), '%Y:%m:%d %H:%M:%S'), false) AS reversed FROM exif GROUP BY doc_id) e ON e.doc_id = p.p_partkey"""))
def g8(spark, sf):
    exif = views._sql(spark, sf, _EXIF, "part")
    docs = views.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"))
    return r6(forensics.metadata_score(exif, docs), "score")


# Heat maps have 64 by 64 cells here, so small tiles exercise the merging. Each 1 024
# orders share one map, which makes connected regions likely; maps grow with the orders.
O.define("heat_cells", "SELECT l_orderkey // 1024 AS image_id, l_partkey % 64 AS x, l_suppkey % 64 AS y FROM lineitem GROUP BY ALL HAVING max(l_discount * 10) >= 0.55")
O.define("heat_links", "SELECT a.image_id, a.y * 64 + a.x AS p, b.y * 64 + b.x AS q FROM heat_cells a JOIN heat_cells b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1")


@query("k3_largest_regions", O.query("""
SELECT image_id, area, x0 / 64 AS x, y0 / 64 AS y, (x1 - x0 + 1) / 64 AS w, (y1 - y0 + 1) / 64 AS h, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, x0 DESC, y0 DESC, x1 - x0 DESC, y1 - y0 DESC)::INT AS rank
FROM (SELECT image_id, root, count(*) AS area, min(p % 64) AS x0, max(p % 64) AS x1, min(p // 64) AS y0, max(p // 64) AS y1 FROM (
  WITH RECURSIVE label(image_id, p, root) USING KEY (image_id, p) AS (
    SELECT image_id, y * 64 + x, y * 64 + x FROM heat_cells
    UNION
    SELECT e.image_id, e.q, min(v.root) FROM label v JOIN heat_links e ON e.image_id = v.image_id AND e.p = v.p
      JOIN recurring.label u ON u.image_id = e.image_id AND u.p = e.q WHERE v.root < u.root GROUP BY e.image_id, e.q)
  SELECT * FROM label) l GROUP BY image_id, root HAVING count(*) >= 12) r
QUALIFY rank <= 12"""))
def k3(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(
        F.expr("l_orderkey div 1024").alias("image_id"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y"),
        (F.col("l_discount") * 10).alias("v"),
    )
    return forensics.regions(rows, 64, 64, tile=16)


_word = "xor(((l_partkey % 40 + 1) * {a} * 2654435761 % 2147483648) << 32 | ((l_partkey % 40 + 7) * {b} * 2246822519 % 4294967296), CASE WHEN l_suppkey % 4 = {k} THEN l_linenumber::BIGINT ELSE 0::BIGINT END)"
O.define("keypoints", "SELECT l_orderkey % 100 AS image_id, row_number() OVER (PARTITION BY l_orderkey % 100 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS idx, "
         "(l_partkey * 7 % 900)::DOUBLE AS px, (l_suppkey * 13 % 600)::DOUBLE AS py, "
         + ", ".join(_word.format(a=k + 3, b=k + 11, k=k) + f" AS w{k}" for k in range(4)) + " FROM lineitem")


@query("j8_copy_move", O.query("""
SELECT image_id, round_even(dx / 12, 0)::INT AS kx, round_even(dy / 12, 0)::INT AS ky, count(*) AS pairs FROM (
  SELECT a.image_id, a.idx AS q, b.idx AS t, b.px - a.px AS dx, b.py - a.py AS dy,
    bit_count(xor(a.w0, b.w0))::INT + bit_count(xor(a.w1, b.w1)) + bit_count(xor(a.w2, b.w2)) + bit_count(xor(a.w3, b.w3)) AS d
  FROM keypoints a JOIN keypoints b ON a.image_id = b.image_id
  QUALIFY row_number() OVER (PARTITION BY a.image_id, a.idx ORDER BY d, b.idx) <= 5) n
WHERE q < t AND d <= 24 AND sqrt(dx * dx + dy * dy) >= 30 GROUP BY ALL HAVING count(*) >= 4"""))
def j8(spark, sf):
    return forensics.copy_move(views.keypoints(spark, sf))


@query("j9_font_outliers", O.query("""
SELECT g.image_id, g.cx, g.cy, g.h, count(*) AS glyphs, max(neighbours) AS neighbours, max(typical) AS typical, round(max(least(1.0, dev)), 6) AS heat FROM (
  SELECT a.rid, any_value(a.image_id) AS image_id, any_value(a.cx) AS cx, any_value(a.cy) AS cy, any_value(a.h) AS h, count(*)::BIGINT AS neighbours, median(b.h)::DOUBLE AS typical, abs(any_value(a.h) - median(b.h)) / greatest(median(b.h), 1) AS dev
  FROM gl a JOIN gl b ON a.image_id = b.image_id AND abs(b.cy - a.cy) < 5 AND abs(b.cx - a.cx) < 120 GROUP BY a.rid) g
WHERE neighbours >= 6 AND dev > 0.6 GROUP BY ALL""",
    gl="SELECT *, row_number() OVER () AS rid FROM glyphs WHERE h BETWEEN 4 AND 36 AND w BETWEEN 2 AND 30"))
def j9(spark, sf):
    return r6(forensics.font_outliers(views.glyphs(spark, sf)), "heat")


# -------------------------------------------------------------------- vectors
@query("e1_normalize", O.query("""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE / n)), 5) AS total, round(embedding[1]::DOUBLE / n, 6) AS first
FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS n FROM embeddings) e"""))
def e1(spark, sf):
    unit = views.table(spark, sf, "embeddings").select("vec_id", vectors.normalize(F.col("embedding")).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda s, v: s + v)
    return unit.select("vec_id", F.round(total, 5).alias("total"), F.round(F.col("u")[0], 6).alias("first"))


@query("e2_cosine", O.query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"))
def e2(spark, sf):
    left = views.table(spark, sf, "embeddings").select("vec_id", "embedding")
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return left.join(right, "vec_id").select(
        "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine")
    )


O.define("doc_faces", "SELECT vec_id // 2 AS doc_id, CASE WHEN vec_id % 23 = 0 THEN 0 WHEN vec_id % 23 = 1 THEN 2 ELSE 1 END AS face_count, vec_id % 19 <> 0 AS quality_ok, embedding FROM embeddings WHERE vec_id % 2 = 0")
O.define("live_faces", "SELECT vec_id // 2 AS doc_id, CASE WHEN vec_id % 29 = 0 THEN 0 WHEN vec_id % 29 = 1 THEN 2 ELSE 1 END AS face_count, vec_id % 17 <> 0 AS quality_ok, embedding FROM embeddings WHERE vec_id % 2 = 1")
O.define("verified", """
SELECT doc_id, CASE WHEN d.face_count = 1 AND l.face_count = 1 AND d.quality_ok AND l.quality_ok THEN list_cosine_similarity(d.embedding::DOUBLE[], l.embedding::DOUBLE[]) END AS cosine,
  concat_ws(',', CASE WHEN d.face_count = 0 THEN 'NO_FACE:document' WHEN d.face_count <> 1 THEN 'MULTIPLE_FACES:document' WHEN NOT d.quality_ok THEN 'FACE_QUALITY:document' END,
    CASE WHEN l.face_count = 0 THEN 'NO_FACE:live' WHEN l.face_count <> 1 THEN 'MULTIPLE_FACES:live' WHEN NOT l.quality_ok THEN 'FACE_QUALITY:live' END) AS problems
FROM doc_faces d JOIN live_faces l USING (doc_id)""")


def face_sides(spark, sf):
    rows = views.table(spark, sf, "embeddings")
    v = F.col("vec_id")

    def side(even, count_by, quality_by):
        return rows.filter(v % 2 == even).select(
            F.floor(v / 2).alias("doc_id"),
            F.when(v % count_by == 0, 0).when(v % count_by == 1, 2).otherwise(1).alias("face_count"),
            (v % quality_by != 0).alias("quality_ok"), "embedding",
        )

    return side(0, 23, 19), side(1, 29, 17)


@query("j4_pair_verification", O.query("""
SELECT doc_id, round(cosine, 6) AS cosine_similarity, cosine >= 0.1 AS match, CASE WHEN cosine >= 0.1 THEN 'match' WHEN cosine IS NOT NULL THEN 'non_match' ELSE 'undetermined' END AS decision,
  CASE WHEN cosine >= 0.1 THEN 'FACE_MATCH' WHEN cosine IS NOT NULL THEN 'FACE_NON_MATCH' ELSE problems END AS codes, 'request_override' AS threshold_source FROM verified"""))
def j4(spark, sf):
    return r6(
        faces.verify(*face_sides(spark, sf), 0.1).select(
            "doc_id", "cosine_similarity", "match", "decision", F.array_join("face_codes", ",").alias("codes"), "threshold_source"
        ), "cosine_similarity",
    )


@query("g9_face_signal", O.query("SELECT doc_id, 'face' AS name, (cosine < 0.1)::DOUBLE AS value, true AS complete FROM verified WHERE cosine IS NOT NULL"))
def g9face(spark, sf):
    wide = risk.face_signal(faces.verify(*face_sides(spark, sf), 0.1))
    return risk.to_long(wide, ["face"]).select("doc_id", "name", "value", "complete")


@query("g24_far_frr", O.query("""
SELECT t.threshold, count(cosine) AS eligible, count(*) - count(cosine) AS undetermined, count(*) FILTER (cosine < threshold AND NOT same) AS tn, count(*) FILTER (cosine >= threshold AND NOT same) AS fp,
  count(*) FILTER (cosine < threshold AND same) AS fn, count(*) FILTER (cosine >= threshold AND same) AS tp,
  round(count(*) FILTER (cosine >= threshold AND NOT same) / nullif(count(*) FILTER (cosine IS NOT NULL AND NOT same), 0), 6) AS far, round(count(*) FILTER (cosine < threshold AND same) / nullif(count(*) FILTER (cosine IS NOT NULL AND same), 0), 6) AS frr
FROM (SELECT v.*, v.doc_id % 3 = 0 AS same FROM verified v) v CROSS JOIN (VALUES (0.1::DOUBLE), (0.0::DOUBLE), (0.363::DOUBLE)) t(threshold) GROUP BY t.threshold"""))
def g24(spark, sf):
    pairs = faces.verify(*face_sides(spark, sf)).select(
        (F.col("doc_id") % 3 == 0).alias("same_identity"), F.col("cosine_similarity").alias("cosine")
    )
    return r6(evaluation.far_frr(pairs, [0.1, 0.0, 0.363]), "far", "frr")


@query("j7_grid_error_rates", O.query("""
SELECT t.threshold, count(*) AS pairs, count(*) FILTER (c >= threshold AND same) AS tp, count(*) FILTER (c >= threshold AND NOT same) AS fp, count(*) FILTER (c < threshold AND same) AS fn, count(*) FILTER (c < threshold AND NOT same) AS tn,
  round(count(*) FILTER (c >= threshold AND NOT same) / count(*) FILTER (NOT same), 6) AS far, round(count(*) FILTER (c < threshold AND same) / count(*) FILTER (same), 6) AS frr
FROM (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c, a.label = b.label AS same FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) g
CROSS JOIN (VALUES (0.15::DOUBLE), (0.25::DOUBLE), (0.4::DOUBLE)) t(threshold) GROUP BY t.threshold"""))
def j7(spark, sf):
    out = faces.grid_error_rates(views.gallery(spark, sf), views.probes(spark, sf), [0.15, 0.25, 0.4])
    return r6(out, "far", "frr")


O.define("nearest", """
SELECT b.vec_id AS query_id, arg_max(a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS match_id, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 GROUP BY b.vec_id HAVING max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) >= 0.25""")


@query("j5_nearest", O.query("SELECT query_id, match_id, round(similarity, 6) AS similarity FROM nearest"))
def j5(spark, sf):
    return r6(faces.nearest(views.probes(spark, sf), views.gallery(spark, sf), 0.25), "similarity")


_names = "split_part('ADA,ROBIN,SAM,ALEX,KAI', ',', CAST({x} % 5 AS INT) + 1)"


DUPLICATES_SQL = f"""
SELECT e.vec_id AS query_id, n.match_id, concat_ws(',', CASE WHEN {_names.format(x='e.vec_id')} <> {_names.format(x='n.match_id')} THEN 'different_name' END, CASE WHEN e.vec_id % 3 <> n.match_id % 3 THEN 'different_number' END) AS reasons,
  coalesce({_names.format(x='e.vec_id')} <> {_names.format(x='n.match_id')} OR e.vec_id % 3 <> n.match_id % 3, false) AS duplicate_hit
FROM embeddings e LEFT JOIN nearest n ON n.query_id = e.vec_id WHERE e.vec_id % 2 = 1"""


@query("j6_alias_hits", O.query(DUPLICATES_SQL))
def j6(spark, sf):
    name = lambda c: F.expr(_names.format(x=c))
    number = lambda c: (F.col(c) % 3).cast("string")
    probes, gallery = views.probes(spark, sf), views.gallery(spark, sf)
    claims = probes.select(F.col("vec_id").alias("query_id"), name("vec_id").alias("claimed_name"), number("vec_id").alias("document_number"))
    catalogue = gallery.select(F.col("vec_id").alias("match_id"), name("vec_id").alias("name"), number("vec_id").alias("number"))
    out = faces.alias_hits(claims, faces.nearest(probes, gallery, 0.25), catalogue)
    return out.select("query_id", "match_id", F.array_join("reasons", ",").alias("reasons"), "duplicate_hit")


@query("g9_duplicate_signal", O.query(f"""
SELECT e.vec_id AS doc_id, 'duplicate_identity' AS name, coalesce({_names.format(x='e.vec_id')} <> {_names.format(x='n.match_id')} OR e.vec_id % 3 <> n.match_id % 3, false)::DOUBLE AS value, true AS complete
FROM embeddings e LEFT JOIN nearest n ON n.query_id = e.vec_id WHERE e.vec_id % 2 = 1"""))
def g9d(spark, sf):
    wide = risk.duplicate_signal(j6(spark, sf).withColumnRenamed("query_id", "doc_id"))
    return risk.to_long(wide, ["duplicate_identity"]).select("doc_id", "name", "value", "complete")


@query("q4_face_quality", O.query("""
SELECT p_partkey AS doc_id, concat_ws(',', CASE WHEN least(w, h) < 60 THEN 'FACE_TOO_SMALL' END, CASE WHEN lap < 20 THEN 'FACE_BLURRED' END, CASE WHEN bright NOT BETWEEN 35 AND 245 THEN 'FACE_LIGHTING' END,
  CASE WHEN x < 0 OR y < 0 OR x + w > 300 OR y + h > 300 THEN 'FACE_CLIPPED' END, CASE WHEN x < 0 OR y < 0 OR x + w >= 300 OR y + h >= 300 THEN 'LANDMARKS_OUTSIDE_IMAGE' END) AS reasons
FROM (SELECT p_partkey, p_partkey % 211 - 5 AS x, p_partkey % 173 - 3 AS y, p_size * 4 AS w, p_size * 3 + 20 AS h, p_retailprice / 40 AS lap, p_retailprice / 6 AS bright FROM part) q"""))
def q4(spark, sf):
    p, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    obs = views.table(spark, sf, "part").select(
        p.alias("doc_id"), (p % 211 - 5).alias("x"), (p % 173 - 3).alias("y"), (size * 4).alias("w"), (size * 3 + 20).alias("h"),
        (price / 40).alias("laplacian"), (price / 6).alias("brightness"), F.lit(300).alias("width"), F.lit(300).alias("height"),
    ).withColumn(
        "landmarks", F.array(
            F.struct(F.col("x").alias("x"), F.col("y").alias("y")),
            F.struct((F.col("x") + F.col("w")).alias("x"), (F.col("y") + F.col("h")).alias("y")),
        ),
    )
    return faces.quality(obs).select("doc_id", F.array_join("quality_reasons", ",").alias("reasons"))


# ------------------------------------------------------------------ sequences
O.define("seq_frames", """
SELECT * REPLACE (row_number() OVER (PARTITION BY seq_id ORDER BY idx) - 1 AS idx), face_count = 1 AND quality_ok AS usable, CASE WHEN face_count = 1 AND quality_ok THEN eyes_visible END AS eyes, CASE WHEN face_count = 1 AND quality_ok THEN same_face_as_first END AS same,
  lag(timestamp_ms) OVER (PARTITION BY seq_id ORDER BY idx) AS before, count(*) OVER (PARTITION BY seq_id) AS n FROM frames""")
O.define("seq_valid", """
SELECT seq_id, count(*) AS n, CASE WHEN count(*) > 12 THEN 'too_many_frames' WHEN bool_or(timestamp_ms < 0 OR timestamp_ms > 20000) THEN 'timestamp_range'
  WHEN bool_or(timestamp_ms <= before) THEN 'timestamp_order' END AS reason,
  count(*) >= 5 AND bool_and(usable AND coalesce(same, false)) AND NOT bool_or(timestamp_ms - before > 500) AS steady,
  count(*) - count(DISTINCT digest) AS repeated, max(0.5 * (texture_contrast < 8)::INT + 0.5 * (periodic_energy_ratio > 0.45)::INT) FILTER (usable)::DOUBLE AS indicator,
  count(*) FILTER (NOT usable) AS missing, bool_or(NOT same) AS broken FROM seq_frames GROUP BY seq_id""")
O.define("seq_ends", """
SELECT s.seq_id, s.idx AS start, s.timestamp_ms AS t0, min(e.idx) AS stop FROM seq_frames s JOIN seq_frames e ON e.seq_id = s.seq_id AND e.idx > s.idx AND coalesce(e.eyes, -1) <> 0 WHERE s.eyes = 0 GROUP BY ALL""")
O.define("seq_blinks", """
SELECT DISTINCT p.seq_id FROM seq_ends p JOIN seq_frames a ON a.seq_id = p.seq_id AND a.idx = p.start - 2 AND a.eyes = 2 JOIN seq_frames b ON b.seq_id = p.seq_id AND b.idx = p.start - 1 AND b.eyes = 2
  JOIN seq_frames c ON c.seq_id = p.seq_id AND c.idx = p.stop AND c.eyes = 2 JOIN seq_frames d ON d.seq_id = p.seq_id AND d.idx = p.stop + 1 AND d.eyes = 2 WHERE c.timestamp_ms - p.t0 BETWEEN 60 AND 500""")
O.define("seq_out", """
SELECT v.*, CASE WHEN reason IS NULL THEN steady AND b.seq_id IS NOT NULL END AS blink_candidate, CASE WHEN reason IS NULL THEN repeated END AS repeated_frames,
  CASE WHEN reason IS NULL THEN CASE WHEN n > 1 AND repeated = n - 1 THEN 1.0 ELSE indicator END END AS spoof_score FROM seq_valid v LEFT JOIN seq_blinks b ON b.seq_id = v.seq_id""")


def gathered(spark, sf):
    return sequences.gather(views.frames(spark, sf))


@query("w5_frame_order", O.query("SELECT seq_id, n, reason FROM seq_valid"))
def w5(spark, sf):
    return sequences.validate(gathered(spark, sf)).select("seq_id", "n", "reason")


@query("w6_w7_blink", O.query("SELECT seq_id, blink_candidate FROM seq_out"))
def w7(spark, sf):
    return sequences.blink(sequences.validate(gathered(spark, sf))).select("seq_id", "blink_candidate")


@query("g25_repeated_frames", O.query("SELECT seq_id, repeated_frames::INT AS repeated_frames FROM seq_out"))
def g25(spark, sf):
    return sequences.repeats(sequences.validate(gathered(spark, sf))).select("seq_id", "repeated_frames")


@query("g26_spoof_indicator", O.query("SELECT seq_id, spoof_score::DOUBLE AS spoof_score, CASE WHEN reason IS NULL THEN CASE WHEN spoof_score >= 0.5 THEN 'suspicious' ELSE 'inconclusive' END END AS verdict FROM seq_out"))
def g26(spark, sf):
    return sequences.outcome(views.frames(spark, sf)).select(
        "seq_id", "spoof_score", F.col("liveness_verdict").alias("verdict")
    )


O.define("seq_outcome", """
SELECT seq_id, CASE WHEN reason IS NULL THEN CASE WHEN n = 1 OR missing > 0 OR coalesce(broken, false) OR coalesce(spoof_score >= 0.5, false) OR (n > 1 AND repeated = n - 1) THEN 'insufficient_evidence' ELSE 'ok' END END AS status,
  CASE WHEN reason IS NULL THEN concat_ws(',', CASE WHEN missing > 0 THEN repeat('LIVENESS_FACE_EVIDENCE_MISSING,', missing - 1) || 'LIVENESS_FACE_EVIDENCE_MISSING' END, CASE WHEN n > 1 AND repeated = n - 1 THEN 'REPEATED_FRAMES' END,
    CASE WHEN broken THEN 'FACE_CONTINUITY_FAILED' END, CASE WHEN spoof_score >= 0.5 THEN 'SPOOF_HEURISTIC' END, 'LIVENESS_NOT_VERIFIED') END AS codes FROM seq_out""")


@query("g28_sequence_outcome", O.query("SELECT * FROM seq_outcome"))
def g28(spark, sf):
    return sequences.outcome(views.frames(spark, sf)).select(
        "seq_id", F.col("liveness_status").alias("status"), F.array_join("liveness_codes", ",").alias("codes")
    )


@query("g9_liveness_signal", O.query("SELECT seq_id AS doc_id, 'liveness' AS name, CASE WHEN spoof_score > 0 THEN spoof_score END::DOUBLE AS value, false AS complete FROM seq_out WHERE reason IS NULL"))
def g9l(spark, sf):
    out = sequences.outcome(views.frames(spark, sf)).filter(F.col("reason").isNull())
    wide = risk.liveness_signal(out.withColumnRenamed("seq_id", "doc_id"))
    return risk.to_long(wide, ["liveness"]).select("doc_id", "name", "value", "complete")


@query("w8_continuity", O.query("""
SELECT seq_id, idx, list_cosine_similarity(first::DOUBLE[], vec::DOUBLE[]) >= 0.05 AS same_face_as_first FROM (
  SELECT *, first_value(vec IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first
  FROM (SELECT vec_id // 12 AS seq_id, vec_id % 12 AS idx, CASE WHEN vec_id % 7 <> 0 THEN embedding END AS vec FROM embeddings) e) q"""))
def w8(spark, sf):
    v = F.col("vec_id")
    rows = views.table(spark, sf, "embeddings").select(
        F.floor(v / 12).alias("seq_id"), (v % 12).alias("idx"), F.when(v % 7 != 0, F.col("embedding")).alias("embedding")
    )
    return sequences.continuity(rows, 0.05).select("seq_id", "idx", "same_face_as_first")
