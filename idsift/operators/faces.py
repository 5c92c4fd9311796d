"""Face-vector jobs: quality, pair checks, exact search, alias rule, error rates.

Exact search over a large gallery must look at every close enough vector but not
at every pair. Gallery vectors are grouped around pivot vectors, about as many as the
root of their number. On the unit sphere the angle obeys the triangle inequality, so
a query skips every group that is farther away than the threshold angle plus the
group's radius. Small groups share a block, large ones have several, and a block goes
only to the chunks of queries that ask for one of its groups; where vectors lie in all
directions, a query so travels once per block and not once per group.
Inside a block, the product over a few principal axes plus the product of what is
left of both lengths bounds a pair's similarity, and only pairs whose bound reaches
the threshold are compared. Blocks are bounded in size on both sides however many
rows share a group, and emit results per query or counts, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from idsift.functions import vectors
from idsift.policy import FACE_THRESHOLDS

GALLERY_BLOCK, QUERY_BLOCK, SLICE = 4096, 16384, 1024
#: Rows that a task hands on at once; each has a vector.
ROUTED_ROWS = 8192
#: The most pivots; they come to the driver.
PIVOTS = 1024
# Wider than any rounding error of the angles.
SLACK = 1e-4
DIGITS = 9


def quality(observations: DataFrame) -> DataFrame:
    """Reasons why a detected face is not usable."""
    t = FACE_THRESHOLDS
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    outside = F.exists(
        "landmarks",
        lambda p: (p["x"] < 0) | (p["y"] < 0) | (p["x"] >= F.col("width")) | (p["y"] >= F.col("height")),
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.least(w, h) < t["min_face_size"], "FACE_TOO_SMALL"),
            F.when(F.col("laplacian") < t["min_face_laplacian"], "FACE_BLURRED"),
            F.when(~F.col("brightness").between(t["min_face_brightness"], t["max_face_brightness"]), "FACE_LIGHTING"),
            F.when((x < 0) | (y < 0) | (x + w > F.col("width")) | (y + h > F.col("height")), "FACE_CLIPPED"),
            F.when(outside, "LANDMARKS_OUTSIDE_IMAGE"),
        )
    )
    return observations.withColumn("quality_reasons", reasons).withColumn(
        "quality_ok", F.size("quality_reasons") == 0
    )


def verify(docs: DataFrame, live: DataFrame, threshold: float | None = None) -> DataFrame:
    """One-to-one comparison per document.

    Both sides: ``doc_id, face_count, quality_ok, embedding``, one row per document.
    """
    overridden = threshold is not None
    limit = FACE_THRESHOLDS["cosine_threshold"] if threshold is None else threshold
    if not math.isfinite(limit) or not -1 <= limit <= 1:
        raise ValueError("threshold must be finite and within [-1, 1]")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            "doc_id", *[F.col(c).alias(f"{name}_{c}") for c in ("face_count", "quality_ok", "embedding")]
        )

    def finding(name: str) -> Column:
        count = F.col(f"{name}_face_count")
        return (
            F.when(count == 0, f"NO_FACE:{name}").when(count != 1, f"MULTIPLE_FACES:{name}")
            .when(~F.col(f"{name}_quality_ok"), f"FACE_QUALITY:{name}")
        )

    pairs = side(docs, "document").join(side(live, "live"), "doc_id")
    judged = pairs.withColumn(
        "_problems", F.array_compact(F.array(finding("document"), finding("live")))
    ).withColumn(
        "cosine_similarity",
        F.when(F.size("_problems") == 0, vectors.cosine(F.col("document_embedding"), F.col("live_embedding"))),
    )
    match = F.col("cosine_similarity") >= limit
    known = F.col("cosine_similarity").isNotNull()
    return judged.select(
        "doc_id", "document_face_count", "live_face_count", "cosine_similarity",
        F.lit(float(limit)).alias("threshold"),
        F.lit("request_override" if overridden else "config").alias("threshold_source"),
        match.alias("match"),
        F.when(match, "match").when(known, "non_match").otherwise("undetermined").alias("decision"),
        F.when(known, F.array(F.when(match, F.lit("FACE_MATCH")).otherwise("FACE_NON_MATCH")))
        .otherwise(F.col("_problems")).alias("face_codes"),
        F.when(known, "ok").otherwise("insufficient_evidence").alias("face_status"),
    )


# ---------------------------------------------------------------- block search


def _unit(column: pd.Series) -> np.ndarray:
    matrix = np.asarray(column.tolist(), dtype=np.float64)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _usable(df: DataFrame, size: int | None = None) -> DataFrame:
    """Rows with a vector, of ``size`` numbers if given; others can't be compared."""
    usable = df.filter(vectors.invalid_reason(F.col("embedding")).isNull())
    return usable if size is None else usable.filter(F.size("embedding") == size)


def _axes(sample: np.ndarray) -> np.ndarray:
    """Orthogonal axes, those along which the sample varies most first."""
    return np.linalg.svd(sample, full_matrices=True)[2].T


def similarities(left: np.ndarray, right: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """Similarities of unit vectors, -2 for pairs that are surely below the threshold,
    and the number of pairs that were compared in full. Rounded, so that equal vectors
    tie in whichever block they are."""
    few = max(1, axes.shape[1] // 4)
    a, b = left @ axes, right @ axes
    rest = np.sqrt(np.maximum(0, 1 - (a[:, :few] ** 2).sum(1)))[:, None] * np.sqrt(np.maximum(0, 1 - (b[:, :few] ** 2).sum(1)))
    bound = a[:, :few] @ b[:, :few].T
    near = bound + rest >= threshold - SLACK
    count = int(near.sum())
    if count * 2 > near.size:
        return np.round(np.clip(left @ right.T, -1, 1), DIGITS), near.size
    out = np.full(near.shape, -2.0)
    rows, columns = np.nonzero(near)
    for at in range(0, count, 1 << 16):
        i, j = rows[at : at + (1 << 16)], columns[at : at + (1 << 16)]
        out[i, j] = np.round(np.clip((left[i] * right[j]).sum(1), -1, 1), DIGITS)
    return out, count


def _pieces(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), most):
            yield b.iloc[at : at + most]


def _packing(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's first block and its number of blocks. Cells that follow each other share
    a block as long as GALLERY_BLOCK rows suffice; a larger cell has blocks of its own."""
    first, splits, block, room = [], [], -1, 0
    for n in sizes:
        parts = math.ceil(n / GALLERY_BLOCK)
        if parts > 1 or n > room:
            block += 1
            room = GALLERY_BLOCK if parts == 1 else 0
        first.append(block)
        splits.append(parts)
        block += parts - 1
        room -= min(n, room)
    return np.array(first), np.array(splits)


def _blocks(
    queries: DataFrame, gallery: DataFrame, threshold: float, extra: list[str],
    kernel: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str,
) -> DataFrame:
    """Run ``kernel(queries, gallery)`` on all blocks that may hold a close pair.

    ``queries`` and ``gallery`` carry ``vec_id, embedding`` and ``extra`` columns.
    """
    theta = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    cols = ["vec_id", "embedding", *extra]
    gallery, queries = _usable(gallery).select(*cols), _usable(queries).select(*cols)
    size = gallery.select(F.size("embedding").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return queries.limit(0).mapInPandas(lambda it: iter(()), schema)
    gallery, queries = _usable(gallery, size["n"]), _usable(queries, size["n"])
    wanted = min(PIVOTS, math.isqrt(size["count"]) + 1)
    picked = gallery.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("embedding").collect()
    pivots = _unit(pd.Series([r[0] for r in picked]))
    axes = _axes(pivots)
    fields = ", ".join(f"{n} {t}" for n, t in gallery.dtypes)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _pieces(batches, SLICE):
            angles = np.arccos(np.clip(_unit(b.embedding) @ pivots.T, -1, 1))
            cell = angles.argmin(axis=1)
            yield b.assign(cell=cell.astype(np.int32), angle=angles[np.arange(len(b)), cell])

    placed = gallery.mapInPandas(place, f"{fields}, cell int, angle double")
    # One row per pivot.
    stats = {
        r.cell: (r.n, r.radius)
        for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()
    }
    cells = sorted(stats)
    radius = np.array([stats[c][1] for c in cells])
    first, splits = _packing([stats[c][0] for c in cells])
    chunks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    of_cell = lambda values: F.element_at(F.create_map(*[F.lit(int(v)) for p in zip(cells, values, strict=True) for v in p]), F.col("cell"))
    parted = placed.select(
        *cols, (of_cell(first) + F.pmod(F.xxhash64("vec_id"), of_cell(splits))).cast("int").alias("block")
    )
    # Cells of a block follow each other; a block of several parts has one cell.
    starts = np.flatnonzero(np.diff(first, prepend=-1))

    def wanted_blocks(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        angles = np.arccos(np.clip(_unit(b.embedding) @ pivots[cells].T, -1, 1))
        rows, hits = np.nonzero(np.logical_or.reduceat(angles - radius <= theta, starts, axis=1))
        times = splits[starts][hits]
        part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(rows, times), (np.repeat(first[starts][hits], times) + part).astype(np.int32)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _pieces(batches, SLICE):
            rows, block = wanted_blocks(b)
            for at in range(0, len(rows), ROUTED_ROWS):
                yield b.iloc[rows[at : at + ROUTED_ROWS]].assign(block=block[at : at + ROUTED_ROWS])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _pieces(batches, SLICE):
            rows, block = wanted_blocks(b)
            yield pd.DataFrame({"block": block, "chunk": b.chunk.to_numpy()[rows]}).drop_duplicates()

    keys = ["block", "chunk"]
    chunked = queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"))
    routed = chunked.mapInPandas(route, f"{fields}, chunk int, block int")
    asked = chunked.mapInPandas(ask, "block int, chunk int").distinct()
    spread = parted.join(asked, "block")

    def run(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        return kernel(q, g, axes)

    return routed.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(run, schema)


def nearest(queries: DataFrame, gallery: DataFrame, threshold: float) -> DataFrame:
    """Exact best gallery vector per query at or above the threshold.

    Ties, at DIGITS digits, go to the lowest gallery id; the similarity itself isn't rounded.
    Queries without a hit get no row.
    """

    def best(q: pd.DataFrame, g: pd.DataFrame, axes: np.ndarray) -> pd.DataFrame:
        out = {"query_id": [], "match_id": [], "similarity": [], "rounded": []}
        if len(q) and len(g):
            g = g.sort_values("vec_id")
            right, ids = _unit(g.embedding), g.vec_id.to_numpy()
            left, names = _unit(q.embedding), q.vec_id.to_numpy()
            for at in range(0, len(q), SLICE):
                scores, _ = similarities(left[at : at + SLICE], right, axes, threshold)
                top = scores.argmax(axis=1)
                value = scores[np.arange(len(top)), top]
                keep = value >= threshold
                out["query_id"].append(names[at : at + SLICE][keep])
                out["match_id"].append(ids[top][keep])
                # Pair by pair, so that it doesn't depend on the block.
                exact = (left[at : at + SLICE][keep] * right[top][keep]).sum(1)
                out["similarity"].append(np.clip(exact, -1, 1))
                out["rounded"].append(value[keep])
        return pd.DataFrame({k: np.concatenate(v) if v else [] for k, v in out.items()})

    hits = _blocks(queries, gallery, threshold, [], best, "query_id bigint, match_id bigint, similarity double, rounded double")
    return hits.groupBy("query_id").agg(
        F.max_by(F.struct("match_id", "similarity"), F.struct("rounded", -F.col("match_id"))).alias("b")
    ).select("query_id", "b.*")


def alias_hits(claims: DataFrame, hits: DataFrame, catalogue: DataFrame) -> DataFrame:
    """A nearest hit under another name or number is a duplicate identity.

    ``claims``: ``query_id, claimed_name, document_number``; ``catalogue``:
    ``match_id, name, number``. A query without a hit is not a duplicate.
    """
    joined = claims.join(hits, "query_id", "left").join(catalogue, "match_id", "left")
    found = F.col("match_id").isNotNull()
    reasons = F.array_compact(
        F.array(
            F.when(found & (F.col("claimed_name") != F.col("name")), "different_name"),
            F.when(found & (F.col("document_number") != F.col("number")), "different_number"),
        )
    )
    return joined.withColumn("reasons", reasons).select(
        "query_id", "match_id", "similarity", "reasons", (F.size("reasons") > 0).alias("duplicate_hit")
    )


def grid_error_rates(refs: DataFrame, probes: DataFrame, thresholds: list[float]) -> DataFrame:
    """Error counts over the whole reference-by-probe grid, without listing it.

    Rows: ``vec_id, embedding, label``. The grid's size and its same-label part
    follow from counts per label; only pairs at or above the lowest threshold are
    looked at, as counts per block.
    """
    levels = sorted(float(t) for t in thresholds)

    def count(q: pd.DataFrame, g: pd.DataFrame, axes: np.ndarray) -> pd.DataFrame:
        totals = np.zeros((len(levels), 2), np.int64)
        if len(q) and len(g):
            right, theirs = _unit(g.embedding), g.label.to_numpy()
            left, mine = _unit(q.embedding), q.label.to_numpy()
            for at in range(0, len(q), SLICE):
                scores, _ = similarities(left[at : at + SLICE], right, axes, levels[0])
                same = mine[at : at + SLICE, None] == theirs[None, :]
                for i, level in enumerate(levels):
                    hit = scores >= level
                    totals[i] += ((hit & same).sum(), (hit & ~same).sum())
        return pd.DataFrame({"threshold": levels, "tp": totals[:, 0], "fp": totals[:, 1]})

    counted = _blocks(probes, refs, levels[0], ["label"], count, "threshold double, tp bigint, fp bigint")
    rows = F.array(*[F.lit(t) for t in levels])
    left = _usable(refs).groupBy("label").agg(F.count("*").alias("a"))
    right = _usable(probes).groupBy("label").agg(F.count("*").alias("b"))
    per_label = left.join(right, "label", "full")
    total = per_label.agg(
        F.sum(F.coalesce("a", F.lit(0)) * F.coalesce("b", F.lit(0))).alias("genuine"),
        (F.sum(F.coalesce("a", F.lit(0))) * F.sum(F.coalesce("b", F.lit(0)))).alias("pairs"),
    ).select("genuine", "pairs", F.explode(rows).alias("threshold"))
    hits = counted.groupBy("threshold").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    full = total.join(hits, "threshold", "left").select(
        "threshold", "pairs", zero("tp").alias("tp"), zero("fp").alias("fp"),
        (F.col("genuine") - zero("tp")).alias("fn"),
        (F.col("pairs") - F.col("genuine") - zero("fp")).alias("tn"),
    )
    rate = lambda a, b: F.when(F.col(a) + F.col(b) != 0, F.col(a) / (F.col(a) + F.col(b)))
    return full.select("*", rate("fp", "tn").alias("far"), rate("fn", "tp").alias("frr"))
