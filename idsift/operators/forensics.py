"""Image-forensics evidence over detector, heat-cell, keypoint and glyph tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from idsift.operators import graphs, ranks
from idsift.policy import FINDING_SCORE
from idsift.session import materialize

# Which detectors feed which roll-up.
SPATIAL = ["ela", "noise_splicing", "photo_replacement", "copy_move", "font_inconsistency"]
SPATIAL_CORE = ["noise_splicing", "photo_replacement", "copy_move", "font_inconsistency"]
METADATA = ["metadata", "double_jpeg"]
EDITING_WORDS = ["photoshop", "gimp", "affinity", "paint", "lightroom"]
# EXIF tag numbers: software, modification time, original capture time.
SOFTWARE, MODIFIED, CAPTURED = 305, 306, 36867


# ------------------------------------------------------------------ detectors


def rollup(detectors: DataFrame) -> DataFrame:
    """Largest spatial and metadata score; complete only with all core detectors."""
    usable = (F.col("status") == "ok") & F.col("score").isNotNull()
    name = F.col("name")

    def best(names: list[str]) -> Column:
        return F.max(F.when(usable & name.isin(names), F.col("score")))

    def all_present(names: list[str]) -> Column:
        flags = [F.coalesce(F.max(usable & (name == n)), F.lit(False)) for n in names]
        return reduce(lambda a, b: a & b, flags)

    return detectors.groupBy("doc_id").agg(
        best(SPATIAL).alias("spatial"), all_present(SPATIAL_CORE).alias("spatial_complete"),
        best(METADATA).alias("metadata"), all_present(METADATA).alias("metadata_complete"),
    )


def suspicion(detectors: DataFrame) -> DataFrame:
    """Largest score outside the learned detector."""
    return detectors.groupBy("doc_id").agg(
        F.max(F.when(F.col("name") != "cnn", F.col("score"))).alias("suspicion_score")
    )


def detector_findings(detectors: DataFrame) -> DataFrame:
    return detectors.filter(F.col("score") >= FINDING_SCORE).select(
        "doc_id", F.concat(F.lit("TAMPER_"), F.upper("name")).alias("code"), F.lit("medium").alias("severity"), "score"
    )


def metadata_score(exif: DataFrame, documents: DataFrame) -> DataFrame:
    """Score of an attribute table ``doc_id, tag, value``; no attributes, no score."""
    stamp = lambda tag: F.try_to_timestamp(
        F.max(F.when(F.col("tag") == tag, F.col("value"))), F.lit("yyyy:M:d H:m:s")
    )
    software = F.lower(F.max(F.when(F.col("tag") == SOFTWARE, F.col("value"))))
    wide = exif.groupBy("doc_id").agg(
        F.coalesce(software.rlike("|".join(EDITING_WORDS)), F.lit(False)).alias("editing_software"),
        F.coalesce(stamp(MODIFIED) < stamp(CAPTURED), F.lit(False)).alias("reversed_timestamps"),
    )
    total = F.lit(0.35) * F.col("editing_software").cast("int") + F.lit(0.65) * F.col("reversed_timestamps").cast("int")
    # The smaller of two values would skip a NULL; no attributes must stay NULL.
    score = F.when(total.isNotNull(), F.least(F.lit(1.0), total))
    return documents.select("doc_id").join(wide, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("editing_software").isNotNull(), "ok").otherwise("insufficient_evidence").alias("status"),
        score.alias("score"), "editing_software", "reversed_timestamps",
    )


# ----------------------------------------------------------------- heat cells


def combine(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.max("v").alias("v"))


def top_fraction_mean(cells: DataFrame, by: list[str], fraction: float = 0.01) -> DataFrame:
    return ranks.top_fraction_mean(cells, by, "v", fraction)


def ring_contrast(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Compare a region with the ring around it.

    ``regions`` has one row ``image_id, x1, y1, x2, y2`` (end exclusive) per image.
    Sides below 16 cells are refused; an empty ring gives no score.
    """
    side = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    margin = F.greatest(F.lit(8), F.floor(side * 0.2))
    shaped = regions.filter(side >= 16).withColumn("_m", margin)
    joined = cells.join(shaped, "image_id")

    def within(grow: Column | int) -> Column:
        return (
            (F.col("x") >= F.col("x1") - grow) & (F.col("x") < F.col("x2") + grow)
            & (F.col("y") >= F.col("y1") - grow) & (F.col("y") < F.col("y2") + grow)
        )

    placed = joined.withColumn("inside", within(0)).filter(within(F.col("_m")))
    keys = ["image_id", "inside"]
    means = placed.groupBy(*keys).agg(F.avg("err").alias("error"))
    medians = ranks.quantiles(placed, keys, "energy", {"energy": 0.5})
    side_of = means.join(medians, keys)
    pick = lambda c, flag: F.max(F.when(F.col("inside") == flag, F.col(c)))
    wide = side_of.groupBy("image_id").agg(
        pick("energy", True).alias("photo_noise"), pick("energy", False).alias("ring_noise"),
        pick("error", True).alias("photo_error"), pick("error", False).alias("ring_error"),
    )
    log_ratio = lambda a, b: F.abs(F.ln((F.col(a) + 1) / (F.col(b) + 1)))
    contrast = F.greatest(log_ratio("photo_noise", "ring_noise"), log_ratio("photo_error", "ring_error"))
    known = F.col("photo_noise").isNotNull() & F.col("ring_noise").isNotNull()
    return wide.withColumn(
        "score", F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (contrast - 0.7) / 2)))
    )


_PARTS = (
    "image_id bigint, comp bigint, area bigint, min_x bigint, min_y bigint, max_x bigint, max_y bigint, "
    "rim_x array<bigint>, rim_y array<bigint>"
)


def _tile_components(tile: int, width: int):
    """Label the 8-connected cells of tiles, over rows sorted by tile, ``y`` and ``x``.

    All tiles of a batch are labelled at once; the last one waits for the batch after it,
    so at most a batch and one tile are held. A component's number is that of its first
    cell in the image."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = _columns(batch)
            if held is not None:
                rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
            if len(rows[0]) == 0:
                continue
            first = _new_tile(rows)
            last = int(np.flatnonzero(first)[-1])
            if last:
                yield _components([c[:last] for c in rows], first[:last], tile, width)
            held = [c[last:] for c in rows]
        if held is not None and len(held[0]):
            yield _components(held, _new_tile(held), tile, width)

    return label


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Image, whether it is known, tile and place."""
    image = batch.column(0)
    known = np.asarray(image.is_valid().to_numpy(zero_copy_only=False))
    return [image.fill_null(0).to_numpy(), known, *[batch.column(i).to_numpy() for i in range(1, 5)]]


def _new_tile(rows: list[np.ndarray]) -> np.ndarray:
    first = np.ones(len(rows[0]), bool)
    first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in rows[:4]])
    return first


def _components(rows: list[np.ndarray], first: np.ndarray, tile: int, width: int) -> pa.RecordBatch:
    image, known, tx, ty, y, x = rows
    # Cells of all tiles in one sorted line of codes; tiles have empty rims, so none touch.
    side = tile + 2
    lx, ly = x - tx * tile + 1, y - ty * tile + 1
    code = (np.cumsum(first) - 1) * side * side + ly * side + lx
    pairs = []
    for step in (1, side - 1, side, side + 1):
        at = np.minimum(np.searchsorted(code, code + step), len(code) - 1)
        found = np.flatnonzero(code[at] == code + step)
        pairs.append(np.stack([found, at[found]]))
    a, b = np.concatenate(pairs, axis=1)
    # Spread the smallest number of each component until nothing changes;
    # pointer jumping keeps the number of rounds small.
    parent = np.arange(len(code))
    while True:
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        parent = parent[parent]
        if (parent == before).all():
            break
    order = np.argsort(parent, kind="stable")
    root, start, area = np.unique(parent[order], return_index=True, return_counts=True)
    xs, ys = x[order], y[order]
    rim = ((lx == 1) | (lx == tile) | (ly == 1) | (ly == tile))[order]
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(rim.astype(np.int32), start))])
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c[rim], pa.int64())) for c in (xs, ys)]
    # Cells are sorted, so a component's smallest index is its first cell.
    numbers = [y[root] * width + x[root], area]
    numbers += [f.reduceat(c, start) for f, c in ((np.minimum, xs), (np.minimum, ys), (np.maximum, xs), (np.maximum, ys))]
    columns = [pa.array(image[root], pa.int64(), mask=~known[root]), *[pa.array(c, pa.int64()) for c in numbers], *lists]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PARTS.split(", ")])


def regions(
    cells: DataFrame, width: int, height: int, threshold: float = FINDING_SCORE, tile: int = 256, keep: int = 12
) -> DataFrame:
    """The twelve largest connected regions per heat map, largest first.

    Cells are sorted by tile and labelled many tiles at a time, so a task holds a
    batch and one tile of distinct cells. Components that touch across a tile edge are edges of a graph whose
    connected components are found by joins, over all images at once; no image is
    a group of its own.
    """
    # A cell's largest value reaches the threshold if any does.
    hot = cells.filter(F.col("v") >= threshold).select("image_id", "x", "y").distinct()
    tiled = hot.select(
        F.col("image_id").cast("bigint").alias("image_id"), F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"),
        F.floor(F.col("x") / tile).alias("_tx"), F.floor(F.col("y") / tile).alias("_ty"),
    )
    place = ["image_id", "_tx", "_ty"]
    parts = (
        tiled.repartition(*place).sortWithinPartitions(*place, "y", "x").select(*place, "y", "x")
        .mapInArrow(_tile_components(tile, width), _PARTS)
    )
    parts = materialize(parts, "regions")
    rim = parts.select("image_id", "comp", F.explode(F.arrays_zip("rim_x", "rim_y")).alias("c"))
    # A rim cell announces its component at its own place and at half of its
    # neighbours'; at most five components meet at a place.
    steps = F.array(
        *[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))]
    )
    places = rim.select("image_id", "comp", "c", F.explode(steps).alias("s")).groupBy(
        "image_id", (F.col("c.rim_x") + F.col("s.dx")).alias("x"), (F.col("c.rim_y") + F.col("s.dy")).alias("y")
    ).agg(
        F.max(F.when((F.col("s.dx") == 0) & (F.col("s.dy") == 0), F.col("comp"))).alias("a"),
        F.collect_set("comp").alias("met"),
    )
    touching = (
        places.filter(F.col("a").isNotNull()).select("image_id", "a", F.explode("met").alias("b"))
        .filter(F.col("a") != F.col("b")).distinct()
    )
    roots = graphs.components(touching.withColumnRenamed("image_id", "graph")).select(
        F.col("graph").alias("image_id"), F.col("node").alias("comp"), "root"
    )
    merged = (
        parts.drop("rim_x", "rim_y").join(roots, ["image_id", "comp"], "left")
        .groupBy("image_id", F.coalesce("root", "comp").alias("region"))
        .agg(
            F.sum("area").alias("area"), F.min("min_x").alias("x0"), F.min("min_y").alias("y0"),
            F.max("max_x").alias("x1"), F.max("max_y").alias("y1"),
        )
        .filter(F.col("area") >= max(12, height * width * 0.001))
    )
    boxed = merged.select(
        "image_id", "area", (F.col("x0") / width).alias("x"), (F.col("y0") / height).alias("y"),
        ((F.col("x1") - F.col("x0") + 1) / width).alias("w"), ((F.col("y1") - F.col("y0") + 1) / height).alias("h"),
    )
    order = Window.partitionBy("image_id").orderBy(*[F.desc(c) for c in ("area", "x", "y", "w", "h")])
    return boxed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


# ------------------------------------------------------------------ copy-move

WORDS = ("w0", "w1", "w2", "w3")
# Two 256-bit descriptors that differ in at most 24 bits agree on at least one of
# any 25 or more disjoint parts. Seven parts of nine bits per word make 28.
PART_BITS, PARTS_PER_WORD = 9, 7
_LOW = sum(1 << (PART_BITS * i) for i in range(PARTS_PER_WORD))
_HIGH = _LOW << (PART_BITS - 1)
_ALL = (1 << (PART_BITS * PARTS_PER_WORD)) - 1
MAX_BITS, NEAREST, MIN_SHIFT, CELL, MIN_PAIRS = 24, 5, 30.0, 12, 4


def _first_equal_part(differences: list[Column]) -> Column:
    """Number of the first part in which no bit differs.

    Subtracting one from every part at once borrows into the part's top bit only
    where the part is zero; the lowest such mark is exact.
    """
    out = None
    for k, x in enumerate(differences):
        x = x.bitwiseAND(F.lit(_ALL))
        marks = (x - F.lit(_LOW)).bitwiseAND(F.bitwise_not(x)).bitwiseAND(F.lit(_HIGH))
        lowest = F.bit_count(marks.bitwiseAND(-marks) - 1)
        part = F.floor(lowest / PART_BITS) + k * PARTS_PER_WORD
        out = F.when(marks != 0, part) if out is None else out.when(marks != 0, part)
    return out


def copy_move(keypoints: DataFrame) -> DataFrame:
    """Displacement groups of near-identical keypoints: ``image_id, kx, ky, pairs``.

    Rows: ``image_id, idx`` (orders the points of an image), ``px, py`` and the
    four descriptor words. Distances depend on descriptors only, so the search
    runs over distinct descriptors, and of equal descriptors only the five first
    points can ever be among the five nearest. Candidates come from equal
    descriptor parts, which misses nothing, instead of all pairs of an image.
    """
    desc = ["image_id", *WORDS]
    first = Window.partitionBy(*desc).orderBy("idx")
    targets = (
        keypoints.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= NEAREST)
        .groupBy(*desc).agg(F.collect_list(F.struct("idx", "px", "py")).alias("points"))
    )
    part_rows = F.array(
        *[
            F.struct(
                F.lit(k * PARTS_PER_WORD + i).alias("part"),
                F.shiftrightunsigned(F.col(w), i * PART_BITS).bitwiseAND(F.lit((1 << PART_BITS) - 1)).alias("bits"),
            )
            for k, w in enumerate(WORDS)
            for i in range(PARTS_PER_WORD)
        ]
    )
    parted = targets.select(*desc, F.explode(part_rows).alias("p")).select(*desc, "p.part", "p.bits")
    left = parted.select("image_id", "part", "bits", *[F.col(w).alias(f"a_{w}") for w in WORDS])
    differences = [F.col(f"a_{w}").bitwiseXOR(F.col(w)) for w in WORDS]
    distance = reduce(lambda a, b: a + b, [F.bit_count(x) for x in differences])
    near = (
        left.join(parted, ["image_id", "part", "bits"])
        # Keep a pair only at the first part it agrees on, so that no later
        # de-duplication is needed.
        .filter((distance <= MAX_BITS) & (F.col("part") == _first_equal_part(differences)))
        .select("image_id", F.struct(*[F.col(f"a_{w}").alias(w) for w in WORDS]).alias("a"), *WORDS, distance.alias("distance"))
    )
    ranked = near.join(targets, desc).select(
        "image_id", "a", "distance", F.explode("points").alias("t")
    )
    closest = Window.partitionBy("image_id", "a").orderBy("distance", "t.idx")
    lists = (
        ranked.withColumn("_rn", F.row_number().over(closest)).filter(F.col("_rn") <= NEAREST)
        .select("image_id", F.col("a.*"), "t")
    )
    dx, dy = F.col("t.px") - F.col("px"), F.col("t.py") - F.col("py")
    pairs = keypoints.join(lists, desc).filter(
        (F.col("idx") < F.col("t.idx")) & (F.sqrt(dx * dx + dy * dy) >= MIN_SHIFT)
    )
    return (
        pairs.groupBy("image_id", F.bround(dx / CELL).cast("int").alias("kx"), F.bround(dy / CELL).cast("int").alias("ky"))
        .agg(F.count("*").alias("pairs"))
        .filter(F.col("pairs") >= MIN_PAIRS)
    )


# ----------------------------------------------------------------- glyph rows

REACH_X, REACH_Y, MIN_NEIGHBOURS, MAX_DEVIATION = 120, 5, 6, 0.6
# Side of a tile of glyphs, in reaches: a tile also gets what lies a reach around it.
TILE_REACHES = 8


def font_outliers(glyphs: DataFrame) -> DataFrame:
    """Glyph heights that stand out among their neighbours on the same line.

    Glyphs at one position with one height are interchangeable, so they are counted
    first. Positions are sorted by tile and line; a running count of each height along
    the lines gives the heights around a position as differences, whatever the number
    of its neighbours, so no pairs are listed and no image is a group.
    """
    has_area = "area" in glyphs.columns
    kept = glyphs.filter(
        F.col("h").between(4, 36) & F.col("w").between(2, 30) & ((F.col("area") >= 6) if has_area else F.lit(True))
        & F.col("image_id").isNotNull()
    )
    cells = kept.groupBy("image_id", "cx", "cy", "h").agg(F.count("*").alias("n"))
    wide, high = REACH_X * TILE_REACHES, REACH_Y * TILE_REACHES
    x, y = F.col("cx").cast("double"), F.col("cy").cast("double")
    tiles = lambda v, reach, side: F.explode(F.sequence(F.floor((v - reach) / side), F.floor((v + reach) / side)))
    dealt = (
        cells.withColumn("_tx", tiles(x, REACH_X, wide)).withColumn("_ty", tiles(y, REACH_Y, high))
        .withColumns({"_own": (F.floor(x / wide) == F.col("_tx")) & (F.floor(y / high) == F.col("_ty")), "_x": x, "_y": y})
    )
    tile = ["image_id", "_tx", "_ty"]
    kinds = dict(cells.dtypes)
    judged = dealt.repartition(*tile).sortWithinPartitions(*tile, "_y", "_x", "h").select(
        *tile, "_own", "_x", "_y", F.col("h").cast("double").alias("_h"), *cells.columns[1:]
    ).mapInArrow(
        _surrounded, f"image_id {kinds['image_id']}, cx {kinds['cx']}, cy {kinds['cy']}, h {kinds['h']}, n bigint, neighbours bigint, typical double"
    )
    deviation = F.abs(F.col("h") - F.col("typical")) / F.greatest(F.col("typical"), F.lit(1.0))
    return judged.withColumn("deviation", deviation).filter(F.col("deviation") > MAX_DEVIATION).select(
        "image_id", "cx", "cy", "h", F.col("n").alias("glyphs"), "neighbours", "typical", F.least(F.lit(1.0), "deviation").alias("heat")
    )


def _surrounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours and their median height for a tile's own cells, over rows sorted by tile,
    line, place and height. The last tile of a batch waits for the batch after it."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        if held.num_rows == 0:
            continue
        image = held["image_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        keys = [image, held["_tx"].to_numpy(), held["_ty"].to_numpy()]
        changes = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        if len(changes):
            yield from _around(held.slice(0, changes[-1]), np.concatenate([[0], changes[:-1]]))
            held = held.slice(changes[-1])
    if held is not None and held.num_rows:
        yield from _around(held, np.array([0]))


def _around(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    x, y, h = (rows[c].to_numpy() for c in ("_x", "_y", "_h"))
    tile = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    # Lines in order of tile and y; the lines within reach of each are consecutive.
    fresh = np.ones(len(x), bool)
    fresh[1:] = (tile[1:] != tile[:-1]) | (y[1:] != y[:-1])
    line = np.cumsum(fresh) - 1
    ys, of = y[fresh], tile[fresh]
    places = np.unique(ys)
    code = of * (len(places) + 1) + np.searchsorted(places, ys)
    first = np.searchsorted(code, of * (len(places) + 1) + np.searchsorted(places, ys - REACH_Y, "right"))
    last = np.searchsorted(code, of * (len(places) + 1) + np.searchsorted(places, ys + REACH_Y, "left"))
    # Numbers of glyphs of each height before each cell.
    heights, which = np.unique(h, return_inverse=True)
    before = np.zeros((len(x) + 1, len(heights)), np.int64)
    before[np.arange(1, len(x) + 1), which] = rows["n"].to_numpy()
    np.cumsum(before, axis=0, out=before)
    xs = np.unique(x)
    at = line * (len(xs) + 1) + np.searchsorted(xs, x)
    own = np.flatnonzero(rows["_own"].to_numpy())
    low, high = np.searchsorted(xs, x[own] - REACH_X, "right"), np.searchsorted(xs, x[own] + REACH_X, "left")
    counts = np.zeros((len(own), len(heights)), np.int64)
    mine = line[own]
    for k in range(int((last - first).max())):
        some = np.flatnonzero(first[mine] + k < last[mine])
        base = (first[mine[some]] + k) * (len(xs) + 1)
        counts[some] += before[np.searchsorted(at, base + high[some])] - before[np.searchsorted(at, base + low[some])]
    upto = np.cumsum(counts, axis=1)
    total = upto[:, -1]
    middle = lambda r: heights[np.argmax(upto > r[:, None], axis=1)]
    typical = (middle((total - 1) // 2) + middle(total // 2)) / 2
    enough = total >= MIN_NEIGHBOURS
    chosen = rows.select(["image_id", "cx", "cy", "h", "n"]).take(pa.array(own[enough]))
    out = chosen.append_column("neighbours", pa.array(total[enough], pa.int64())).append_column("typical", pa.array(typical[enough], pa.float64()))
    yield from out.combine_chunks().to_batches()
