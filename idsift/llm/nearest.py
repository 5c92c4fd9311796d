"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample that is halved again and again, always into equal
parts, so that lists are of like size. Every vector is put on its nearest centroid's
list; one near a boundary also goes on the lists of the next centroids, unless a
centroid already chosen is nearer to them than the vector is. Centroids are searched by
a graph in memory. A query reads the lists whose centroids are at most RATIO times as
far as its nearest one: few where clusters are clear, many where they aren't.

A query first reads its FIRST nearest lists. The distance of the last of its nearest
there bounds what it takes from the others, so that they answer with the few vectors
within the bound and not each with as many as are asked for.

Of equal vectors the smallest ids are indexed, as many as can be among a query's
nearest; equal queries are searched once. Lists and the queries of a list are
cut into blocks, so that neither a crowded list nor a popular one is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idsift.llm import common

NEAREST = 10
#: Vectors of a list, about.
LIST = 128
#: Components of the sample in all: 32 768 vectors of 64.
SAMPLE_COMPONENTS = 1 << 21
#: Sampled vectors per list, at least.
SAMPLED = 8
#: A list whose centroid is at most so many times as far as the nearest holds a copy of
#: the vector, up to REPLICAS lists in all.
BOUNDARY = 1.03
REPLICAS = 3
#: Share of the nearest that a query shall find, and queries by which the ratio is set.
TARGET, PROBES = 0.97, 64
#: Lists that a query reads before the others.
FIRST = 4
#: Neighbours of a centroid in the graph, entry points, and centroids that a search keeps at least.
LINKS, ENTRIES, BEAM = 16, 16, 8
#: Vectors and queries that a task compares at a time; vectors that search the graph at a time.
BLOCK, QUERY_BLOCK, SEARCHED = 8192, 1024, 512
_SEED = 11


def halved(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of `lists` (rounded up to a power of two) parts of equal size."""
    rng, parts = np.random.default_rng(_SEED), [np.arange(len(sample))]
    while len(parts) < lists:
        parts = [half for part in parts for half in _halves(sample, part, rng) if len(half)]
    return np.stack([sample[part].mean(axis=0) for part in parts])


def _halves(sample: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    x, middle = sample[part], (len(part) + 1) // 2
    if len(part) < 2:
        return part, part[:0]
    a, b = x[rng.choice(len(part), 2, replace=False)]
    for _ in range(6):
        # The half nearer to a, by the difference of squared distances.
        order = np.argsort(x @ (b - a), kind="stable")
        a, b = x[order[:middle]].mean(axis=0), x[order[middle:]].mean(axis=0)
    return part[order[:middle]], part[order[middle:]]


class Graph:
    """Centroids, each linked with neighbours in different directions and with the next
    one, so that all can be reached."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        n = len(centroids)
        links: list[set[int]] = [{(i + 1) % n, (i - 1) % n} - {i} for i in range(n)]
        for i in range(n):
            far = _distances(centroids[i : i + 1], centroids)[0]
            chosen: list[int] = []
            for j in np.argsort(far, kind="stable")[1 : 4 * LINKS]:
                # Already reached through a neighbour that is nearer to it.
                if not chosen or (_distances(centroids[j : j + 1], centroids[chosen])[0] > far[j]).all():
                    chosen.append(int(j))
                if len(chosen) == LINKS:
                    break
            for j in chosen:
                links[i].add(j)
                links[j].add(i)
        self.links = np.full((n, max(1, max(map(len, links)))), -1)
        for i, its in enumerate(links):
            self.links[i, : len(its)] = sorted(its)

    def search(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Distances of the rows of x to centroids, infinite to those not reached. A
        search goes on from every centroid within the ratio, and from the BEAM nearest."""
        n = len(self.centroids)
        far = np.full((len(x), n), np.inf)
        first = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(int))
        far[:, first] = _distances(x, self.centroids[first])
        done = np.zeros(far.shape, dtype=bool)
        while True:
            limit = far.min(axis=1) * ratio
            if n > BEAM:
                limit = np.maximum(limit, np.partition(far, BEAM - 1, axis=1)[:, BEAM - 1])
            here = ~done & (far <= limit[:, None]) & np.isfinite(far)
            if not here.any():
                return far
            done |= here
            rows, at = np.nonzero(here)
            seen = np.zeros(far.shape, dtype=bool)
            to = self.links[at]
            seen[np.repeat(rows, to.shape[1])[to.ravel() >= 0], to[to >= 0]] = True
            rows, to = np.nonzero(seen & np.isinf(far))
            for a in range(0, len(rows), 1 << 16):
                r, t = rows[a : a + (1 << 16)], to[a : a + (1 << 16)]
                far[r, t] = np.sqrt(((x[r] - self.centroids[t]) ** 2).sum(axis=1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))


def replicas(graph: Graph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, place): the lists on which each row of x stands, by distance."""
    far = graph.search(x, BOUNDARY)
    order = np.argsort(far, axis=1, kind="stable")[:, : 4 * REPLICAS]
    own = np.take_along_axis(far, order, axis=1)
    chosen = np.zeros(order.shape, dtype=bool)
    for j in range(order.shape[1]):
        ok = np.isfinite(own[:, j]) & (own[:, j] <= own[:, 0] * BOUNDARY) & (chosen.sum(axis=1) < REPLICAS)
        for i in range(j):
            between = np.sqrt(((graph.centroids[order[:, i]] - graph.centroids[order[:, j]]) ** 2).sum(axis=1))
            ok &= ~chosen[:, i] | (between > own[:, j])
        chosen[:, j] = ok if j else True
    rows, place = np.nonzero(chosen)
    return rows, order[rows, place], place


def read_lists(graph: Graph, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, place): the lists that each row of x, a query, reads, by distance."""
    far = graph.search(x, ratio)
    order = np.argsort(far, axis=1, kind="stable")
    own = np.take_along_axis(far, order, axis=1)
    rows, place = np.nonzero(np.isfinite(own) & (own <= own[:, :1] * ratio))
    return rows, order[rows, place], place


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (double) of vectors that can be compared; see `search`."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    kept = vectors.filter(F.col("embedding").isNotNull() & fine & some).select("vec_id", x.alias("embedding"))
    lengths = kept.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return kept.filter(F.size("embedding") == (lengths[0]["n"] if lengths else 0))


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    column = batch.column("embedding")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def fit(vectors: DataFrame, total: int) -> Graph:
    """The centroids' graph, from at most SAMPLE_COMPONENTS components of the vectors."""
    width = vectors.select(F.size("embedding")).first()[0]
    rows = max(SAMPLED, SAMPLE_COMPONENTS // width)
    picked = vectors.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(rows).toArrow()
    lists = min(-(-total // LIST), max(1, picked.num_rows // SAMPLED))
    return Graph(halved(_matrix(picked), lists))


def measured_ratio(queries: DataFrame, lists: DataFrame, graph: Graph, k: int, target: float) -> float:
    """The ratio at which the share `target` of the k nearest of PROBES queries is found
    on the lists read. Vectors equal to the query don't count."""
    picked = queries.orderBy(F.xxhash64("embedding"), "q").limit(PROBES).toArrow()
    if not picked.num_rows:
        return 1.0
    probes = _matrix(picked)
    far = _distances(probes, graph.centroids)
    far /= np.maximum(far.min(axis=1, keepdims=True), np.finfo(float).tiny)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, of = _matrix(batch), batch.column("list").to_numpy()
            # As many as there are copies on several lists.
            rows, at, score = nearest_of(probes, x, REPLICAS * (k + 1), np.full(len(probes), np.inf))
            yield pa.RecordBatch.from_pydict(
                {"probe": rows, "vec_id": batch.column("vec_id").take(pa.array(at)), "score": score, "need": far[rows, of[at]]}
            )

    kind = dict(lists.dtypes)["vec_id"]
    found = lists.mapInArrow(local, f"probe long, vec_id {kind}, score double, need double").filter("score > 0")
    once = found.groupBy("probe", "vec_id", "score").agg(F.min("need").alias("need"))
    rank = F.row_number().over(Window.partitionBy("probe").orderBy("score", F.col("vec_id").asc_nulls_last()))
    needs = once.withColumn("n", rank).filter(F.col("n") <= k).select("need").toPandas()["need"]
    return max(1.0, float(np.quantile(needs, target, method="higher"))) if len(needs) else 1.0


def _spread(vectors: DataFrame, graph, find) -> DataFrame:
    """vectors, a row for each list that find(graph, matrix) names, with its place."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SEARCHED):
                part = batch.slice(at, SEARCHED)
                rows, *found = find(graph.value, _matrix(part))
                out = part.take(pa.array(rows))
                for name, column in zip(("list", "place"), found, strict=True):
                    out = out.append_column(name, pa.array(column.astype(np.int32)))
                yield out

    fields = ", ".join(f"{name} {kind}" for name, kind in vectors.dtypes)
    return vectors.mapInArrow(spread, f"{fields}, list int, place int")


def _compared(asked: DataFrame, lists: DataFrame, top: int) -> DataFrame:
    """asked (q, embedding, list, bound), lists (vec_id, embedding, list) -> q, vec_id,
    score: each query's `top` nearest within its bound in every block of a list."""
    parts = lists.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    chunks = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("chunks"))
    # A row per list, and the lists are bounded by the sample.
    shape = F.broadcast(parts.join(chunks, "list"))
    left = asked.join(shape, "list").select(
        "q", "embedding", "bound", "list", F.pmod(F.xxhash64("q"), "chunks").cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    right = lists.join(shape, "list").select(
        "vec_id", "embedding", "list", F.pmod(F.xxhash64("vec_id", "embedding"), "parts").cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
    )

    def best(q: pa.Table, g: pa.Table) -> pa.Table:
        if not q.num_rows or not g.num_rows:
            rows, at, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        else:
            g = g.sort_by("vec_id")
            rows, at, score = nearest_of(_matrix(q), _matrix(g), top, q.column("bound").to_numpy())
        return pa.table({
            "q": q.column("q").take(pa.array(rows)), "vec_id": g.column("vec_id").take(pa.array(at)), "score": score,
        })

    keys = ["list", "part", "chunk"]
    kinds = dict(right.dtypes)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        best, f"q long, vec_id {kinds['vec_id']}, score double"
    )


def nearest_of(q: np.ndarray, g: np.ndarray, top: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of g, distance) of each q's `top` nearest within its bound, ties to the
    earlier row of g. Products pick what may be near enough; its distances are then taken
    exactly."""
    out = []
    g2 = (g * g).sum(axis=1)
    for at in range(0, len(q), 256):
        x = q[at : at + 256]
        x2 = (x * x).sum(axis=1)[:, None]
        rough = x2 + g2[None] - 2 * (x @ g.T)
        limit = np.square(bound[at : at + 256])[:, None]
        if top < len(g):
            limit = np.minimum(limit, np.partition(rough, top - 1, axis=1)[:, top - 1 : top])
        rows, to = np.nonzero(rough <= limit + 1e-9 * (x2 + g2[None]))
        score = np.concatenate(
            [np.sqrt(((x[rows[i : i + 65536]] - g[to[i : i + 65536]]) ** 2).sum(axis=1)) for i in range(0, max(1, len(rows)), 65536)]
        )
        order = np.lexsort((to, score, rows))
        rows, to, score = rows[order], to[order], score[order]
        first = np.searchsorted(rows, rows)
        keep = (np.arange(len(rows)) - first < top) & (score <= bound[at : at + 256][rows])
        out.append((rows[keep] + at, to[keep], score[keep]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def search(queries: DataFrame, vectors: DataFrame, k: int = NEAREST, ratio: float | None = None) -> DataFrame:
    """queries, vectors (vec_id, embedding) -> query_id, rank, vec_id, score: each query's
    k nearest vectors under another id, by Euclidean distance, ties to the smaller id.
    Without a ratio, it is measured.

    Vectors that are null, empty or zero, or hold a null or non-finite component, take
    no part, nor do those of another length than most. Repeated rows are one vector; an
    id with several vectors is searched with each of them and found by each. A null id
    is an id of its own. Other columns are ignored. A query gets all candidates if there
    are no more than k; an empty table has no rows.
    """
    kept = k + 1  # The query's own id may be one of them.
    spark = vectors.sparkSession
    alike = Window.partitionBy("embedding").orderBy(F.col("vec_id").asc_nulls_last())
    few = usable(vectors).distinct().withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= kept).drop("n")
    base = common.stored(few, "vectors")
    total = base.count()
    asking = usable(queries).distinct()
    once = common.stored(asking.select("embedding").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    named = common.stored(asking.join(once, "embedding").select(F.col("vec_id").alias("query_id"), "q"), "named")
    if total:
        graph = spark.sparkContext.broadcast(fit(base, total))
        lists = common.stored(_spread(base, graph, replicas), "lists")
        ratio = ratio or measured_ratio(once, lists, graph.value, k, TARGET)
        hits = common.stored(_found(once, lists, graph, ratio, kept), "hits")
        # Lists that held too little for a query: it reads them all.
        served = hits.groupBy("q").count().filter(F.col("count") >= min(kept, total))
        short = common.stored(once.join(served, "q", "left_anti"), "short")
        if short.limit(1).count():
            hits = hits.join(short, "q", "left_anti").unionByName(_found(short, lists, graph, np.inf, kept))
    else:
        hits = base.select(F.lit(0).cast("bigint").alias("q"), "vec_id", F.lit(0.0).alias("score"))
    rank = Window.partitionBy("query_id", "q").orderBy("score", F.col("vec_id").asc_nulls_last())
    return (
        named.join(hits, "q").filter("not (vec_id <=> query_id)").withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def _found(queries: DataFrame, lists: DataFrame, graph, ratio: float, top: int) -> DataFrame:
    """queries (q, embedding) -> q, vec_id, score: the `top` nearest on the lists within
    the ratio. Copies of a vector on several lists are one."""
    asked = common.stored(_spread(queries, graph, lambda g, x: read_lists(g, x, ratio)), "asked")
    first = asked.filter(F.col("place") < FIRST).withColumn("bound", F.lit(float("inf")))
    near = common.stored(_best(_compared(first, lists, top), top), "near")
    last = near.groupBy("q").agg(F.when(F.count("*") == top, F.max("score")).otherwise(float("inf")).alias("bound"))
    rest = asked.filter(F.col("place") >= FIRST).join(last, "q", "left")
    more = _compared(rest.withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), lists, top)
    return _best(near.unionByName(more), top)


def _best(hits: DataFrame, top: int) -> DataFrame:
    rank = Window.partitionBy("q").orderBy("score", F.col("vec_id").asc_nulls_last())
    once = hits.repartition("q").dropDuplicates(["q", "vec_id", "score"])
    return once.withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= top).drop("n")


def op13_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors.filter("vec_id % 100 = 0"), vectors)


QUERIES = {"op13_nearest": op13_nearest}
SQL: dict[str, str] = {}
