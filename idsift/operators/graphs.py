"""Connected components of many graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from idsift.session import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """Edges ``graph, a, b`` to ``graph, node, root``: each node's smallest reachable one.

    Rounds of two steps. Large star: a node's larger neighbours are tied to the smallest
    node around it. Small star: a node's smaller neighbours are tied to the smallest of
    them. Both take minima, which are combined before the shuffle, so a node with very
    many edges is no group; the number of rounds grows with the logarithm of the nodes.
    A round is written to the shared folder and the one before it removed.
    """
    tie = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = materialize(edges.filter("a <> b").select("graph", *tie("a", "b")).distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.select("graph", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select("graph", F.col("b").alias("u"), F.col("a").alias("v"))
        )
        lowest = both.groupBy("graph", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(lowest, ["graph", "u"]).select("graph", F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("graph", "a").agg(F.min("b").alias("m"))
        small = large.join(least, ["graph", "a"])
        tied = small.filter("b <> m").select("graph", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("graph", "a", F.col("m").alias("b"))
        )
        after = materialize(tied.distinct(), "edges")
        digest = _digest(after)
        discard(now)
        now = after
        if digest == seen:
            break
        seen = digest
    leaves = now.select("graph", F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(now.select("graph", F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("graph", "a", "b").cast("decimal(38,0)"))).first())
