"""Connected components, and verified links inside candidate buckets.

Every member first meets its bucket's pivot, which is linear; links join members into
components, and only members of different components meet again: each with each in a
bucket of at most CROWD of them, else in the finer buckets that the caller makes. So a
bucket of copies lists no pairs; without finer buckets one of many unlike members does.

Tables of a round are removed from the shared folder when the next one is written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsift.llm.common import discard, stored

#: Rounds in which members meet a pivot before those still apart meet each other.
PIVOT_ROUNDS = 2
#: Members still apart, in a bucket, that meet each with each where finer buckets can be made.
CROWD = 48


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, component (its smallest node), for nodes on an edge.

    Alternating large and small stars: every node's neighbours are linked to the
    smallest of them until each node has one edge, to its component's smallest node.
    Minima are aggregates with map-side combine, so a node with very many edges is
    no group of its own. Each round is written to the shared folder, and so is the result.
    """
    now = stored(
        edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a <> b").distinct(), "edges"
    )
    last = _digest(now)
    while last[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
            .union(lowest.select("a", F.col("m").alias("b")))
            .distinct()
        )
        before, now = now, stored(small, "edges")
        seen = _digest(now)
        discard(before)
        if seen == last:
            break
        last = seen
    found = stored(
        now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
            now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        ),
        "components",
    )
    discard(now)
    return found


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def linked(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    close: Callable[[Column, Column], Column] | None = None,
    pairs: DataFrame | None = None,
    finer: Callable[[DataFrame], tuple[DataFrame, Callable[[Column, Column], Column]]] | None = None,
) -> DataFrame:
    """members (bucket, node, sig, indexed), pairs (node, pivot), both stored -> verified
    links (a, b), stored, that connect every two nodes which a chain of links between
    candidates would.

    Candidates are the given pairs, whose number the caller bounds, and a member with
    an indexed member of its bucket for which close(sig, sig) holds; verify keeps the
    true ones of (a, b). Each candidate is verified, or its two nodes are in one
    component already.

    finer takes the members (with their component as `own`) that are still apart in crowded
    buckets and returns them in smaller buckets, stored, and what their sigs must fulfil; it
    may part two nodes that are no link and no others.
    """
    close = close or (lambda a, b: F.lit(True))
    tested, links, labels = [], [], None
    active = members
    for turn in range(PIVOT_ROUNDS):
        own = ["own"] if turn else []
        pivots = active.filter("indexed").groupBy("bucket").agg(
            F.min(F.struct(F.xxhash64(F.col("node"), F.lit(turn)).alias("h"), "node", "sig", *own)).alias("p")
        )
        met = active.join(pivots, "bucket").filter(
            (F.col("node") != F.col("p.node")) & close(F.col("sig"), F.col("p.sig"))
            & (F.col("own") != F.col("p.own") if turn else F.lit(True))
        ).select("node", F.col("p.node").alias("pivot"))
        if turn == 0 and pairs is not None:
            both = pairs.select("node", "pivot").union(pairs.select("pivot", "node"))
            met = met.union(both.groupBy("node").agg(F.min("pivot").alias("pivot")))
        _try(met, tested, links, verify)
        before, labels = labels, components(_all(links))
        named = active.drop("own").join(labels.withColumnRenamed("component", "own"), "node", "left").withColumn(
            "own", F.coalesce("own", "node")
        )
        mixed = named.groupBy("bucket").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter("lo <> hi")
        earlier, active = active, stored(named.join(mixed.select("bucket"), "bucket", "left_semi"), "active")
        discard(*([before, earlier] if turn else []))
    made = []
    if finer is None:
        cross = _each(active, close)
    else:
        crowded = active.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("bucket")
        parted, like = finer(active.join(crowded, "bucket", "left_semi"))
        made.append(parted)
        cross = _each(active.join(crowded, "bucket", "left_anti"), close).union(_each(parted, like))
    if pairs is not None:
        cross = cross.union(_apart(pairs.select("node", "pivot"), labels, "node", "pivot"))
    _try(cross, tested, links, verify)
    found = stored(_all(links), "links")
    discard(active, labels, *made, *tested, *links)
    return found


def _each(members: DataFrame, close: Callable[[Column, Column], Column]) -> DataFrame:
    """Members of different components with the indexed ones of their buckets."""
    other = members.filter("indexed").select(
        F.col("bucket").alias("pivot_bucket"), F.col("node").alias("pivot"), F.col("sig").alias("pivot_sig"),
        F.col("own").alias("pivot_own"),
    )
    return members.join(
        other, (F.col("bucket") == F.col("pivot_bucket")) & (F.col("own") != F.col("pivot_own"))
        & close(F.col("sig"), F.col("pivot_sig"))
    ).select("node", "pivot")


def _apart(pairs: DataFrame, labels: DataFrame, *sides: str) -> DataFrame:
    """Pairs whose two nodes have different components."""
    own = []
    for side in sides:
        own.append(f"own_{side}")
        pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("component").alias(own[-1])), side, "left")
        pairs = pairs.withColumn(own[-1], F.coalesce(own[-1], side))
    return pairs.filter(F.col(own[0]) != F.col(own[1])).drop(*own)


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def _try(pairs: DataFrame, tested: list, links: list, verify) -> None:
    """Adds the pairs to those tested and their true ones to the links."""
    fresh = pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    if tested:
        fresh = fresh.join(_all(tested), ["a", "b"], "left_anti")
    tested.append(stored(fresh, "pairs"))
    links.append(stored(verify(tested[-1]).select("a", "b"), "links"))
