"""Mix sources to target weights by weighted fair queueing.

Every source is a queue that holds its documents in a shuffled order, once per
allowed repeat. A copy's virtual finish time is the queue's words up to and with
that copy, divided by the source's weight. All copies are sorted by virtual finish
time over the whole corpus and the sequence is truncated where the words sent reach
the budget. Served so, queues send words in proportion to their weights, and an empty
queue leaves its share to the others.

Running sums go through buckets of the shuffled order, so that a source with a
third of all rows is thousands of window groups. The sorted sequence is cut into
ranges; sums per range find the range in which the budget is spent, and only that
range is walked through. What comes out of the sort is one place in the sequence, so
documents themselves are not moved by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idsift.llm import common

#: Buckets of the shuffled order: leading hexadecimal digits of its hash.
BUCKET_DIGITS = 3
OWN = ("size", "source_size", "weight", "target", "taken", "served_before", "virtual_finish")
#: Rows of a range of the sorted sequence, about.
RANGE_ROWS = 500_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("bigint")


def cyclic_weights(source_rank: Column) -> Column:
    """1, 2, 3, repeating."""
    return (source_rank - 1) % 3 + 1


def shares(totals: DataFrame, weights=cyclic_weights, max_repeats: int = 3) -> DataFrame:
    """source, source_size -> and rank, weight, target: what weighted sharing gives to a
    source that sends its documents max_repeats times at most.

    Sources are ranked by code point, null last. With sources in the order in which
    they would run empty, g_k is the time at which the budget is spent if the first
    k - 1 are empty by then. Each g_k is at most the true end, and one of them is it,
    so the end is their maximum.
    """
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", weights(F.col("rank")).cast("bigint"))
    drained = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(
        F.sum("source_size").over(drained.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ) * max_repeats
    active = F.sum("weight").over(drained.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = Window.partitionBy()
    return (
        ranked.withColumn("spent", (F.sum("source_size").over(whole) - before).cast("double") / active.cast("double"))
        .withColumn("end_time", F.max("spent").over(whole))
        .withColumn(
            "target",
            F.least(
                (F.col("source_size") * max_repeats).cast("double"),
                F.col("weight").cast("double") * F.col("end_time"),
            ),
        )
        .drop("spent", "end_time")
    )


def queued(docs: DataFrame, carry: list[str], weights, max_repeats: int, seed: str) -> DataFrame:
    """row (the columns to carry), source, size, source_size, rank, weight, target and
    served_before, see `mix`."""
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        "source",
        words(F.col("text")).alias("size"),
        F.md5(F.coalesce("text", F.lit(""))).alias("print"),
        order.alias("order"),
        F.substring(order, 1, BUCKET_DIGITS).alias("bucket"),
    )
    parts = sized.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    share = shares(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, max_repeats)
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("part").over(upto), F.lit(0))).alias("p").join(
        share.alias("s"), F.expr("p.source <=> s.source")
    ).select("p.source", "p.bucket", "offset", "source_size", "rank", "weight", "target")
    # Documents of one id come by their texts, so that reruns agree.
    inside = (
        Window.partitionBy("source", "bucket").orderBy("order", "size", "print")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    waiting = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d").join(
        offsets.alias("o"), F.expr("d.source <=> o.source and d.bucket = o.bucket")
    )
    return waiting.select(
        "row", "d.source", "size", "source_size", "rank", "weight", "target",
        (F.col("offset") + F.col("inside")).alias("served_before"),
    )


def _finish(repeat: int | Column) -> Column:
    """Virtual finish time of a document's copy."""
    end = F.col("source_size") * repeat + F.col("served_before") + F.col("size")
    return end.cast("double") / F.col("weight").cast("double")


def cut_of(waiting: DataFrame, max_repeats: int) -> tuple[float, int, int] | None:
    """Where the sequence of copies, by virtual finish time, then source, reaches the
    budget: that copy's finish and source, and the words still sent of it. Copies of one
    source never finish together, so the order is total."""
    repeats = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("repeat")
    copies = waiting.filter("size > 0").select("size", "source_size", "served_before", "weight", "rank", repeats).select(
        _finish(F.col("repeat")).alias("finish"), "rank", "size"
    )
    budget, n = waiting.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not budget:
        return None
    ranges = max(1, -(-n * max_repeats // RANGE_ROWS))
    ordered = common.stored(
        copies.repartitionByRange(ranges, "finish", "rank").withColumn("range", F.spark_partition_id()), "sequence"
    )
    # A row per range.
    sums = ordered.groupBy("range").agg(F.sum("size").alias("sent"))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    reached = sums.withColumn("before", F.coalesce(F.sum("sent").over(upto), F.lit(0)))
    at = reached.filter((F.col("before") < budget) & (F.col("before") + F.col("sent") >= budget)).first()
    inside = Window.orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, -1)
    walked = ordered.filter(F.col("range") == at["range"]).withColumn(
        "before", F.coalesce(F.sum("size").over(inside), F.lit(0)) + at["before"]
    )
    last = walked.filter((F.col("before") < budget) & (F.col("before") + F.col("size") >= budget)).first()
    common.discard(ordered)
    return last["finish"], last["rank"], budget - last["before"]


def mix(
    docs: DataFrame, weights=cyclic_weights, max_repeats: int = 3, seed: str = "mix", carry: list[str] | None = None
) -> DataFrame:
    """All rows of docs (doc_id, text, source, ...) with the columns to carry (None: all),
    and with them

    size           words of the text (null or empty text: 0)
    source_size    words of the source
    weight, target the source's share of the budget, which is the sum of all sizes
    taken          words of this document that the mix sends, repeats counted
    served_before  words of its source before it in the shuffled order
    virtual_finish virtual time at which its first copy is sent

    The copy that is being sent when the budget is spent is cut there, one in all, so a
    source comes within a document of its target and all sources together take the budget
    exactly. Null sources are one source. Repeated rows are documents of their own.
    Empty documents take nothing. An empty table gives an empty mix. Input columns with
    the names above are replaced.
    """
    carry = [c for c in carry or docs.columns if c.lower() not in OWN]
    waiting = common.stored(queued(docs, carry, weights, max_repeats, seed), "queues")
    cut = cut_of(waiting, max_repeats)
    taken = F.lit(0)
    for repeat in range(max_repeats if cut else 0):
        finish, (end, source, rest) = _finish(repeat), cut
        before = (finish < end) | ((finish == end) & (F.col("rank") < source))
        taken = taken + F.when(F.col("size") == 0, 0).when(before, F.col("size")).when(
            (finish == end) & (F.col("rank") == source), F.lit(rest)
        ).otherwise(0)
    return waiting.select(
        *[F.col("row")[c].alias(c) for c in carry],
        "size", "source_size", "weight", "target", taken.cast("bigint").alias("taken"), "served_before",
        _finish(0).alias("virtual_finish"),
    )


def schedule(mixed: DataFrame, max_repeats: int = 3) -> DataFrame:
    """The mix as a sequence: a row per copy that is sent, with its repeat and the words
    sent of it, range-sorted by virtual finish. Output files are in the order of the mix."""
    return (
        mixed.filter("taken > 0")
        .withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
        .withColumn("sent", F.least(F.col("size"), F.col("taken") - F.col("size") * F.col("repeat")).cast("bigint"))
        .filter("sent > 0")
        .withColumn("virtual_finish", _finish(F.col("repeat")))
        .orderBy("virtual_finish", "source", "doc_id", "repeat")
    )


def op3_mix(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return mix(docs, carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


SQL_MIX = """
with sized as (
  select *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    md5('mix:' || coalesce(cast(doc_id as varchar), '')) as ord from {docs}),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, row_number() over (order by source nulls last) as rank, (rank - 1) % 3 + 1 as weight from totals),
spent as (
  select *, (sum(source_size) over ()
      - 3 * coalesce(sum(source_size) over (order by source_size / weight, source nulls last
          rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over (order by source_size / weight, source nulls last
          rows between current row and unbounded following))::double as g from ranked),
ended as (select *, max(g) over () as end_time from spent),
share as (select *, least((3 * source_size)::double, weight::double * end_time) as target from ended),
queued as (
  select row_number() over () as r, d.*, coalesce(sum(size) over (partition by source order by ord, size
    rows between unbounded preceding and 1 preceding), 0)::bigint as before from sized d),
copies as (
  select q.*, s.source_size, s.target, rank, (s.source_size * k + before + size)::double / weight::double as finish
  from queued q join share s on q.source is not distinct from s.source, range(0, 3) t(k)),
sent as (
  select *, sum(size) over (order by finish, rank rows between unbounded preceding and current row) - size as sent_before,
    (select sum(size) from sized) as budget from copies),
mixed as (
  select r, doc_id, size, source_size, target, sum(greatest(0, least(size, budget - sent_before)))::bigint as taken
  from sent group by all)
"""

QUERIES = {"op3_mix": op3_mix}
SQL = {
    "op3_mix": SQL_MIX.format(docs="documents")
    + "select doc_id, size::bigint as size, source_size, target, taken from mixed"
}
