"""Exact order statistics that never put one whole group into one task.

A group may hold a third of all rows, so a window over the raw rows of a group
or a ``percentile`` buffer with all of its values does not scale. Equal values are
merged first. Splitters from an approximate quantile pass then cut each group's
distinct values into bins of about equal size, however closely the values lie.
Windows run over the bins' totals, and inside the bins that matter.

Groups are joined as structs, in which null keys are equal, and no keys are one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bins of a group, and the accuracy of their borders.
BINS, ACCURACY = 64, 2_000


def group_of(keys: list[str]) -> Column:
    return F.struct(F.lit(0).alias("_0"), *keys).alias("_g")


def binned(merged: DataFrame, value: str) -> DataFrame:
    """Rows ``_g, value, ...``, one per group and value, with a bin that rises with it."""
    steps = [i / BINS for i in range(1, BINS)]
    borders = merged.groupBy("_g").agg(F.percentile_approx(value, steps, ACCURACY).alias("_borders"))
    above = F.size(F.filter("_borders", lambda b: F.col(value) >= b))
    return merged.join(borders, "_g").withColumn("_bin", above).drop("_borders")


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per wanted one."""
    valued = df.filter(F.col(value).isNotNull()).select(group_of(keys), F.col(value).cast("double").alias("_v"))
    # Equal values merge before anything else.
    merged = binned(valued.groupBy("_g", "_v").agg(F.count("*").alias("_n")), "_v")
    names, keys = keys, ["_g"]
    bins = merged.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    placed = bins.select(
        *keys, "_bin", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.col("_n").alias("_in_bin"), F.sum("_n").over(whole).alias("_total"),
    )
    ranks = F.array(
        *[
            F.struct(F.lit(name).alias("q"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("pos"))
            for name, p in wanted.items()
        ]
    )
    needed = placed.select("*", F.explode(ranks).alias("r")).select(
        *keys, "_bin", "_before", "r.q", "r.pos", "_in_bin"
    ).filter(
        (F.floor("pos") < F.col("_before") + F.col("_in_bin")) & (F.ceil("pos") >= F.col("_before"))
    )
    targets = needed.groupBy(*keys, "_bin").agg(
        F.first("_before").alias("_before"), F.collect_list(F.struct("q", "pos")).alias("_targets")
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.join(targets, [*keys, "_bin"]).withColumn(
        "_hi", F.col("_before") + F.sum("_n").over(inside)
    ).withColumn("_lo", F.col("_hi") - F.col("_n"))
    hits = ranked.select(*keys, "_v", "_lo", "_hi", F.explode("_targets").alias("t")).select(
        *keys, "_v", F.col("t.q").alias("q"), F.col("t.pos").alias("pos"), "_lo", "_hi"
    )

    def covers(rank: Column) -> Column:
        return (rank >= F.col("_lo")) & (rank < F.col("_hi"))

    out = []
    for name in wanted:
        mine = F.col("q") == name
        low = F.max(F.when(mine & covers(F.floor("pos")), F.col("_v")))
        high = F.max(F.when(mine & covers(F.ceil("pos")), F.col("_v")))
        part = F.max(F.when(mine, F.col("pos") - F.floor("pos")))
        out.append((low + (high - low) * part).alias(name))
    return hits.groupBy("_g").agg(*out).select(*[F.col(f"_g.{k}").alias(k) for k in names], *wanted)


def running_sums(df: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """Per distinct value, ``cum_*``: sums over all rows with that value or a higher one,
    and ``all_*``: sums over the whole group.

    ``df`` needs one row per key and value. Totals per bin are accumulated over
    bins, then over the values of each bin, so no window spans a whole group; the
    group's totals travel with the bins.
    """
    rows = binned(df.select(group_of(keys), value, *sums), value)
    bins = rows.groupBy("_g", "_bin").agg(*[F.sum(s).alias(f"_b_{s}") for s in sums])
    above = Window.partitionBy("_g").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_g")
    offsets = bins.select(
        "_g", "_bin", *[F.coalesce(F.sum(f"_b_{s}").over(above), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_b_{s}").over(whole).alias(f"all_{s}") for s in sums],
    )
    inside = Window.partitionBy("_g", "_bin").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, ["_g", "_bin"]).select(
        *[F.col(f"_g.{k}").alias(k) for k in keys], value, *sums,
        *[(F.col(f"_o_{s}") + F.sum(s).over(inside)).alias(f"cum_{s}") for s in sums],
        *[f"all_{s}" for s in sums],
    )


def top_fraction_mean(df: DataFrame, keys: list[str], value: str, fraction: float) -> DataFrame:
    """Mean of the ``max(1, floor(fraction * n))`` largest values per group."""
    known = df.filter(F.col(value).isNotNull())
    merged = known.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    summed = running_sums(merged, keys, "_v", ["_n"])
    k = F.greatest(F.lit(1), F.floor(F.col("all__n") * fraction))
    # Of each distinct value, as many copies as still fit into the first k.
    taken = F.greatest(F.lit(0), F.least(F.col("_n"), k - (F.col("cum__n") - F.col("_n"))))
    return (
        summed.withColumn("_take", taken)
        .groupBy(*keys)
        .agg((F.sum(F.col("_v") * F.col("_take")) / F.sum("_take")).alias("top_mean"))
    )
