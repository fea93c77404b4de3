"""Exact quantiles of groups of any size, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritide.staging import stage


def interpolated(low: Column, high: Column, place: Column) -> Column:
    """Between the values at the whole places around ``place``, in proportion."""
    return F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place)))


def exact_quantiles(counts: DataFrame, keys: Sequence[str], value: str, at: dict[str, float], n: str = "n") -> DataFrame:
    """``keys`` and a column for each quantile of ``at`` (name: share), as ``percentile`` gives them.

    ``counts`` has ``n`` for each distinct value of a group; nulls count for nothing, and a group
    of nulls has null quantiles. Distinct values are dealt to ranges of (keys, value), so that a
    large group lies in many of them. Each range sums up its part of a group, the sums before it
    give the place of its first value, and the values around the wanted places are picked out by
    one more aggregation. No task holds more than a range, or a row for each range of a group.
    """
    keys = list(keys)
    rows = counts.groupBy(*keys, value).agg(F.sum(n).alias("_n"))
    ranged = stage(rows.where(F.col(value).isNotNull()).repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))
    within = ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("_sum").over(W.partitionBy(*keys)).alias("_total")
    starts = within.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"), total)
    own = W.partitionBy("_range", *keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    placed = ranged.withColumn("_upto", F.sum("_n").over(own))
    same = [placed["_range"] == starts["_range"], *[placed[k].eqNullSafe(starts[k]) for k in keys]]
    both = placed.join(starts, same).select(*[placed[k] for k in keys], value, "_total", (F.col("_start") + F.col("_upto")).alias("_last"), (F.col("_start") + F.col("_upto") - F.col("_n")).alias("_first"))
    holds = lambda k: F.max(F.when((F.col("_first") <= k) & (k < F.col("_last")), F.col(value)))
    picks = []
    for name, share in at.items():
        place = (F.col("_total") - 1) * F.lit(float(share))
        picks += [holds(F.floor(place)).alias(f"_{name}_low"), holds(F.ceil(place)).alias(f"_{name}_high"), F.max(place).alias(f"_{name}_at")]
    found = both.groupBy(*keys).agg(*picks)
    found = found.select(*keys, *[interpolated(F.col(f"_{k}_low"), F.col(f"_{k}_high"), F.col(f"_{k}_at")).alias(k) for k in at])
    every = rows.select(*keys).distinct()
    return every.join(found, [every[k].eqNullSafe(found[k]) for k in keys], "left").select(*[every[k] for k in keys], *at)
