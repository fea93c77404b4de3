"""Structured Streaming forms of the incremental semantics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veritide.sources import commits
from veritide.sources.sinks import merge_rows
from veritide.staging import stage


def split_late(rows: DataFrame, clock: str = "arrived_at") -> DataFrame:
    """``rows`` with ``late``: whether the window had closed when the row arrived (strictly: at the close it is late)."""
    return rows.withColumn("late", F.col("window_end") <= F.col(clock))


def resolved_windows(readings: DataFrame, entity: str = "entity", valid: str = "valid", value: str = "reading", hours: int = 6, lateness: str = "2 hours") -> DataFrame:
    """Tumbling windows of a stream of readings with their extremes; readings later than ``lateness`` are dropped."""
    timed = readings.withWatermark(valid, lateness)
    return timed.groupBy(entity, F.window(valid, f"{hours} hours").alias("w")).agg(F.count("*").alias("n_obs"), F.max(value).alias("high"), F.min(value).alias("low")).select(entity, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_obs", "high", "low")


def running_means(pairs: DataFrame, group: list[str], keep: int = 7, order: str = "window_end", error: str = "error_f") -> DataFrame:
    """Per group and micro-batch, the last ``keep`` errors in close order as state: ``n, mean_3, mean_7``.

    State is bounded by ``keep`` rows a group; a pair is absorbed once.
    """
    schema = pairs.select(group).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def absorb(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values = state.get if state.exists else ([], [])
        held = list(zip(times, values, strict=True))
        for pdf in batches:
            held += zip(pdf[order].astype("int64").tolist(), pdf[error].astype(float).tolist(), strict=True)
        held = sorted(held)[-keep:]
        state.update(([t for t, _ in held], [v for _, v in held]))
        last = pd.Series([v for _, v in held], dtype=float)  # positions first, then nulls are skipped, as in the batch form
        yield pd.DataFrame([[*key, len(held), last[-3:].mean(), last[-7:].mean()]], columns=[*group, "n", "mean_3", "mean_7"])

    return pairs.groupBy(*group).applyInPandasWithState(absorb, f"{fields}, n long, mean_3 double, mean_7 double", "times array<long>, errors array<double>", "update", GroupStateTimeout.NoTimeout)


def slice_writer(path: str, keys: list[str], date: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: rows of a batch replace those of the same ``keys`` and date and join the others.

    One job per batch, whatever slices it holds; a batch that is replayed changes nothing, and a
    later batch that adds to a day leaves what that day has.
    """

    def write(batch: DataFrame, _: int) -> None:
        merge_rows(batch, path, keys, date)

    return write


def late_aside(on_time: str, late: str, keys: list[str], date: str, clock: str = "arrived_at") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that stores rows in time in the table ``on_time`` and keeps late ones aside, counted.

    The batch is read once, its rows and late rows are counted on the way. Rows in time replace
    those of the same ``keys`` and date; late ones go to a folder of the batch under ``late``,
    and the counts to a file of the batch, last of all. All three depend on the batch alone, so a
    batch that is replayed after a crash changes nothing and is counted once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = Observation(f"rows of batch {batch_id}")
        marked = stage(split_late(batch, clock).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late")))
        merge_rows(marked.where("not late").drop("late"), on_time, keys, date)
        marked.where("late").drop("late").write.mode("overwrite").parquet(f"{late}/rows/batch={batch_id}")
        counts = {"batch": batch_id, **seen.get}
        try:
            commits.publish(spark, f"{late}/counts/{batch_id:010d}.json", commits.as_lines([counts]))
        except commits.Conflict:  # a replay
            pass

    return write


def late_counts(spark: SparkSession, late: str) -> DataFrame:
    """``batch, n, n_late`` of every batch that :func:`late_aside` has finished."""
    schema = "batch long, n long, n_late long"
    if not commits.names(spark, f"{late}/counts"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{late}/counts")


def late_resolved(windows: DataFrame, readings: DataFrame, lateness: str = "4 days", entity: str = "entity", valid: str = "valid", value: str = "reading") -> DataFrame:
    """Windows of a stream with what came in for them up to ``lateness`` after their close.

    ``windows`` has entity, variable, window_start and window_end, ``readings`` entity, valid and
    the value; times have a zone, as watermarks take. A reading in [start, end) meets its window
    however the two are cut into batches. A window comes out once, when the readings have passed
    its close by ``lateness``: ``n_obs``, ``high`` and ``low``, nulls where nothing came in.
    Readings that are later still are dropped.
    """
    w = windows.select(F.col(entity).alias("entity"), "variable", "window_start", "window_end").withWatermark("window_end", lateness)
    r = readings.select(F.col(entity).alias("of"), F.col(valid).alias("valid"), F.col(value).alias("value")).withWatermark("valid", lateness)
    met = w.join(r, F.expr("entity = of and valid >= window_start and valid < window_end and valid >= window_end - interval 2 days"), "left_outer")
    got = met.groupBy("entity", "variable", "window_start", "window_end").agg(F.count("value").alias("n_obs"), F.max("value").alias("high"), F.min("value").alias("low"))
    return got.withColumnRenamed("entity", entity)
