"""What was observed in a verification window: interval joins of windows and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.functions.calendar import synoptic_ends

#: A window counts if readings cover this share of its 18 clock hours.
COVERAGE, HOURS = 0.75, 18


def readings_in(windows: DataFrame, readings: DataFrame, entity: str = "entity", valid: str = "valid") -> DataFrame:
    """Rows of ``windows`` (entity, window_start, window_end) with each reading in [start, end).

    A window goes to the one or two days that it touches and is joined on (entity, day); the
    exact bounds are checked after that.
    """
    last = F.col("window_end") - F.expr("interval 1 microsecond")
    days = F.sequence(F.col("window_start").cast("date"), last.cast("date"))
    w = windows.withColumn("join_day", F.explode(days))
    r = readings.withColumn("join_day", F.col(valid).cast("date"))
    joined = w.join(r, [entity, "join_day"])
    return joined.where((F.col(valid) >= F.col("window_start")) & (F.col(valid) < F.col("window_end"))).drop("join_day")


def hourly_extreme(windows: DataFrame, readings: DataFrame, entity: str = "entity", valid: str = "valid", value: str = "reading", coverage: float = COVERAGE) -> DataFrame:
    """``windows`` (distinct rows of entity, variable, window_start, window_end) with ``n_obs``,
    ``hours_covered`` and ``hourly_f``: the largest or smallest reading, null below ``coverage``."""
    keys = [entity, "variable", "window_start", "window_end"]
    got = readings_in(windows.select(keys), readings.where(F.col(value).isNotNull()), entity, valid)
    stats = got.groupBy(keys).agg(
        F.count("*").alias("n_obs"),
        F.countDistinct(F.date_trunc("hour", valid)).alias("hours_covered"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
    )
    out = windows.join(stats, keys, "left")
    need = -(-HOURS * coverage // 1)
    extreme = F.when(F.col("variable") == "max", F.col("high")).otherwise(F.col("low"))
    out = out.withColumn("hourly_f", F.when(F.col("hours_covered") >= need, extreme)).drop("high", "low")
    return out.fillna(0, ["n_obs", "hours_covered"])


def tiled_extreme(windows: DataFrame, reports: DataFrame, entity: str = "entity", valid: str = "valid", lookback: str = "60 minutes", high: str = "max_6h_f", low: str = "min_6h_f") -> DataFrame:
    """``windows`` with ``periods_found`` and ``tiled_f``: the extreme of three 6-hour groups.

    The group of a period ending at H comes from the latest report in [H - lookback, H) that
    carries it; all three periods must have one. Reports and periods meet on (entity, H).
    """
    keys = [entity, "variable", "window_start", "window_end"]
    periods = windows.select(*keys, F.explode(synoptic_ends("window_start")).alias("period_end"))
    six = 6 * 3600
    seconds = F.unix_seconds(F.col(valid).cast("timestamp"))
    up = F.timestamp_seconds((F.floor(seconds / six) + 1) * six).cast("timestamp_ntz")
    r = reports.select(entity, F.col(valid).alias("report_at"), high, low, up.alias("period_end"))
    r = r.where(F.col("report_at") >= F.col("period_end") - F.expr(f"interval {lookback}"))
    value = F.when(F.col("variable") == "max", F.col(high)).otherwise(F.col(low))
    found = periods.join(r, [entity, "period_end"]).withColumn("value", value).where("value is not null")
    latest = found.groupBy(*keys, "period_end").agg(F.max_by("value", "report_at").alias("value"))
    tiled = latest.groupBy(keys).agg(F.count("*").cast("int").alias("periods_found"), F.max("value").alias("high"), F.min("value").alias("low"))
    extreme = F.when(F.col("variable") == "max", F.col("high")).otherwise(F.col("low"))
    out = windows.join(tiled, keys, "left").withColumn("tiled_f", F.when(F.col("periods_found") == 3, extreme))
    return out.drop("high", "low").fillna(0, ["periods_found"])


def resolve_observed(windows: DataFrame, readings: DataFrame, reports: DataFrame, entity: str = "entity", valid: str = "valid", value: str = "reading", coverage: float = COVERAGE) -> DataFrame:
    """``windows`` with what was observed: the tiled extreme if complete, else the hourly one.

    Adds ``observed_f``, ``extreme_source`` (tiled, hourly or null), ``scorable``,
    ``hours_expected`` and the columns of both methods.
    """
    out = tiled_extreme(hourly_extreme(windows, readings, entity, valid, value, coverage), reports, entity, valid)
    source = F.when(F.col("tiled_f").isNotNull(), "tiled").when(F.col("hourly_f").isNotNull(), "hourly")
    out = out.withColumn("observed_f", F.coalesce("tiled_f", "hourly_f")).withColumn("extreme_source", source)
    return out.withColumn("scorable", F.col("observed_f").isNotNull()).withColumn("hours_expected", F.lit(HOURS))


def re_resolve(old: DataFrame, windows: DataFrame, readings: DataFrame, reports: DataFrame, now: str, days: int = 4, entity: str = "entity", valid: str = "valid", value: str = "reading", coverage: float = COVERAGE) -> DataFrame:
    """``old`` with the windows of the last ``days`` target dates up to ``now`` resolved again, since readings come late.

    ``windows`` has what :func:`resolve_observed` takes and ``target_date``; windows of those dates
    that ``old`` lacks are added. Readings are cut to the days that these windows touch, which
    prunes a table that is partitioned by date.
    """
    day = F.lit(now).cast("date")
    recent = F.col("target_date").between(F.date_sub(day, days), day)
    near = lambda df: df.where(F.col(valid) >= F.date_sub(day, days + 1).cast("timestamp_ntz"))
    fresh = resolve_observed(windows.where(recent), near(readings), near(reports), entity, valid, value, coverage)
    return old.where(~recent).unionByName(fresh.select(old.columns))
