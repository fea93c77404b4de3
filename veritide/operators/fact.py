"""Forecasts joined to outcomes in one tagged fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.functions.calendar import lead_day, target_of, window

from .windows import COVERAGE, resolve_observed

KEY = ["station", "run_date", "lead_day", "variable"]


def tag_range(df: DataFrame, ranges: DataFrame, on: str, tag: str, lo: str = "valid_from", hi: str = "valid_to", closed: bool = False) -> DataFrame:
    """``df`` with the ``tag`` of the range that holds ``on``: [lo, hi), or [lo, hi] if ``closed``.

    An open end is null; rows without a range keep a null tag. ``ranges`` is a small dimension
    that must not overlap; a change of the number of rows would show there first.
    """
    r = ranges.select(F.col(lo).alias("range_lo"), F.col(hi).alias("range_hi"), tag)
    at = F.col(on)
    below = at <= F.col("range_hi") if closed else at < F.col("range_hi")
    inside = (at >= F.col("range_lo")) & (F.col("range_hi").isNull() | below)
    small = ranges.count() <= 10_000
    if not small:
        raise ValueError("tag_range takes dimensions of at most 10,000 ranges")
    return df.join(F.broadcast(r), inside, "left").drop("range_lo", "range_hi")


def hour_of(df: DataFrame, regimes: DataFrame, on: str = "run_date", tag: str = "cycle_hour") -> DataFrame:
    """``df`` with the canonical hour of each date; a date that no closed range covers is an error."""
    out = tag_range(df, regimes, on, tag, closed=True)
    bad = F.raise_error(F.concat(F.lit("no regime covers "), F.col(on).cast("string")))
    return out.withColumn(tag, F.when(F.col(tag).isNull(), bad).otherwise(F.col(tag)))


def build_pairs(guidance: DataFrame, resolved: DataFrame, daily: DataFrame, versions: DataFrame, regimes: DataFrame, leads=(1, 2, 3)) -> DataFrame:
    """Raw verification pairs: guidance ⋈ resolved windows on (station, runtime, ftime), left ⋈ daily reports.

    Keeps forecasts that are not null at ``leads``; adds ``error_f`` where scorable,
    ``daily_f`` (the high for a maximum, the low for a minimum), the version valid at the run
    time (half-open) and the cycle regime of the run date (closed).
    """
    g = guidance.select("station", "runtime", "ftime", F.col("txn").alias("forecast_f"), F.col("xnd").alias("spread_f"), F.col("tmp").alias("tmp_f"))
    p = resolved.join(g.where("forecast_f is not null"), ["station", "runtime", "ftime"])
    d = daily.select("station", F.col("local_date").alias("target_date"), "high_f", "low_f")
    p = p.join(d, ["station", "target_date"], "left")
    p = p.withColumn("daily_f", F.when(F.col("variable") == "max", F.col("high_f")).otherwise(F.col("low_f"))).drop("high_f", "low_f")
    p = p.where(F.col("lead_day").isin(*leads)).withColumn("run_date", F.col("runtime").cast("date"))
    p = p.withColumn("error_f", F.when(F.col("scorable"), F.col("forecast_f") - F.col("observed_f")))
    p = tag_range(p, versions, "runtime", "version")
    return tag_range(p, regimes, "run_date", "regime", closed=True)


def build_fact(pairs: DataFrame, predictions: DataFrame, raw: str = "raw_nbm") -> DataFrame:
    """``pairs`` under source ``raw``, and each prediction with the outcome of its pair.

    ``predictions`` has the key, ``source`` and ``forecast_f``; predictions without a pair drop
    out here (see :func:`orphans`).
    """
    mine = predictions.select(*KEY, "source", F.col("forecast_f").alias("predicted_f"))
    other = pairs.join(mine, KEY).withColumn("forecast_f", F.col("predicted_f")).drop("predicted_f")
    other = other.withColumn("error_f", F.when(F.col("scorable"), F.col("forecast_f") - F.col("observed_f")))
    return pairs.withColumn("source", F.lit(raw)).unionByName(other)


def orphans(predictions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Predictions whose key has no pair."""
    return predictions.join(pairs.select(KEY), KEY, "left_anti")


def boundaries(versions: DataFrame, regimes: DataFrame) -> DataFrame:
    """Every change of version or regime: ``boundary_date, kind, label, ends`` (null while it lasts)."""
    def side(df, kind, label):
        return df.select(F.col("valid_from").cast("date").alias("boundary_date"), F.lit(kind).alias("kind"), F.col(label).cast("string").alias("label"), F.col("valid_to").cast("date").alias("ends"))

    return side(versions, "version", "version").unionByName(side(regimes, "regime", "regime"))


def regime_mismatches(pairs: DataFrame, regimes: DataFrame, hour: str = "cycle_hour") -> DataFrame:
    """Pairs whose cycle hour is not that of the regime of their run date."""
    r = regimes.withColumnRenamed(hour, "regime_hour")
    return tag_range(pairs, r, "run_date", "regime_hour", closed=True).where(F.col(hour) != F.col("regime_hour"))


def targets(guidance: DataFrame) -> DataFrame:
    """``station, runtime, ftime`` of guidance rows with what they verify: target date, variable, lead and window."""
    date, variable = target_of("ftime")
    out = guidance.select("station", "runtime", "ftime").withColumns({"target_date": date, "variable": variable})
    start, end = window("target_date", "variable")
    run = F.col("runtime").cast("date")
    return out.withColumns({"lead_day": lead_day("target_date", run), "window_start": start, "window_end": end})


def pairs_from(guidance: DataFrame, readings: DataFrame, reports: DataFrame, daily: DataFrame, versions: DataFrame, regimes: DataFrame, leads=(1, 2, 3), coverage: float = COVERAGE) -> DataFrame:
    """Raw verification pairs from what readers give: windows of the guidance are resolved once each, then joined.

    ``readings`` has station, valid and tmpf, ``reports`` station, valid and the 6-hour groups.
    """
    aims = targets(guidance).where(F.col("lead_day").isin(*leads))
    keys = ["station", "variable", "window_start", "window_end"]
    seen = resolve_observed(aims.select(keys).distinct(), readings, reports, "station", "valid", "tmpf", coverage)
    return build_pairs(guidance, aims.join(seen, keys), daily, versions, regimes, leads)


def violations(facts: DataFrame, pairs: DataFrame, predictions: DataFrame, raw: str = "raw_nbm", slack: float = 1e-4) -> DataFrame:
    """``rule`` and key of every row of a fact table that breaks a rule; empty if it is sound.

    ``facts`` needs scorable, forecast_f, observed_f, error_f, extreme_source and tmp_f,
    ``predictions`` the raw forecast they were made from. A null where a value is due breaks a rule.
    """
    off = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) > slack, ~F.col(a).eqNullSafe(F.col(b)))
    known = F.col("extreme_source").isNotNull()
    rules = {
        "error is not forecast minus observed": F.col("scorable") & F.coalesce(F.abs(F.col("error_f") - (F.col("forecast_f") - F.col("observed_f"))) > slack, F.lit(True)),
        "scorable and missing values disagree": F.when(F.col("scorable"), F.col("observed_f").isNull() | F.col("error_f").isNull()).otherwise(F.col("error_f").isNotNull()),
        "scorable and source of the extreme disagree": F.coalesce(F.col("scorable"), F.lit(False)) != known,
    }
    key = [*KEY, "source"]
    each = F.explode(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])).alias("rule")
    own = facts.select(*key, each).where("rule is not null")
    base = pairs.select(*KEY, F.col("forecast_f").alias("pair_forecast"), F.col("tmp_f").alias("pair_tmp"), F.lit(True).alias("known"))
    both = predictions.select(*key, "raw_forecast_f").join(base, KEY, "left")
    lost = both.where("known is null").select(*key, F.lit("prediction without a pair").alias("rule"))
    other = both.where("known").where(off("raw_forecast_f", "pair_forecast")).select(*key, F.lit("raw forecast of a prediction is not that of its pair").alias("rule"))
    warm = facts.select(*key, "tmp_f").join(base, KEY).where(~F.col("tmp_f").eqNullSafe(F.col("pair_tmp"))).select(*key, F.lit("tmp_f is not that of the pair").alias("rule"))
    return own.unionByName(lost).unionByName(other).unionByName(warm)
