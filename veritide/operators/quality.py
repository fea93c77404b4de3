"""Completeness, duplicates, crossings, samples and source comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritide.functions.calendar import days_between

from veritide.sources import commits
from veritide.staging import stage

from .quantiles import exact_quantiles

# --- gaps and completeness -------------------------------------------------


def missing_dates(seen: DataFrame, entities: DataFrame, lo: str, hi: str, entity: str = "station", date: str = "run_date") -> DataFrame:
    """(entity, date) of a calendar that ``seen`` lacks."""
    calendar = entities.select(entity).distinct().withColumn(date, F.explode(days_between(lo, hi)))
    return calendar.join(seen.select(entity, date).distinct(), [entity, date], "left_anti")


def gap_date(expected: str = "expected"):
    """The date that a gap's text key starts with."""
    return F.to_date(F.substring(expected, 1, 10))


def completeness(gaps: DataFrame, stations: DataFrame, lo: str, hi: str) -> DataFrame:
    """``station, year, expected_days, gap_days, gap_rate`` for every station and year, zeros included.

    A day with several gaps counts once. The scaffold is stations times years, both small.
    """
    years = gaps.sparkSession.range(1).select(F.explode(days_between(lo, hi)).alias("d")).groupBy(F.year("d").alias("year")).agg(F.count("*").alias("expected_days"))
    inside = gaps.where(F.col("gap_date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    found = inside.groupBy("station", F.year("gap_date").alias("year")).agg(F.countDistinct("gap_date").alias("gap_days"))
    out = stations.select("station").distinct().crossJoin(F.broadcast(years)).join(found, ["station", "year"], "left").fillna(0, ["gap_days"])
    return out.withColumn("gap_rate", F.col("gap_days") / F.col("expected_days"))


def gap_reasons(gaps: DataFrame, by: Sequence[str] = ("station",), reasons: Sequence[str] | None = None) -> DataFrame:
    """Gaps by reason, days not de-duplicated; with ``reasons``, one column for each of them."""
    if reasons is None:
        return gaps.groupBy(*by, "reason").agg(F.count("*").alias("n"))
    return gaps.groupBy(*by).pivot("reason", list(reasons)).agg(F.count(F.lit(1))).fillna(0)


def over_threshold(gaps: DataFrame, stations: DataFrame, lo: str, hi: str, t: float = 0.10) -> DataFrame:
    """Stations whose gap days exceed a share ``t`` of all days, with their dominant reason (count, then name)."""
    totals = completeness(gaps, stations, lo, hi).groupBy("station").agg(F.sum("gap_days").alias("gap_days"), F.sum("expected_days").alias("expected_days"))
    totals = totals.withColumn("gap_rate", F.col("gap_days") / F.col("expected_days")).where(F.col("gap_rate") > t)
    first = F.row_number().over(W.partitionBy("station").orderBy(F.col("n").desc(), "reason"))
    top = gap_reasons(gaps).withColumn("place", first).where("place = 1").select("station", F.col("reason").alias("dominant_reason"))
    return totals.join(top, "station", "left")


def completeness_wide(gaps: DataFrame, stations: DataFrame, lo: str, hi: str, reasons: Sequence[str]) -> DataFrame:
    """A row for each station: its days, gap days and rate, its gaps by reason in a column each, and the dominant reason."""
    inside = gaps.where(F.col("gap_date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    totals = completeness(gaps, stations, lo, hi).groupBy("station").agg(F.sum("expected_days").alias("expected_days"), F.sum("gap_days").alias("gap_days"))
    wide = gap_reasons(inside, reasons=reasons)
    out = totals.withColumn("gap_rate", F.col("gap_days") / F.col("expected_days")).join(wide, "station", "left").fillna(0, list(reasons))
    most = F.array_max(F.array(*[F.struct(F.col(r).alias("n"), F.lit(-k).alias("place"), F.lit(r).alias("reason")) for k, r in enumerate(sorted(reasons))]))
    return out.withColumn("dominant_reason", F.when(most["n"] > 0, most["reason"])).select("station", "expected_days", "gap_days", "gap_rate", *reasons, "dominant_reason")


def freshness(df: DataFrame, ts: str, now: str, max_age: str) -> DataFrame:
    """``latest, fresh``: whether the newest row is within ``max_age`` of ``now``; an empty table is not fresh."""
    fresh = F.coalesce(F.col("latest") >= F.to_timestamp_ntz(F.lit(now)) - F.expr(f"interval {max_age}"), F.lit(False))
    return df.agg(F.max(ts).alias("latest")).withColumn("fresh", fresh)


def gap_rate(gaps: DataFrame, stations: DataFrame, t: float = 0.05) -> DataFrame:
    """``stations, with_gaps, rate, passed``; no stations is an error."""
    s = stations.select("station").distinct().join(gaps.select("station").distinct().withColumn("gap", F.lit(1)), "station", "left")
    out = s.agg(F.count("*").alias("stations"), F.count("gap").alias("with_gaps"))
    none = F.raise_error(F.lit("no stations"))
    rate = F.when(F.col("stations") == 0, none).otherwise(F.col("with_gaps") / F.col("stations"))
    return out.withColumn("rate", rate).withColumn("passed", F.col("rate") <= t)


# --- duplicate keys ----------------------------------------------------------


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def collapse_conflicts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, column, n_values`` where rows of one key hold different values (NaN equals NaN)."""
    cols = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(*[F.countDistinct(c).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_values")) for c in cols])
    return got.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.column", "p.n_values").where("n_values > 1")


def collapse_by_key(df: DataFrame, keys: Sequence[str], strict: bool = True) -> DataFrame:
    """One row per key: in each column the one value that is not null.

    With ``strict``, a key with two values raises an error that names the first ones; else the
    largest value wins.
    """
    if strict:
        bad = collapse_conflicts(df, keys).orderBy(*keys, "column").limit(5).collect()
        if bad:
            raise ValueError("conflicting values: " + "; ".join(str(r.asDict()) for r in bad))
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in cols]).select(df.columns)


def dedupe_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows_before, rows_after, keys_collapsed`` of a collapse, without doing it."""
    n = df.groupBy(*keys).agg(F.count("*").alias("rows_of_key"))
    return n.agg(F.sum("rows_of_key").alias("rows_before"), F.count("*").alias("rows_after"), F.count_if(F.col("rows_of_key") > 1).alias("keys_collapsed"))


def dedupe(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with repeated keys collapsed; rows of other keys are not touched."""
    twice = duplicate_keys(df, keys).select(*keys)
    return df.join(twice, list(keys), "left_anti").select(df.columns).unionByName(collapse_by_key(df.join(twice, list(keys), "left_semi"), keys))


def dedupe_stored(spark, path: str, schema, keys: Sequence[str], date: str) -> dict:
    """Repair a table of :func:`commits.commit_dates` in place; returns ``rows_before, rows_after, keys_collapsed``.

    Only dates with repeated keys are written. The repaired rows are counted against what the dry
    run has said before they take their place, all dates in one commit; values that conflict
    are an error and leave the table as it is.
    """
    seen = max(commits.numbers(spark, f"{path}/commits"), default=0)
    df = commits.read_dates(spark, path, schema, date, seen or None)
    want = dedupe_report(df, keys).first()
    if not want.keys_collapsed:
        return {"rows_before": want.rows_before or 0, "rows_after": want.rows_after, "keys_collapsed": 0}
    dates = duplicate_keys(df, keys).select(date).distinct()
    rows = stage(dedupe(df.join(dates, date, "left_semi").select(df.columns), keys))
    untouched = df.join(dates, date, "left_anti").count()
    found = rows.agg(F.count("*").alias("n"), F.count_distinct(F.struct(*keys)).alias("k")).first()
    if found.n != found.k or found.n + untouched != want.rows_after:
        raise ValueError(f"{want.rows_after} rows were to stay, {found.n + untouched} would")
    commits.commit_dates(rows, path, date, dates, seen)
    return {"rows_before": want.rows_before, "rows_after": want.rows_after, "keys_collapsed": want.keys_collapsed}


# --- crossings ---------------------------------------------------------------


def sustained_crossing(df: DataFrame, order: str, value: str, t: float, by: Sequence[str] = ()) -> DataFrame:
    """The earliest ``order`` from which every later ``value`` is at least ``t``, per ``by``; no row if there is none."""
    ahead = W.partitionBy(*by).orderBy(order).rowsBetween(0, W.unboundedFollowing)
    marked = df.withColumn("low", F.min(value).over(ahead)).where(F.col("low") >= t)
    return marked.groupBy(*by).agg(F.min(order).alias("crossing")).where("crossing is not null")


def first_crossing(df: DataFrame, order: str, value: str, t: float, by: Sequence[str] = ()) -> DataFrame:
    """The earliest ``order`` whose ``value`` is at least ``t``."""
    return df.where(F.col(value) >= t).groupBy(*by).agg(F.min(order).alias("crossing")).where("crossing is not null")


def first_stable(df: DataFrame, order: str, version: str, by: Sequence[str] = ()) -> DataFrame:
    """The start of the last unbroken run of the newest version: where flips back and forth ended.

    A null version breaks a run, a null ``order`` comes last; of rows of one ``order`` the largest
    version counts as the newest. The last row of each version settles the newest one and the row
    before its run, so no row looks at those after it and no task holds a group.
    """
    names = [f"by{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, names, strict=True)], F.col(order).isNull().alias("late"), F.col(order).alias("at"), F.col(version).alias("of"))
    lasts = rows.groupBy(*names, "of").agg(F.max("late").alias("late"), F.max("at").alias("at"))  # a row for each version of a group
    place = F.struct("late", F.when(~F.col("late"), F.col("at")).alias("at"), "of")
    back = W.partitionBy(*names).orderBy(place.desc())
    ends = lasts.select(*[F.col(k).alias(f"end_{k}") for k in names], F.col("of").alias("newest"), F.row_number().over(back).alias("n"), F.lead(place).over(back).alias("broke")).where("n = 1 and newest is not null")
    met = (F.col("of") == F.col("newest")) & (F.col("broke").isNull() | (place > F.col("broke")))
    for k in names:
        met &= F.col(k).eqNullSafe(F.col(f"end_{k}"))
    steady = rows.join(ends, met).groupBy(*names, "newest").agg(F.min("at").alias("stable_from"))
    return steady.select(*[F.col(k).alias(c) for c, k in zip(by, names, strict=True)], F.col("newest").alias(version), "stable_from")


def coverage_by_date(df: DataFrame, date: str = "date", value: str = "value") -> DataFrame:
    """Share of rows with a value on each date."""
    return df.groupBy(date).agg(F.avg(F.when(F.col(value).isNotNull(), 1.0).otherwise(0.0)).alias("share"))


def classify_probe(df: DataFrame, min_days: int = 2, min_groups: int = 2) -> DataFrame:
    """Per station: days with data, days with enough groups, and the first reason to exclude it.

    ``df`` has station, day, n_reports and n_groups.
    """
    got = df.groupBy("station").agg(F.countDistinct(F.when(F.col("n_reports") > 0, F.col("day"))).alias("data_days"), F.countDistinct(F.when(F.col("n_groups") >= min_groups, F.col("day"))).alias("group_days"), F.countDistinct("day").alias("days"))
    reason = F.when(F.col("data_days") == 0, "no data").when(F.col("data_days") < min_days, "too few days").when(F.col("group_days") < min_days, "no six-hour groups")
    return got.withColumn("reason", reason).withColumn("evidence", F.concat_ws(" ", F.lit("data"), F.concat_ws("/", "data_days", "days"), F.lit("groups"), F.concat_ws("/", "group_days", "days")))


# --- samples -----------------------------------------------------------------


def seats(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """Largest-remainder shares of ``total`` seats: ``stratum, n, seats``; never more than members, ties by name."""
    n = df.groupBy(stratum).agg(F.count("*").alias("n"))
    every = W.partitionBy(F.lit(0))  # one row per stratum
    exact = F.lit(float(total)) * F.col("n") / F.sum("n").over(every)
    s = n.withColumn("exact", exact).withColumn("base", F.least(F.floor("exact"), F.col("n")))
    left = F.lit(total) - F.sum("base").over(every)
    s = s.withColumn("left", left).withColumn("room", F.col("base") < F.col("n"))
    place = F.row_number().over(W.partitionBy("room").orderBy((F.col("exact") - F.col("base")).desc(), stratum))
    s = s.withColumn("seats", F.col("base") + F.when(F.col("room") & (place <= F.col("left")), 1).otherwise(0))
    return s.select(stratum, "n", "seats")


def stratified_sample(df: DataFrame, stratum: str, key: str, total: int) -> DataFrame:
    """Evenly spaced members of each stratum in ``key`` order, as many as it has seats (both ends included)."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(stratum).orderBy(key)) - 1)
    s = seats(df, stratum, total)
    step = lambda i: F.bround(i * (F.col("n") - 1) / F.greatest(F.col("seats") - 1, F.lit(1))).cast("int")
    spaced = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.col("seats") - 1), step))
    places = s.where("seats > 0").select(F.col(stratum), F.explode(F.when(F.col("seats") == 1, F.array(F.lit(0))).otherwise(spaced)).alias("rank"))
    return ranked.join(places, [stratum, "rank"]).drop("rank")


# --- comparing sources -------------------------------------------------------


def outliers(df: DataFrame, a: str, b: str, t: float = 10.0) -> DataFrame:
    """Rows whose values differ by more than ``t``; nulls never do."""
    return df.where(F.abs(F.col(a) - F.col(b)) > t)


def compare_sources(df: DataFrame, a: str, b: str, truth: str, sets: Sequence[Sequence[str]]) -> DataFrame:
    """``a`` against ``b`` and both against ``truth`` at several grains in one pass.

    Rows, share with ``a``, mean, median, 5th and 95th percentile of a - b (exact, see
    :func:`exact_quantiles`), mean of each less the truth, and the share of ``a`` within 1 of it.
    """
    diff, off = F.col(a) - F.col(b), F.col(a) - F.col(truth)
    dims = list(dict.fromkeys(d for s in sets for d in s))
    work = df.withColumns({"diff": diff, "off": off})
    means = work.groupingSets([list(s) for s in sets], *dims).agg(
        F.grouping_id().alias("grouping"),
        F.count("*").alias("n"),
        F.avg(F.when(F.col(a).isNotNull(), 1.0).otherwise(0.0)).alias("share_a"),
        F.avg("diff").alias("mean_diff"),
        F.avg("off").alias("mean_off_a"),
        F.avg(F.col(b) - F.col(truth)).alias("mean_off_b"),
        F.avg(F.when(F.col("off").isNotNull(), (F.abs("off") <= 1).cast("double"))).alias("within_1"),
    )
    # How often each difference occurs at the finest grain; the coarser ones add those up.
    fine = work.groupBy(*dims, "diff").agg(F.count("*").alias("m"))
    counts = fine.groupingSets([[*s, "diff"] for s in sets], *dims, "diff").agg(F.expr("grouping_id() div 2").alias("grouping"), F.sum("m").alias("m"))
    keys = ["grouping", *dims]
    spread = exact_quantiles(counts, keys, "diff", {"median_diff": 0.5, "p05_diff": 0.05, "p95_diff": 0.95}, "m")
    out = means.join(spread, [means[k].eqNullSafe(spread[k]) for k in keys])
    return out.select(*[means[d] for d in dims], means["grouping"], "n", "share_a", "mean_diff", "median_diff", "p05_diff", "p95_diff", "mean_off_a", "mean_off_b", "within_1")


def loso_mae(df: DataFrame, a: str, truth: str, station: str = "station", stratum: Sequence[str] = ("variable", "season"), by: Sequence[str] = ("variable",)) -> DataFrame:
    """Mean absolute error after a correction per stratum that leaves the row's own station out.

    The correction is the stratum's total less the station's own, so no fold is run by itself;
    a stratum with one station has none and its rows drop out.
    """
    work = df.withColumn("off", F.col(a) - F.col(truth)).where("off is not null")
    own = work.groupBy(*stratum, station).agg(F.sum("off").alias("s"), F.count("*").alias("m"))
    whole = own.groupBy(*stratum).agg(F.sum("s").alias("ws"), F.sum("m").alias("wm"))
    fix = own.join(whole, list(stratum)).where("wm > m").select(*stratum, station, ((F.col("ws") - F.col("s")) / (F.col("wm") - F.col("m"))).alias("fix"))
    return work.join(fix, [*stratum, station]).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("off") - F.col("fix"))).alias("mae"))


def window_scaffold(stations: DataFrame, lo: str, hi: str) -> DataFrame:
    """Every station, date and variable of a period; stations and the calendar are small."""
    days = stations.sparkSession.range(1).select(F.explode(days_between(lo, hi)).alias("target_date"))
    return stations.select("station").distinct().crossJoin(F.broadcast(days)).withColumn("variable", F.explode(F.array(F.lit("max"), F.lit("min"))))


def key_parity(df: DataFrame, keys: Sequence[str], by: str = "source") -> DataFrame:
    """Rows and distinct keys of each source."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct(F.struct(*keys)).alias("n_keys"))
