"""Queries on windows, completeness, duplicates, series, samples and texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritide.functions import calendar, text
from veritide.operators import contracts, geo, quality, score, series, windows
from veritide.plans import fixtures as fx
from veritide.registry import query
from veritide.sources import sinks
from veritide.staging import staged_path

# --- windows ---------------------------------------------------------------------

_HOURLY = """, hr as (select w.entity, w.variable, w.window_start, w.window_end, count(e.reading) as n_obs, count(distinct date_trunc('hour', e.valid)) as hours_covered,
  case when count(distinct date_trunc('hour', e.valid)) >= {need} then case when w.variable = 'max' then max(e.reading) else min(e.reading) end end as hourly_f
  from win w left join ev e on w.entity = e.entity and e.valid >= w.window_start and e.valid < w.window_end group by w.entity, w.variable, w.window_start, w.window_end)"""
_TILED = """, pe as (select *, window_start + to_hours(h) as period_end from win, (values (6), (12), (18)) p(h)),
pm as (select p.entity, p.variable, p.window_start, p.window_end, p.period_end, arg_max(case when p.variable = 'max' then max_6h_f else min_6h_f end, r.valid) as v
  from pe p join rep r on p.entity = r.entity and r.valid >= p.period_end - interval 6 hour and r.valid < p.period_end
  where case when p.variable = 'max' then max_6h_f else min_6h_f end is not null group by all),
ti as (select entity, variable, window_start, window_end, count(*) as periods_found, case when count(*) = 3 then case when variable = 'max' then max(v) else min(v) end end as tiled_f from pm group by entity, variable, window_start, window_end)"""


@query("with " + fx.WINDOWS + _HOURLY.format(need=2) + " select entity, variable, window_start, n_obs, hours_covered, hourly_f from hr")
def window_extreme_hourly(spark, sf):
    got = windows.hourly_extreme(fx.day_windows(spark, sf), fx.events(spark, sf).select("entity", "valid", "reading"), coverage=2 / 18)
    return got.select("entity", "variable", "window_start", "n_obs", "hours_covered", "hourly_f")


@query("with " + fx.WINDOWS + ", " + fx.REPORTS + _TILED + " select w.entity, w.variable, w.window_start, coalesce(periods_found, 0)::int as periods_found, tiled_f from win w left join ti using (entity, variable, window_start)")
def six_hour_tiled(spark, sf):
    got = windows.tiled_extreme(fx.day_windows(spark, sf), fx.reports(spark, sf), lookback="6 hours")
    return got.select("entity", "variable", "window_start", "periods_found", "tiled_f")


@query("with " + fx.WINDOWS + ", " + fx.REPORTS + _HOURLY.format(need=14) + _TILED.replace("interval 6 hour and", "interval 60 minute and") + """ select w.entity, w.variable, w.window_start, coalesce(tiled_f, hourly_f) as observed_f,
  case when tiled_f is not null then 'tiled' when hourly_f is not null then 'hourly' end as extreme_source, coalesce(tiled_f, hourly_f) is not null as scorable, hours_covered
  from win w join hr using (entity, variable, window_start) left join ti using (entity, variable, window_start)""")
def resolve_observed(spark, sf):
    got = windows.resolve_observed(fx.day_windows(spark, sf), fx.events(spark, sf).select("entity", "valid", "reading"), fx.reports(spark, sf))
    return got.select("entity", "variable", "window_start", "observed_f", "extreme_source", "scorable", "hours_covered")


_AGAIN = """, e0 as (select * from ev where valid < timestamp '2024-01-28'), last as (select max(cast(valid as date)) as d from ev),
twice as (select w.entity, w.variable, w.window_start, cast(w.window_start as date) as target_date, cast(w.window_start as date) >= d - 4 as again,
  count(e.reading) as n_all, count(e.reading) filter (e.valid < timestamp '2024-01-28') as n_old,
  case when w.variable = 'max' then max(e.reading) else min(e.reading) end as now_f,
  case when w.variable = 'max' then max(e.reading) filter (e.valid < timestamp '2024-01-28') else min(e.reading) filter (e.valid < timestamp '2024-01-28') end as old_f
  from last, win w left join ev e on w.entity = e.entity and e.valid >= w.window_start and e.valid < w.window_end group by w.entity, w.variable, w.window_start, d)"""


@query("with " + fx.WINDOWS + _AGAIN + " select entity, variable, window_start, case when again then n_all else n_old end as n_obs, case when again then now_f else old_f end as hourly_f from twice")
def re_resolve(spark, sf):
    """Windows resolved from what had come by a date, the last four days of them resolved again."""
    w, e = fx.day_windows(spark, sf), fx.events(spark, sf).select("entity", "valid", "reading")
    none = fx.reports(spark, sf).where("false")
    early = e.where(F.col("valid") < F.lit("2024-01-28").cast("timestamp_ntz"))
    old = windows.resolve_observed(w, early, none, coverage=1 / 18)
    now = e.agg(F.max("valid").cast("date")).first()[0]
    got = windows.re_resolve(old, w, e, none, str(now), coverage=1 / 18)
    return got.select("entity", "variable", "window_start", "n_obs", "hourly_f")


@query("with " + fx.STATIONS + ", d as (select unnest(range(date '1999-01-01', date '1999-03-01', interval 1 day)) as d) select station, cast(d as date) as target_date, variable from stations, d, (values ('max'), ('min')) v(variable)", ("target_date",))
def window_scaffold(spark, sf):
    return quality.window_scaffold(fx.stations(spark, sf), "1999-01-01", "1999-02-28")


# --- duplicate keys ----------------------------------------------------------------

_HOURS = fx.EVENTS + ", hv as (select entity, date_trunc('hour', valid) as hour, case when event_id % 3 > 0 then reading end as a, case when event_id % 3 = 0 then event_type end as b from ev)"


def _hours(spark, sf):
    e = fx.events(spark, sf)
    third = F.col("event_id") % 3
    return e.select("entity", F.date_trunc("hour", "valid").cast("timestamp_ntz").alias("hour"), F.when(third > 0, F.col("reading")).alias("a"), F.when(third == 0, F.col("event_type")).alias("b"))


@query("with " + _HOURS + " select entity, hour, count(*) as n from hv group by entity, hour having count(*) > 1")
def dup_keys(spark, sf):
    return quality.duplicate_keys(_hours(spark, sf), ["entity", "hour"])


@query("with " + _HOURS + ", c as (select entity, hour, count(distinct a) as a, count(distinct b) as b from hv group by entity, hour) select entity, hour, 'a' as \"column\", a as n_values from c where a > 1 union all select entity, hour, 'b', b from c where b > 1")
def collapse_conflicts(spark, sf):
    return quality.collapse_conflicts(_hours(spark, sf), ["entity", "hour"])


@query("with " + _HOURS + " select entity, hour, max(a) as a, max(b) as b from hv group by entity, hour having count(distinct a) <= 1 and count(distinct b) <= 1")
def collapse_by_key(spark, sf):
    rows = _hours(spark, sf)
    bad = quality.collapse_conflicts(rows, ["entity", "hour"]).select("entity", "hour").distinct()
    return quality.collapse_by_key(rows.join(bad, ["entity", "hour"], "left_anti"), ["entity", "hour"])


@query("with n as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by all) select sum(n)::bigint as rows_before, count(*) as rows_after, count(*) filter (n > 1) as keys_collapsed from n")
def dedupe_report(spark, sf):
    return quality.dedupe_report(fx.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select 'l_quantity is null' as rule, count(*) as n from lineitem where l_quantity is null having count(*) > 0 union all select 'l_returnflag is not an accepted value', count(*) from lineitem where l_returnflag not in ('A', 'N') having count(*) > 0 union all select 'l_orderkey, l_linenumber repeats', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1) having count(*) > 0 union all select 'l_partkey has no p_partkey', count(*) from lineitem where l_partkey not in (select p_partkey from part where p_size > 10) having count(*) > 0")
def constraint_violations(spark, sf):
    rules = [contracts.not_null("l_quantity"), contracts.accepted("l_returnflag", ["A", "N"])]
    parts = fx.table(spark, sf, "part").where("p_size > 10")
    return contracts.violations(fx.table(spark, sf, "lineitem"), rules, [["l_orderkey", "l_linenumber"]], [("l_partkey", parts, "p_partkey")])


@query("with a as (select distinct o_custkey as k from orders), b as (select distinct c_custkey as k from customer where c_nationkey < 20) select k, 'left' as side from a where k not in (select k from b) union all select k, 'right' from b where k not in (select k from a)")
def key_set_difference(spark, sf):
    a = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return contracts.same_keys(a, fx.table(spark, sf, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("k")), ["k"])


# --- completeness ---------------------------------------------------------------------

LO, HI = "1996-02-01", "1999-10-31"
_DAYS = f"d as (select cast(unnest(range(date '{LO}', date '{HI}' + 1, interval 1 day)) as date) as d)"
_CELLS = "with " + fx.GAPS + ", " + fx.STATIONS + ", " + _DAYS + f""", y as (select year(d)::int as year, count(*) as expected_days from d group by 1),
g as (select station, year(gap_date)::int as year, count(distinct gap_date) as gap_days from gaps where gap_date between date '{LO}' and date '{HI}' group by 1, 2),
cells as (select s.station, y.year, expected_days, coalesce(gap_days, 0) as gap_days from stations s cross join y left join g on g.station = s.station and g.year = y.year)"""


@query(_CELLS + " select *, round(gap_days / expected_days::double, 6) as gap_rate from cells")
def gap_days(spark, sf):
    got = quality.completeness(fx.gaps(spark, sf), fx.stations(spark, sf), LO, HI)
    return got.withColumn("gap_rate", F.round("gap_rate", 6))


@query("with " + fx.GAPS + ", s as (select station, count(*) filter (reason = '1') as \"1\", count(*) filter (reason = '2') as \"2\", count(*) filter (reason = '5') as \"5\" from gaps group by station) select * from s")
def gap_reasons_pivot(spark, sf):
    return quality.gap_reasons(fx.gaps(spark, sf), reasons=["1", "2", "5"])


@query(_CELLS + """, t as (select station, sum(expected_days)::bigint as expected_days, sum(gap_days)::bigint as gap_days from cells group by station),
w as (select station, count(*) filter (reason = '1') as "1", count(*) filter (reason = '2') as "2", count(*) filter (reason = '5') as "5" from gaps where gap_date between date '""" + LO + "' and date '" + HI + """' group by station)
select station, expected_days, gap_days, round(gap_days / expected_days::double, 6) as gap_rate, coalesce("1", 0) as "1", coalesce("2", 0) as "2", coalesce("5", 0) as "5",
  case when greatest(coalesce("1", 0), coalesce("2", 0), coalesce("5", 0)) = 0 then null when "1" >= "2" and "1" >= "5" then '1' when "2" >= "5" then '2' else '5' end as dominant_reason from t left join w using (station)""")
def completeness_wide(spark, sf):
    """The wide completeness table as it is handed on: written as one CSV file and read back."""
    got = quality.completeness_wide(fx.gaps(spark, sf), fx.stations(spark, sf), LO, HI, ["1", "2", "5"]).withColumn("gap_rate", F.round("gap_rate", 6))
    path = staged_path(spark)
    sinks.write_csv(got, path)
    return spark.read.schema(got.schema).csv(path, header=True)


@query("with " + fx.GAPS + " select reason, count(*) as n from gaps group by reason")
def gap_reason_counts(spark, sf):
    return quality.gap_reasons(fx.gaps(spark, sf), by=())


@query(_CELLS + """, t as (select station, sum(gap_days)::bigint as gap_days, sum(expected_days)::bigint as expected_days from cells group by station),
r as (select station, reason, row_number() over (partition by station order by count(*) desc, reason) as k from gaps group by station, reason)
select t.station, gap_days, expected_days, round(gap_days / expected_days::double, 6) as gap_rate, reason as dominant_reason from t left join r on r.station = t.station and k = 1 where gap_days / expected_days::double > 0.01""")
def over_threshold(spark, sf):
    got = quality.over_threshold(fx.gaps(spark, sf), fx.stations(spark, sf), LO, HI, 0.01)
    return got.withColumn("gap_rate", F.round("gap_rate", 6))


@query("with " + fx.PAIRS + ", " + _DAYS + ", e as (select distinct station from pairs) select station, d as run_date from e, d where not exists (select 1 from pairs p where p.station = e.station and p.run_date = d.d)", ("run_date",))
def missing_dates(spark, sf):
    p = fx.pairs(spark, sf)
    return quality.missing_dates(p, p, LO, HI)


@query("select max(ts) as latest, max(ts) >= timestamp '2024-01-31 00:00:00' - interval 36 hour as fresh from events")
def freshness(spark, sf):
    return quality.freshness(fx.table(spark, sf, "events"), "ts", "2024-01-31 00:00:00", "36 hours")


@query("with " + fx.GAPS + ", " + fx.STATIONS + " select count(*) as stations, count(*) filter (station in (select station from gaps)) as with_gaps, round(count(*) filter (station in (select station from gaps)) / count(*)::double, 6) as rate, count(*) filter (station in (select station from gaps)) / count(*)::double <= 0.05 as passed from stations")
def gap_rate(spark, sf):
    return quality.gap_rate(fx.gaps(spark, sf), fx.stations(spark, sf)).withColumn("rate", F.round("rate", 6))


@query("with " + fx.GAPS + ", o as (select station, gap_date, reason, min(cast(gap_date as timestamp)) as first_seen from gaps where day(gap_date) <= 20 group by all), n as (select distinct station, gap_date, reason from gaps where day(gap_date) >= 10) select n.station, n.gap_date, n.reason, coalesce(o.first_seen, timestamp '2002-01-01 00:00:00') as first_seen from n left join o using (station, gap_date, reason)", ("gap_date",))
def first_seen_merge(spark, sf):
    g = fx.gaps(spark, sf)
    old = g.where(F.dayofmonth("gap_date") <= 20).withColumn("first_seen", calendar.at_hour("gap_date", 0))
    return sinks.merge_first_seen(old, g.where(F.dayofmonth("gap_date") >= 10), ["station", "gap_date", "reason"], "2002-01-01 00:00:00")


# --- crossings and samples -----------------------------------------------------------------

_SHARE = "ds as (select cast(o_orderdate as date) as date, avg(case when o_totalprice > 100000 then 1.0 else 0.0 end) as share from orders group by 1)"


def _share(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.when(F.col("o_totalprice") > 100000, F.lit(1)).alias("value"))
    return quality.coverage_by_date(o)


@query("with " + _SHARE + " select date, round(share, 6) as share from ds", ("date",))
def coverage_by_date(spark, sf):
    return _share(spark, sf).withColumn("share", F.round("share", 6))


@query("with " + _SHARE + ", m as (select *, min(share) over (order by date rows between current row and unbounded following) as low from ds) select min(date) as crossing from m where low >= 0.5 having min(date) is not null", ("crossing",))
def sustained_crossing(spark, sf):
    return quality.sustained_crossing(_share(spark, sf), "date", "share", 0.5)


@query("with " + _SHARE + " select min(date) as crossing from ds where share >= 0.9 having min(date) is not null", ("crossing",))
def first_crossing(spark, sf):
    return quality.first_crossing(_share(spark, sf), "date", "share", 0.9)


@query("with o as (select o_custkey % 50 as g, o_orderkey as k, o_orderstatus as version from orders), n as (select *, last_value(version) over (partition by g order by k rows between unbounded preceding and unbounded following) as newest from o), s as (select *, min(case when version = newest then 1 else 0 end) over (partition by g order by k rows between current row and unbounded following) as steady from n) select g, newest as version, min(k) as stable_from from s where steady = 1 group by g, newest")
def first_stable(spark, sf):
    o = fx.table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("g"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("version"))
    return quality.first_stable(o, "k", "version", ["g"])


_SEATS = """n as (select c_mktsegment as stratum, count(*) as n from customer group by 1), x as (select *, 37.0 * n / sum(n) over () as exact from n),
b as (select *, least(floor(exact), n)::bigint as base from x), l as (select *, 37 - sum(base) over () as left_, base < n as room from b),
r as (select *, row_number() over (partition by room order by exact - base desc, stratum) as k from l), seats as (select stratum, n, base + case when room and k <= left_ then 1 else 0 end as seats from r)"""


@query("with " + _SEATS + " select stratum, n, seats::bigint as seats from seats")
def seats(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("stratum"))
    return quality.seats(c, "stratum", 37).withColumn("seats", F.col("seats").cast("long"))


@query("with " + _SEATS + ", i as (select stratum, n, seats, unnest(range(seats::bigint)) as i from seats), p as (select distinct stratum, case when seats = 1 then 0 else round_even(i * (n - 1) / greatest(seats - 1, 1)::double, 0)::bigint end as rank from i), c as (select c_custkey, c_mktsegment as stratum, row_number() over (partition by c_mktsegment order by c_custkey) - 1 as rank from customer) select c_custkey, stratum from c join p using (stratum, rank)")
def stratified_sample(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("stratum"))
    return quality.stratified_sample(c, "stratum", "c_custkey", 37).select("c_custkey", "stratum")


@query("with e as (select concat('S', user_id % 9) as station, cast(ts as date) as day, count(*) as n_reports, count(distinct event_type) filter (event_type <> 'view' and user_id % 9 < 7) as n_groups from events where user_id % 9 <> 3 or ts < timestamp '2024-01-02' group by 1, 2), g as (select station, count(distinct case when n_reports > 0 then day end) as data_days, count(distinct case when n_groups >= 2 then day end) as group_days, count(distinct day) as days from e group by station) select station, data_days, group_days, days, case when data_days = 0 then 'no data' when data_days < 2 then 'too few days' when group_days < 2 then 'no six-hour groups' end as reason, concat('data ', data_days, '/', days, ' groups ', group_days, '/', days) as evidence from g")
def classify_probe(spark, sf):
    e = fx.table(spark, sf, "events").where((F.col("user_id") % 9 != 3) | (F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")))
    kind = F.when((F.col("event_type") != "view") & (F.col("user_id") % 9 < 7), F.col("event_type"))
    e = e.groupBy(F.concat(F.lit("S"), F.col("user_id") % 9).alias("station"), F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n_reports"), F.countDistinct(kind).alias("n_groups"))
    return quality.classify_probe(e)


# --- source comparison -----------------------------------------------------------------------

_CMP = fx.FACT + ", cm as (select station, variable, season, cast(round(forecast_f * 100) as bigint) as a, cast(round(observed_f * 100) as bigint) as b, cast(round(observed_f * 90) as bigint) as t from fact where source = 'raw_nbm')"


def _compare(spark, sf):
    rows = fx.pairs(spark, sf).where("scorable")
    cents = lambda c, k: F.round(F.col(c) * k).cast("long")
    return rows.select("station", "variable", calendar.season("target_date").alias("season"), cents("forecast_f", 100).alias("a"), cents("observed_f", 100).alias("b"), cents("observed_f", 90).alias("t"))


@query("with " + _CMP + """ select station, variable, season, grouping(station, variable, season)::bigint as grouping, count(*) as n, round(avg(a - b), 4) as mean_diff,
  round(quantile_cont(a - b, 0.5), 4) as median_diff, round(quantile_cont(a - b, 0.05), 4) as p05_diff, round(quantile_cont(a - b, 0.95), 4) as p95_diff, round(avg(a - t), 4) as mean_off_a,
  round(avg(case when a is not null then 1.0 else 0.0 end), 4) as share_a, round(avg(b - t), 4) as mean_off_b, round(avg(case when abs(a - t) <= 1 then 1.0 else 0.0 end), 4) as within_1
  from cm group by grouping sets ((station, variable, season), (variable), (station, variable))""")
def source_compare(spark, sf):
    got = quality.compare_sources(_compare(spark, sf), "a", "b", "t", [["station", "variable", "season"], ["variable"], ["station", "variable"]])
    names = ["mean_diff", "median_diff", "p05_diff", "p95_diff", "mean_off_a", "share_a", "mean_off_b", "within_1"]
    return got.select("station", "variable", "season", "grouping", "n", *[F.round(c, 4).alias(c) for c in names])


@query("with " + _CMP + """, o as (select station, variable, season, a - t as off from cm), s as (select variable, season, station, sum(off) as s, count(*) as m from o group by all),
f as (select variable, season, station, (sum(s) over (partition by variable, season) - s) / nullif(sum(m) over (partition by variable, season) - m, 0)::double as fix from s)
select variable, count(*) as n, round(avg(abs(off - fix)), 3) as mae from o join f using (variable, season, station) where fix is not null group by variable""")
def loso_mae(spark, sf):
    return quality.loso_mae(_compare(spark, sf), "a", "t").withColumn("mae", F.round("mae", 3))


@query("with " + fx.PAIRS + " select station, run_date, lead_day, variable from pairs where abs(forecast_f - observed_f) > 150000", ("run_date",))
def outliers(spark, sf):
    return quality.outliers(fx.pairs(spark, sf), "forecast_f", "observed_f", 150000.0).select("station", "run_date", "lead_day", "variable")


# --- series -------------------------------------------------------------------------------------

_SERIES = fx.PAIRS + ", po as (select variable, run_date, avg(error_f) as value, count(distinct station) as n_entities from pairs where error_f is not null group by all having count(distinct station) >= 2)"


def _series(spark, sf):
    return series.pooled_series(fx.pairs(spark, sf), 2, ["variable"])


@query("with " + _SERIES + " select variable, run_date, round(value, 4) as value, n_entities from po", ("run_date",))
def pooled_series(spark, sf):
    return _series(spark, sf).withColumn("value", F.round("value", 4))


_ACF = """, de as (select variable, run_date, value - avg(value) over (partition by variable) as d from po),
ac as (select variable, lag, sum(x) as s from (select variable, k.lag, d * lag(d, k.lag) over (partition by variable, k.lag order by run_date) as x from de, (select unnest(range(15))::int as lag) k) group by all),
g0 as (select variable, sum(d * d) as g, count(*) as n from de group by variable)"""


@query("with " + _SERIES + _ACF + " select ac.variable, lag, round(coalesce(s, 0) / g, 6) as acf, round(1.96 / sqrt(n), 6) as band from ac join g0 using (variable) where lag > 0")
def acf(spark, sf):
    got = series.acf(_series(spark, sf), ["variable"], "run_date", "value")
    return got.withColumns({"acf": F.round("acf", 6), "band": F.round("band", 6)})


@query("with " + _SERIES + " select variable, run_date, round(value - avg(value) over (partition by variable order by run_date rows between 15 preceding and 15 following), 4) as residual from po", ("run_date",))
def deseasonalize(spark, sf):
    got = series.deseasonalize(_series(spark, sf), ["variable"], "run_date", "value")
    return got.select("variable", "run_date", F.round("residual", 4).alias("residual"))


@query("with " + fx.PAIRS + ", r as (select station, run_date, error_f, row_number() over (partition by station order by error_f, run_date, lead_day, variable) - 1 as k, count(*) over (partition by station) as n from pairs where scorable) select station, error_f from r where k = n // 2")
def upper_median(spark, sf):
    p = fx.pairs(spark, sf).where("scorable").withColumn("tie", F.struct("run_date", "lead_day", "variable"))
    return series.upper_median(p, ["station"], "error_f", "tie").select("station", "error_f")


@query("with " + _SERIES + _ACF + """, gk as (select ac.variable, lag, coalesce(s, 0) / n as g, n from ac join g0 using (variable)),
w as (select variable, any_value(n) as n, max(g) filter (lag = 0) as a0, max(g) filter (lag = 1) as a1, max(g) filter (lag = 2) as a2 from gk where lag < 3 group by variable),
k as (select *, a1 / a0 as r1 from w), k2 as (select *, (a2 - r1 * a1) / (a0 * (1 - r1 * r1)) as r2, a0 * (1 - r1 * r1) as s1 from k), k3 as (select *, s1 * (1 - r2 * r2) as s2 from k2)
select variable, case when n * ln(a0) <= n * ln(s1) + 2 and n * ln(a0) <= n * ln(s2) + 4 then 0 when n * ln(s1) + 2 <= n * ln(s2) + 4 then 1 else 2 end as p,
  round(case when n * ln(a0) <= n * ln(s1) + 2 and n * ln(a0) <= n * ln(s2) + 4 then a0 when n * ln(s1) + 2 <= n * ln(s2) + 4 then s1 else s2 end / 1e9, 3) as sigma2,
  round(case when n * ln(a0) <= n * ln(s1) + 2 and n * ln(a0) <= n * ln(s2) + 4 then null when n * ln(s1) + 2 <= n * ln(s2) + 4 then r1 else r1 - r2 * r1 end, 6) as phi_1,
  round(case when n * ln(a0) <= n * ln(s1) + 2 and n * ln(a0) <= n * ln(s2) + 4 then null when n * ln(s1) + 2 <= n * ln(s2) + 4 then null else r2 end, 6) as phi_2 from k3""")
def ar_fit(spark, sf):
    got = series.ar_fit(_series(spark, sf), ["variable"], "run_date", "value", 2)
    phi = [F.round(F.get("phi", F.lit(k)), 6).alias(f"phi_{k + 1}") for k in range(2)]
    return got.select("variable", "p", F.round(F.col("sigma2") / 1e9, 3).alias("sigma2"), *phi)


_BLOCK = """, de as (select variable, run_date, value - avg(value) over (partition by variable) as d from po),
ac as (select variable, lag, sum(x) as s from (select variable, k.lag, d * lag(d, k.lag) over (partition by variable, k.lag order by run_date) as x from de, (select unnest(range(41))::int as lag) k) group by all),
g0 as (select variable, count(*) as n from de group by variable),
g1 as (select variable, n, list(coalesce(s, 0) / n order by lag)[1:greatest(2, least(41, n - 1))] as g from ac join g0 using (variable) group by variable, n),
g2 as (select *, len(g) - 1 as lags, greatest(5, ceil(sqrt(log10(n))))::int as run, list_transform(g[2:], lambda x: abs(x / g[1]) >= 2 * sqrt(log10(n) / n)) as loud from g1),
g3 as (select *, coalesce(list_filter(range(0, lags - run + 1), lambda k: not list_bool_or(loud[k + 1:k + run]))[1], list_max(list_filter(range(1, lags + 1), lambda k: loud[k])), 0) as m from g2),
g4 as (select *, least(2 * greatest(m, 1), lags) as width from g3),
g5 as (select *, 2 * list_sum(list_transform(range(1, width + 1), lambda k: case when 2 * k <= width then 1.0::double else 2 * (1 - k / width::double) end * k * g[k + 1])) as spread,
  g[1] + 2 * list_sum(list_transform(range(1, width + 1), lambda k: case when 2 * k <= width then 1.0::double else 2 * (1 - k / width::double) end * g[k + 1])) as level from g4)"""


@query("with " + _SERIES + _BLOCK + " select variable, round(case when n <= 3 or g[1] <= 0 or level = 0 then 1.0 else least(pow(2 * spread * spread / (4.0::double / 3 * level * level) * n, 1.0::double / 3), ceil(least(3 * sqrt(n), n / 3.0))) end, 4) as b from g5")
def optimal_block(spark, sf):
    return series.optimal_block(_series(spark, sf), ["variable"], "run_date", "value").withColumn("b", F.round("b", 4))


_EST = fx.PAIRS + ", es as (select station, greatest(1.0, abs(avg(error_f)) / 1e6) as b_pooled, count(*) / 500.0 as b_station from pairs where scorable group by station)"


@query("with " + _EST + ", m as (select greatest(1, ceil(max(greatest(b_pooled, b_station))))::bigint as raw_ceiling from es) select raw_ceiling, case when raw_ceiling <= 14 then raw_ceiling end as block_days, raw_ceiling > 14 as capped from m")
def block_days(spark, sf):
    p = fx.pairs(spark, sf).where("scorable").groupBy("station").agg(F.greatest(F.lit(1.0), F.abs(F.avg("error_f")) / 1e6).alias("b_pooled"), (F.count("*") / 500.0).alias("b_station"))
    return series.choose_block_days(p).withColumns({c: F.col(c).cast("long") for c in ("raw_ceiling", "block_days")})


_COV = fx.PAIRS + ", cv as (select station as shape, cast(1 + lead_day * 7 as int) as n_blocks, variable, avg(case when abs(error_f) < 15000000 then 1.0 else 0.9 end) as coverage from pairs where scorable group by all)"


def _coverage(spark, sf):
    """Means of tenths, summed as whole numbers: one that meets a limit exactly may not hang on the order of rows."""
    p = fx.pairs(spark, sf).where("scorable")
    tenths = F.sum(F.when(F.abs("error_f") < 15000000, 10).otherwise(9))
    return p.groupBy(F.col("station").alias("shape"), (1 + F.col("lead_day") * 7).cast("int").alias("n_blocks"), "variable").agg((tenths / (10 * F.count("*"))).alias("coverage"))


@query("with " + _COV + ", l as (select n_blocks, min(coverage) as low from cv group by 1), a as (select n_blocks, min(low) over (order by n_blocks rows between current row and unbounded following) as least from l) select min(n_blocks) as n_blocks from a where least >= 0.9 having min(n_blocks) is not null")
def sample_floor(spark, sf):
    return series.choose_min_blocks(_coverage(spark, sf), 0.9)


@query("with " + _COV + ", s as (select shape, n_blocks, min(coverage) >= 0.956 as passes from cv group by all) select shape, n_blocks from s where not passes and n_blocks > (select min(n_blocks) from s where passes)")
def rerun_shapes(spark, sf):
    return series.needs_rerun(_coverage(spark, sf), 0.956)


@query("with " + fx.PAIRS + f", g as (select station, variable, count(distinct run_date) as n_dates from pairs where run_date between date '{LO}' and date '{HI}' group by all having count(distinct run_date) >= 20), w as (select date '{HI}' - date '{LO}' + 1 as n) select station, variable, n_dates, n - n_dates as n_missing, round((n - n_dates) / n::double, 6) as missing_fraction, (n - n_dates) / n::double > 0.1 as missing_flagged, round(1.96 / sqrt(n_dates), 6) as band from g, w")
def series_gaps(spark, sf):
    got = series.series_gaps(fx.pairs(spark, sf), ["station", "variable"], LO, HI, least=20)
    return got.withColumns({"missing_fraction": F.round("missing_fraction", 6), "band": F.round("band", 6)})


# --- texts ---------------------------------------------------------------------------------------

_REMARK = """rm as (select event_id, concat('KABC ', cast(user_id as varchar), ' ', case when event_id % 7 = 0 then '' else 'RMK ' end, '1', cast(user_id % 2 as varchar), lpad(cast(event_id % 500 as varchar), 3, '0'),
  case when event_id % 5 = 0 then concat(' 1', cast(user_id % 2 as varchar), lpad(cast(event_id % 500 as varchar), 3, '0')) when event_id % 5 = 1 then ' 10001' else '' end, ' 2', cast(event_id % 3 as varchar), '123 A02') as metar from events)"""


@query("with " + _REMARK + """, w as (select event_id, string_split(metar, ' ') as w from rm), p as (select event_id, case when list_position(w, 'RMK') > 0 then w[list_position(w, 'RMK') + 1:] else [] end as r from w),
g as (select event_id, list_distinct(list_filter(r, lambda x: regexp_full_match(x, '1[01][0-9]{3}'))) as a, list_distinct(list_filter(r, lambda x: regexp_full_match(x, '2[01][0-9]{3}'))) as b from p)
select event_id, round(case when len(a) = 1 then case when substr(a[1], 2, 1) = '1' then -1.0 else 1.0 end * cast(substr(a[1], 3) as double) / 10.0 * 9.0 / 5.0 + 32.0 end, 6) as max_6h_f,
  round(case when len(b) = 1 then case when substr(b[1], 2, 1) = '1' then -1.0 else 1.0 end * cast(substr(b[1], 3) as double) / 10.0 * 9.0 / 5.0 + 32.0 end, 6) as min_6h_f, len(a) > 1 as max_ambiguous, len(b) > 1 as min_ambiguous from g""")
def remark_groups(spark, sf):
    e = fx.table(spark, sf, "events")
    i, u = F.col("event_id"), F.col("user_id")
    three = F.lpad((i % 500).cast("string"), 3, "0")
    group = F.concat(F.lit("1"), (u % 2).cast("string"), three)
    again = F.when(i % 5 == 0, F.concat(F.lit(" "), group)).when(i % 5 == 1, " 10001").otherwise("")
    metar = F.concat(F.lit("KABC "), u.cast("string"), F.lit(" "), F.when(i % 7 == 0, "").otherwise("RMK "), group, again, F.lit(" 2"), (i % 3).cast("string"), F.lit("123 A02"))
    got = e.select("event_id", metar.alias("metar")).select("event_id", *[c.alias(k) for k, c in text.remark_groups("metar").items()])
    return got.withColumns({c: F.round(c, 6) for c in ("max_6h_f", "min_6h_f")})


@query("with p as (select p_partkey, string_split(p_name, ' ') as w from part) select p_partkey, concat(array_to_string(list_transform(w, lambda x: concat(upper(substr(x, 1, 1)), lower(substr(x, 2)))), ' '), case when p_partkey % 2 = 0 then ' NV, NV' else '' end) as label from p")
def label_titlecase(spark, sf):
    p = fx.table(spark, sf, "part")
    raw = F.concat(F.upper("p_name"), F.when(F.col("p_partkey") % 2 == 0, " NV, NV").otherwise(""))
    return p.select("p_partkey", text.label_case(raw).alias("label"))


@query("select p_partkey, p_name from part where contains(lower(p_name), 'ring') or contains(lower(cast(p_partkey as varchar)), 'ring') order by p_partkey limit 8")
def search_stations(spark, sf):
    p = fx.table(spark, sf, "part").withColumn("id", F.col("p_partkey").cast("string"))
    return text.search_stations(p, " RING ", key="p_partkey", label="p_name").select("p_partkey", "p_name")


# --- headline figures ---------------------------------------------------------------------------------


@query("with " + fx.PAIRS + " select variable, count(*) as n, round(avg(error_f), 4) as mean_error, round(avg(abs(error_f)), 4) as mae, count(*) filter (abs(error_f) > 10000000) as n_large from pairs where scorable and lead_day = 1 group by variable")
def headline_stats(spark, sf):
    fx.pairs(spark, sf).createOrReplaceTempView("headline_pairs")
    return spark.sql("select variable, count(*) as n, round(avg(error_f), 4) as mean_error, round(avg(abs(error_f)), 4) as mae, count(*) filter (where abs(error_f) > 10000000) as n_large from headline_pairs where scorable and lead_day = 1 group by variable")


@query("select strftime(o_orderdate, '%Y-%m') as month, o_orderstatus, count(*) as n from orders group by 1, 2")
def counts_by_month(spark, sf):
    return fx.table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus").agg(F.count("*").alias("n"))


@query("with " + fx.PAIRS + " select strftime(run_date, '%Y-%m') as month, round(avg(case when not scorable then 1.0 else 0.0 end), 6) as share, count(*) as n from pairs group by rollup(1)")
def fallback_share(spark, sf):
    p = fx.pairs(spark, sf)
    got = p.rollup(F.date_format("run_date", "yyyy-MM").alias("month")).agg(F.avg(F.when(~F.col("scorable"), 1.0).otherwise(0.0)).alias("share"), F.count("*").alias("n"))
    return got.withColumn("share", F.round("share", 6))


@query("with " + fx.FACT + " select source, count(*) as n, count(distinct (station, run_date, lead_day, variable)) as n_keys from fact0 group by source")
def key_parity(spark, sf):
    return quality.key_parity(fx.fact(spark, sf), ["station", "run_date", "lead_day", "variable"])


@query("with " + fx.EVENTS + " select event_id, sum(reading) over (partition by entity order by valid, event_id)::bigint as total from ev")
def running_total(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("entity").orderBy("valid", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return fx.events(spark, sf).select("event_id", F.sum("reading").over(w).alias("total"))


@query("with " + fx.EVENTS + " select event_type, sum(reading)::bigint as total, count(*) as n from ev group by event_type")
def group_total(spark, sf):
    return fx.events(spark, sf).groupBy("event_type").agg(F.sum("reading").alias("total"), F.count("*").alias("n"))


@query("with " + fx.FACT + ", c as (select station, season, count(*) as n from fact group by all) select round(median(n), -1)::double as median_size from c")
def median_cell(spark, sf):
    cells = score.prepare(fx.fact(spark, sf)).groupBy("station", "season").agg(F.count("*").alias("n"))
    return cells.agg(F.round(F.median("n"), -1).alias("median_size"))


# --- distance --------------------------------------------------------------------------------------------

_HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians({y2}) - radians({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin((radians({x2}) - radians({x1})) / 2), 2))))"
_BEAR = "atan2(sin(radians({x2}) - radians({x1})) * cos(radians({y2})), cos(radians({y1})) * sin(radians({y2})) - sin(radians({y1})) * cos(radians({y2})) * cos(radians({x2}) - radians({x1})))"
_D1 = _HAV.format(y1="lat1", x1="lon1", y2="lat", x2="lon")


@query(f"""with pt as (select c_custkey as station, (c_custkey * 7919 % 5000) / 100.0 + 10 as lat, (c_custkey * 104729 % 9000) / 100.0 - 120 as lon from customer),
sg as (select (s_suppkey * 6007 % 5000) / 100.0 + 10 as lat1, (s_suppkey * 7001 % 9000) / 100.0 - 120 as lon1, (s_suppkey * 6007 % 5000) / 100.0 + 10 + (s_suppkey % 7 - 3) / 2.0 as lat2, (s_suppkey * 7001 % 9000) / 100.0 - 120 + (s_suppkey % 5 - 2) / 2.0 as lon2 from supplier),
x as (select station, {_D1} as d1, {_HAV.format(y1="lat2", x1="lon2", y2="lat", x2="lon")} as d2, {_HAV.format(y1="lat1", x1="lon1", y2="lat2", x2="lon2")} / 6371.0 as len,
  {_BEAR.format(y1="lat1", x1="lon1", y2="lat", x2="lon")} - {_BEAR.format(y1="lat1", x1="lon1", y2="lat2", x2="lon2")} as turn from pt, sg),
y as (select station, d1, d2, len, asin(greatest(-1.0, least(1.0, sin(d1 / 6371.0) * sin(turn)))) as across, atan2(sin(d1 / 6371.0) * cos(turn), cos(d1 / 6371.0)) as along from x),
m as (select station, min(case when along >= 0 and along <= len and len > 0 then abs(across) * 6371.0 else least(d1, d2) end) as km from y group by station)
select station, round(case when km <= 25 then km end, 4) as km, km <= 25 as near from m""")
def nearest_segment(spark, sf):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    points = fx.table(spark, sf, "customer").select(k.alias("station"), (k * 7919 % 5000 / 100.0 + 10).alias("lat"), (k * 104729 % 9000 / 100.0 - 120).alias("lon"))
    lat, lon = s * 6007 % 5000 / 100.0 + 10, s * 7001 % 9000 / 100.0 - 120
    lines = fx.table(spark, sf, "supplier").select(lat.alias("lat1"), lon.alias("lon1"), (lat + (s % 7 - 3) / 2.0).alias("lat2"), (lon + (s % 5 - 2) / 2.0).alias("lon2"))
    got = geo.nearest_segment(points, lines)
    return got.select("station", F.round("km", 4).alias("km"), "near")
