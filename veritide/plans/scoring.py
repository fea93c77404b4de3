"""Queries on scores, tags, as-of features and corrections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritide.functions import calendar
from veritide.functions.text import SEASON_WORDS, VARIABLE_WORDS
from veritide.operators import asof, fact, models, report, score
from veritide.plans import fixtures as fx
from veritide.registry import query
from veritide.staging import stage

G = ["station", "lead_day", "variable"]


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


SCORE_COLS = """count(*) as n, count(distinct run_date) as n_dates, count(distinct block_id) as n_blocks,
  round(avg(error_f), 6) as bias, round(avg(abs(error_f)), 6) as mae,
  round(case when source = '{ref}' then 0.0 else 1.0 - sum(case when ref is not null and source <> '{ref}' then abs(error_f) end)
    / nullif(sum(case when ref is not null and source <> '{ref}' then abs(ref) end), 0) end, 6) as skill"""


@query("with " + fx.FACT + f" select variable, lead_day, season, source, {SCORE_COLS.format(ref='raw_nbm')} from withref group by variable, lead_day, season, source")
def score_slices(spark, sf):
    return r6(score.slice_scores(score.prepare(fx.fact(spark, sf)), ["variable", "lead_day", "season"]), "bias", "mae", "skill")


_REF = fx.FACT.replace("where source = 'raw_nbm') r", "where source = 'baseline') r")


@query("with " + _REF + f" select station, source, {SCORE_COLS.format(ref='baseline')} from withref group by station, source")
def skill_vs_reference(spark, sf):
    return r6(score.slice_scores(score.prepare(fx.fact(spark, sf)), ["station"], "baseline"), "bias", "mae", "skill")


_SET_COLS = SCORE_COLS.format(ref="raw_nbm").replace("count(distinct run_date) as n_dates, count(distinct block_id) as n_blocks,", "")


@query("with " + fx.FACT + f" select variable, lead_day, season, source, grouping(variable, lead_day, season, source)::bigint as grouping, {_SET_COLS} from withref group by grouping sets ((variable, lead_day, season, source), (variable, source), (source))")
def score_grouping_sets(spark, sf):
    return r6(score.score_sets(score.prepare(fx.fact(spark, sf)), [["variable", "lead_day", "season"], ["variable"], []]), "bias", "mae", "skill")


@query("with " + fx.FACT + f", s as (select *, case when run_date >= date '1998-07-01' then 'after' else 'before' end as split, year(run_date)::int as year from withref) select split, year, source, grouping(split, year, source)::bigint as grouping, {_SET_COLS} from s group by grouping sets ((split, source), (year, source))")
def score_splits(spark, sf):
    return r6(score.score_splits(fx.fact(spark, sf), "1998-07-01"), "bias", "mae", "skill")


_SUMS = "count(*) as n, sum(error_f)::double as error_sum, sum(abs(error_f))::double as abs_sum, coalesce(sum(case when ref is not null and source <> 'raw_nbm' then abs(error_f) end), 0)::double as own_abs, coalesce(sum(case when ref is not null and source <> 'raw_nbm' then abs(ref) end), 0)::double as ref_abs"
_INTERVALS = f""", bs as (select variable, lead_day, source, block_id, {_SUMS} from withref group by all), {score.bootstrap_sql('bs', ['variable', 'lead_day', 'source'], score.SUMS)},
sc as (select variable, lead_day, source, {SCORE_COLS.format(ref='raw_nbm')} from withref group by variable, lead_day, source),
ci as (select variable, lead_day, source, quantile_cont(error_sum / n, 0.025) as bias_lo, quantile_cont(error_sum / n, 0.975) as bias_hi, quantile_cont(abs_sum / n, 0.025) as mae_lo, quantile_cont(abs_sum / n, 0.975) as mae_hi,
  quantile_cont(1 - own_abs / ref_abs, 0.025) filter (ref_abs <> 0) as skill_lo, quantile_cont(1 - own_abs / ref_abs, 0.975) filter (ref_abs <> 0) as skill_hi from ra group by all)
select variable, lead_day, source, n, n_dates, n_blocks, bias, round(bias_lo, 6) as bias_lo, round(bias_hi, 6) as bias_hi, mae, round(mae_lo, 6) as mae_lo, round(mae_hi, 6) as mae_hi, skill,
  round(case when source = 'raw_nbm' then 0 else skill_lo end, 6) as skill_lo, round(case when source = 'raw_nbm' then 0 else skill_hi end, 6) as skill_hi,
  n_blocks < 21 as min_sample_flag, coalesce(bias_lo <= 0 and bias_hi >= 0, true) as no_detectable_bias from sc left join ci using (variable, lead_day, source)"""


@query("with " + fx.FACT + _INTERVALS)
def score_intervals(spark, sf):
    got = score.score(fx.fact(spark, sf), ["variable", "lead_day"])
    return r6(got, *[f"{k}{e}" for k in ("bias", "mae", "skill") for e in ("", "_lo", "_hi")])


@query("with " + fx.FACT + " select station, source, block_id, count(*) as n, sum(error_f)::bigint as error_sum, sum(abs(error_f))::bigint as abs_sum, sum(case when ref is not null and source <> 'raw_nbm' then abs(error_f) end)::bigint as own_abs, sum(case when ref is not null and source <> 'raw_nbm' then abs(ref) end)::bigint as ref_abs from withref group by station, source, block_id")
def block_sums(spark, sf):
    return score.block_sums(score.prepare(fx.fact(spark, sf)), ["station"]).drop("n_dates")


_BOOT = ", bs as (select variable, source, block_id, count(*) as n, sum(error_f)::double as error_sum from fact group by all), " + score.bootstrap_sql("bs", ["variable", "source"], ["error_sum", "n"])
_SPAN = ", ci as (select variable, source, quantile_cont(error_sum / n, 0.025) as lo, quantile_cont(error_sum / n, 0.975) as hi from ra group by all)"


def _boot(spark, sf):
    sums = score.block_sums(score.prepare(fx.fact(spark, sf)), ["variable"])
    return score.bootstrap(sums, ["variable", "source"], "error_sum", "n")


@query("with " + fx.FACT + _BOOT + _SPAN + " select variable, source, m as n_blocks, round(lo, 6) as lo, round(hi, 6) as hi from ci join sz using (variable, source)")
def bootstrap_md5(spark, sf):
    """Intervals of the mean error from 2,000 resamples, of draws that start from an MD5 of the slice."""
    return r6(_boot(spark, sf), "lo", "hi")


_ROWS = ", bs as (select variable, source, row_number() over (partition by variable, source order by station, run_date, lead_day) as block_id, 1 as n, error_f as error_sum from fact), " + score.bootstrap_sql("bs", ["variable", "source"], ["error_sum", "n"], 200)


@query("with " + fx.FACT + _ROWS + _SPAN + " select variable, source, round(lo, 6) as lo, round(hi, 6) as hi from ci")
def row_bootstrap(spark, sf):
    """Rows drawn one by one, to compare with draws of blocks."""
    rows = score.as_blocks(score.prepare(fx.fact(spark, sf)), ["variable", "source"], ["station", "run_date", "lead_day"])
    return r6(score.bootstrap(rows, ["variable", "source"], "error_sum", "n", 200).drop("n_blocks"), "lo", "hi")


@query("with " + fx.FACT + _BOOT + _SPAN + """ select variable, source, m as n_blocks, m < 21 as min_sample_flag, lo <= 0 and hi >= 0 as no_detectable_bias,
  case when m < 21 then 'too few days' when lo > 0 then 'positive' when hi < 0 then 'negative' else 'indistinguishable' end as verdict from ci join sz using (variable, source)""")
def flags(spark, sf):
    out = _boot(spark, sf)
    return out.select("variable", "source", "n_blocks", (F.col("n_blocks") < 21).alias("min_sample_flag"), ((F.col("lo") <= 0) & (F.col("hi") >= 0)).alias("no_detectable_bias"), score.verdict("lo", "hi", "n_blocks").alias("verdict"))


# --- tags and the fact table -------------------------------------------------


@query("with " + fx.PAIRS + ", " + fx.DIMS + " select p.station, p.run_date, p.lead_day, p.variable, v.version from pairs p left join versions v on p.runtime >= v.valid_from and (v.valid_to is null or p.runtime < v.valid_to)", ("run_date",))
def tag_versions_halfopen(spark, sf):
    return fact.tag_range(fx.pairs(spark, sf), fx.versions(spark), "runtime", "version").select(*fact.KEY, "version")


@query("with " + fx.PAIRS + ", " + fx.DIMS + " select p.station, p.run_date, p.lead_day, p.variable, r.regime from pairs p left join regimes r on p.run_date >= r.valid_from and (r.valid_to is null or p.run_date <= r.valid_to)", ("run_date",))
def tag_regimes_closed(spark, sf):
    return fact.tag_range(fx.pairs(spark, sf), fx.regimes(spark), "run_date", "regime", closed=True).select(*fact.KEY, "regime")


@query("with " + fx.PAIRS + ", " + fx.DIMS + " select p.station, p.run_date, p.lead_day, p.variable from pairs p join regimes r on p.run_date >= r.valid_from and (r.valid_to is null or p.run_date <= r.valid_to) where r.cycle_hour <> 13", ("run_date",))
def regime_mismatches(spark, sf):
    p = fx.pairs(spark, sf).withColumn("cycle_hour", F.hour("runtime"))
    return fact.regime_mismatches(p, fx.regimes(spark).select("cycle_hour", "valid_from", "valid_to")).select(fact.KEY)


def _predictions(spark, sf):
    p = fx.pairs(spark, sf)
    some = p.where("lead_day <= 2").select(*fact.KEY, F.lit("baseline").alias("source"), (F.col("forecast_f") - 10).alias("forecast_f"))
    moved = p.where("lead_day = 3").select("station", F.date_add("run_date", 4000).alias("run_date"), "lead_day", "variable", F.lit("baseline").alias("source"), "forecast_f")
    return p, some.unionByName(moved)


_PRED = ", pred as (select station, run_date, lead_day, variable, 'baseline' as source, forecast_f - 10 as forecast_f from pairs where lead_day <= 2 union all select station, run_date + 4000, lead_day, variable, 'baseline', forecast_f from pairs where lead_day = 3)"


@query("with " + fx.PAIRS + _PRED + " select station, run_date, lead_day, variable, source, round(forecast_f, 6) as forecast_f, round(case when scorable then forecast_f - observed_f end, 6) as error from (select station, run_date, lead_day, variable, forecast_f, observed_f, scorable, 'raw_nbm' as source from pairs union all select p.station, p.run_date, p.lead_day, p.variable, d.forecast_f, p.observed_f, p.scorable, d.source from pairs p join pred d on p.station = d.station and p.run_date = d.run_date and p.lead_day = d.lead_day and p.variable = d.variable)", ("run_date",))
def fact_union(spark, sf):
    p, pred = _predictions(spark, sf)
    p = p.withColumn("error_f", F.when(F.col("scorable"), F.col("forecast_f") - F.col("observed_f")))
    return fact.build_fact(p, pred).select(*fact.KEY, "source", F.round("forecast_f", 6).alias("forecast_f"), F.round("error_f", 6).alias("error"))


@query("with " + fx.PAIRS + _PRED + " select station, run_date, lead_day, variable, source, forecast_f from pred d where not exists (select 1 from pairs p where p.station = d.station and p.run_date = d.run_date and p.lead_day = d.lead_day and p.variable = d.variable)", ("run_date",))
def orphans(spark, sf):
    p, pred = _predictions(spark, sf)
    return fact.orphans(pred, p)


_SPLIT = {"v": "case when {d} < date '1996-03-05' then 'v1' when {d} < date '1998-01-01' then 'v2' else 'v3' end"}


@query("with " + fx.PAIRS + f", a as (select {_SPLIT['v'].format(d='run_date')} as label, run_date from pairs), v as (select label, min(run_date) as f from a group by label), t as (select *, lead(f) over (order by f) as e from v) select f as boundary_date, 'version' as kind, label, e as ends from t union all select f, 'regime', label, e from t where label <> 'v2'", ("boundary_date", "ends"))
def boundaries(spark, sf):
    from pyspark.sql import Window as W

    a = fx.pairs(spark, sf).select(F.expr(_SPLIT["v"].format(d="run_date")).alias("version"), "run_date").groupBy("version").agg(F.min("run_date").alias("valid_from"))
    a = a.withColumn("valid_to", F.lead("valid_from").over(W.orderBy("valid_from")))
    return fact.boundaries(a, a.where("version <> 'v2'").withColumnRenamed("version", "regime"))


# --- as-of features -----------------------------------------------------------

_CLOSED = fx.PAIRS + ", closed as (select * from pairs where scorable)"
_STATS = """, st as (select *, error_f as lag_error,
  avg(error_f) over (partition by station, lead_day, variable order by window_end, runtime rows 2 preceding) as mean_3,
  avg(error_f) over (partition by station, lead_day, variable order by window_end, runtime rows 6 preceding) as mean_7,
  row_number() over (partition by station, lead_day, variable order by window_end, runtime)
    - count(*) over (partition by station, lead_day, variable order by window_end range between unbounded preceding and interval 30 days preceding) as n30
  from closed)"""


def _stats(spark, sf):
    p = fx.pairs(spark, sf)
    return p, asof.pair_stats(p.where("scorable"), G)


@query("with " + _CLOSED + _STATS + " select station, run_date, lead_day, variable, lag_error, round(mean_3, 6) as mean_3, round(mean_7, 6) as mean_7, n30::bigint as n30 from st", ("run_date",))
def lag_means(spark, sf):
    return r6(_stats(spark, sf)[1].select(*fact.KEY, "lag_error", "mean_3", "mean_7", F.col("n30").cast("long").alias("n30")), "mean_3", "mean_7")


@query("with " + _CLOSED + _STATS + """ select q.station, q.run_date, q.lead_day, q.variable, s.lag_error, round(s.mean_3, 6) as mean_3, round(s.mean_7, 6) as mean_7, s.n30::bigint as n30,
  s.window_end as closed_at, round(epoch_us(q.runtime - s.window_end) / 86400000000.0, 6) as age_days
  from pairs q asof left join st s on q.station = s.station and q.lead_day = s.lead_day and q.variable = s.variable and q.runtime > s.window_end""", ("run_date",))
def asof_strict(spark, sf):
    p, st = _stats(spark, sf)
    got = asof.lag_features(p.select(*fact.KEY, "runtime"), st, G)
    return r6(got.select(*fact.KEY, "lag_error", "mean_3", "mean_7", F.col("n30").cast("long").alias("n30"), "closed_at", "age_days"), "mean_3", "mean_7", "age_days")


@query("with " + _CLOSED + ", t as (select *, row_number() over (partition by station, lead_day, variable order by window_end desc, runtime desc) as rn, max(window_end) over (partition by station, lead_day, variable) as newest from closed) select station, run_date, lead_day, variable, error_f from t where rn <= 7 or window_end >= newest - interval 40 days", ("run_date",))
def history_trim(spark, sf):
    return asof.trim_history(fx.pairs(spark, sf).where("scorable"), G).select(*fact.KEY, "error_f")


@query("with " + _CLOSED + " select c.station, c.run_date, c.lead_day, c.variable, min(r.runtime) as seen_by from closed c left join (select distinct runtime from pairs) r on r.runtime > c.window_end group by all", ("run_date",))
def delta_slices(spark, sf):
    p = fx.pairs(spark, sf)
    return asof.deltas(p.where("scorable").select(*fact.KEY, "window_end"), p.select("runtime")).select(*fact.KEY, "seen_by")


# --- corrections ----------------------------------------------------------------

_ROLL = """, runs as (select distinct run_date, runtime from pairs),
an as (select r.runtime, max(c.window_end) as anchor from runs r join (select distinct window_end from closed) c on c.window_end < r.runtime group by r.runtime)"""


@query("with " + _CLOSED + _ROLL + """, rb as (select a.runtime, c.station, c.lead_day, c.variable, sum(c.error_f) as s, count(c.error_f) as m, count(*) as k
  from an a join closed c on c.window_end <= a.anchor and c.window_end > a.anchor - interval 30 days group by all)
  select p.station, p.run_date, p.lead_day, p.variable, round(s / nullif(m, 0)::double, 6) as bias, coalesce(k, 0)::bigint as n_pairs
  from pairs p left join rb on p.runtime = rb.runtime and p.station = rb.station and p.lead_day = rb.lead_day and p.variable = rb.variable""", ("run_date",))
def rolling_bias(spark, sf):
    p = fx.pairs(spark, sf)
    rows = p.select(*fact.KEY, F.col("runtime").alias("known_until"))
    return r6(models.rolling_bias(p.where("scorable"), rows).select(*fact.KEY, "bias", "n_pairs"), "bias")


@query("with " + fx.PAIRS + ", d as (select distinct run_date, runtime from pairs) select run_date, min(run_date) over (partition by date_trunc('month', run_date)) as retrained_on, min(runtime) over (partition by date_trunc('month', run_date)) as cutoff from d", ("run_date", "retrained_on"))
def retrain_dates(spark, sf):
    return models.retrain_dates(fx.pairs(spark, sf)).select("run_date", "retrained_on", "cutoff")


def _all_runs(spark, sf):
    """First and last run date, as text."""
    days = fx.table(spark, sf, "orders").agg(F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date")).first()
    return str(days[0]), str(days[1])


def _cents(spark, sf):
    return fx.pairs(spark, sf).withColumn("forecast_f", F.round(F.col("forecast_f") * 100).cast("long"))


@query("with " + _CLOSED + """, ev as (select * from pairs),
ru as (select run_date, runtime, min(run_date) over (partition by date_trunc('month', run_date)) as retrained_on, min(runtime) over (partition by date_trunc('month', run_date)) as cut
  from (select distinct run_date, runtime from ev)),
an as (select cut, max(window_end) as anchor from (select distinct cut from ru) r join (select distinct window_end from closed) c on c.window_end < r.cut group by cut),
rb as (select a.cut, c.station, c.lead_day, c.variable, sum(c.error_f) as s, count(c.error_f) as m, count(*) as k
  from an a join closed c on c.window_end <= a.anchor and c.window_end > a.anchor - interval 60 days group by all)
select e.station, e.run_date, e.lead_day, e.variable, ru.retrained_on, an.anchor as trained_through,
  round(case when k >= 2 and m > 0 then round(forecast_f * 100) - s / m::double else round(forecast_f * 100) end, 6) as forecast, not coalesce(k >= 2 and m > 0, false) as fallback
from ev e join ru on e.run_date = ru.run_date left join an on ru.cut = an.cut
left join rb on rb.cut = ru.cut and rb.station = e.station and rb.lead_day = e.lead_day and rb.variable = e.variable""", ("run_date", "retrained_on"))
def walk_forward_baseline(spark, sf):
    got = models.walk_forward(_cents(spark, sf), models.RollingBias(60, 2), *_all_runs(spark, sf))
    return r6(got.select(*fact.KEY, "retrained_on", "trained_through", "forecast", "fallback"), "forecast")


_REAL = fx.PAIRS + """, closed as (select *, case when day(run_date) = 13 then 'nan'::double when day(run_date) = 17 then null else error_f / 8.0 end as e from pairs where scorable)"""


@query("with " + _REAL + _ROLL + """, rb as (select a.runtime, c.station, c.lead_day, c.variable, sum(case when isfinite(e) then e end) as s, count(case when isfinite(e) then 1 end) as m, count(*) as k
  from an a join closed c on c.window_end <= a.anchor and c.window_end > a.anchor - interval 30 days group by all)
  select p.station, p.run_date, p.lead_day, p.variable, round(s / nullif(m, 0)::double, 6) as bias, coalesce(k, 0)::bigint as n_pairs
  from pairs p left join rb on p.runtime = rb.runtime and p.station = rb.station and p.lead_day = rb.lead_day and p.variable = rb.variable""", ("run_date",))
def rolling_bias_real(spark, sf):
    """Errors with fractions, some null, some not a number."""
    p = fx.pairs(spark, sf)
    day = F.dayofmonth("run_date")
    closed = p.where("scorable").withColumn("error_f", F.when(day == 13, float("nan")).when(day != 17, F.col("error_f") / 8.0))
    rows = p.select(*fact.KEY, F.col("runtime").alias("known_until"))
    return r6(models.rolling_bias(closed, rows).select(*fact.KEY, "bias", "n_pairs"), "bias")


@query(None)
def gbt_challenger(spark, sf):
    """All months, on all features; stations are customers' hundreds with a place made of their number.

    Fits from 12,000 pairs on instead of 20,000, so that the last months of small tables have fits too.
    """
    p = stage(_cents(spark, sf).withColumns({"spread_f": F.pmod("forecast_f", F.lit(700)), "tmp_f": F.col("forecast_f") / 2, "cycle_hour": F.hour("runtime")}))  # read some ten times
    n = F.substring("station", 2, 7).cast("int")
    dim = fx.stations(spark, sf).select("station", (25 + n % 24).alias("lat"), (-70.0 - n % 50).alias("lon"), (n % 9 * 300).alias("elevation_m"), (n % 3 == 0).alias("is_coastal"), F.concat(F.lit("r"), n % 5).alias("climate_region"))
    model = models.GbtCorrector(min_rows=12_000, stations=dim, regions=[f"r{k}" for k in range(5)])
    got = models.walk_forward(p, model, *_all_runs(spark, sf))
    return got.select(*fact.KEY, "forecast", "retrained_on", "fallback")


# --- pairs from guidance and readings -------------------------------------------------

_RAW = fx.EVENTS + ", " + fx.REPORTS + ", " + fx.DIMS + """, g as (select o_custkey // 10 as entity, date '2024-01-01' + (o_orderkey % 28)::int as run_date, (1 + o_orderkey % 3)::int as lead_day,
  case when o_orderkey % 2 = 0 then 'max' else 'min' end as variable, max(round(o_totalprice * 100)::bigint) as forecast_f, min(round(o_totalprice * 100)::bigint) as tmp_f from orders group by all),
aim as (select *, run_date + lead_day as target_date, cast(run_date + lead_day as timestamp) + case when variable = 'max' then interval 12 hour else interval 0 hour end as window_start,
  cast(run_date + lead_day as timestamp) + case when variable = 'max' then interval 30 hour else interval 18 hour end as window_end, cast(run_date as timestamp) + interval 13 hour as runtime from g),
win as (select distinct entity, variable, window_start, window_end from aim)""" + """, hr as (select w.entity, w.variable, w.window_start, count(e.reading) as n_obs,
  case when count(distinct date_trunc('hour', e.valid)) >= 1 then case when w.variable = 'max' then max(e.reading) else min(e.reading) end end as hourly_f
  from win w left join ev e on w.entity = e.entity and e.valid >= w.window_start and e.valid < w.window_end group by w.entity, w.variable, w.window_start),
pe as (select *, window_start + to_hours(h) as period_end from win, (values (6), (12), (18)) p(h)),
pm as (select p.entity, p.variable, p.window_start, p.period_end, arg_max(case when p.variable = 'max' then max_6h_f else min_6h_f end, r.valid) as v
  from pe p join rep r on p.entity = r.entity and r.valid >= p.period_end - interval 60 minute and r.valid < p.period_end
  where case when p.variable = 'max' then max_6h_f else min_6h_f end is not null group by all),
ti as (select entity, variable, window_start, case when count(*) = 3 then case when variable = 'max' then max(v) else min(v) end end as tiled_f from pm group by entity, variable, window_start),
da as (select entity, cast(valid as date) as target_date, max(reading) as high_f, min(reading) as low_f from ev group by all),
raw as (select aim.entity as station, run_date, lead_day, aim.variable, forecast_f, tmp_f, coalesce(tiled_f, hourly_f) as observed_f, coalesce(tiled_f, hourly_f) is not null as scorable,
  case when tiled_f is not null then 'tiled' when hourly_f is not null then 'hourly' end as extreme_source, forecast_f - coalesce(tiled_f, hourly_f) as error_f,
  case when aim.variable = 'max' then high_f else low_f end as daily_f, v.version, r.regime
  from aim join hr using (entity, variable, window_start) left join ti using (entity, variable, window_start) left join da using (entity, target_date)
  left join versions v on aim.runtime >= v.valid_from and (v.valid_to is null or aim.runtime < v.valid_to)
  left join regimes r on aim.run_date >= r.valid_from and (r.valid_to is null or aim.run_date <= r.valid_to))"""


def _raw_pairs(spark, sf):
    k = F.col("o_orderkey")
    date = F.date_add(F.lit("2024-01-01").cast("date"), (k % 28).cast("int"))
    hours = (1 + k % 3) * 24 + F.when(k % 2 == 0, 24).otherwise(12)
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = fx.table(spark, sf, "orders").select(F.expr("o_custkey div 10").alias("station"), date.alias("day"), hours.cast("int").alias("hours"), cents.alias("cents"))
    g = rows.groupBy("station", "day", "hours").agg(F.max("cents").alias("txn"), F.min("cents").alias("tmp"))
    g = g.withColumns({"runtime": calendar.at_hour("day", 13), "ftime": F.to_timestamp_ntz(F.col("day").cast("string")) + F.make_dt_interval(F.lit(0), F.col("hours")), "xnd": F.lit(None).cast("long")})
    e = fx.events(spark, sf).select(F.col("entity").alias("station"), "valid", F.col("reading").alias("tmpf"))
    daily = e.groupBy("station", F.col("valid").cast("date").alias("local_date")).agg(F.max("tmpf").alias("high_f"), F.min("tmpf").alias("low_f"))
    return fact.pairs_from(g, e, fx.reports(spark, sf).withColumnRenamed("entity", "station"), daily, fx.versions(spark), fx.regimes(spark), coverage=1 / 18)


@query("with " + _RAW + " select station, run_date, lead_day, variable, forecast_f, tmp_f, observed_f, scorable, extreme_source, error_f, daily_f, version, regime from raw", ("run_date",))
def raw_pairs(spark, sf):
    """Orders as guidance, events as readings and reports: targets, windows, what was observed, tags."""
    return _raw_pairs(spark, sf).select(*fact.KEY, "forecast_f", "tmp_f", "observed_f", "scorable", "extreme_source", "error_f", "daily_f", "version", "regime")


_PLANTED = _RAW + """, f as (select station, run_date, lead_day, variable, 'raw_nbm' as source, forecast_f, observed_f, case when station % 17 = 0 then error_f + 1 else error_f end as error_f,
  case when station % 19 = 0 then not scorable else scorable end as scorable, case when station % 23 = 0 then null else extreme_source end as extreme_source, case when station % 29 = 0 then null else tmp_f end as tmp_f from raw),
pr as (select station, case when station % 31 = 0 then run_date + 400 else run_date end as run_date, lead_day, variable, 'baseline' as source, case when station % 37 = 0 then forecast_f + 5 else forecast_f end as raw_forecast_f from raw where lead_day < 3)"""


@query("with " + _PLANTED + """ select 'error is not forecast minus observed' as rule, station, run_date, lead_day, variable, source from f where scorable and (error_f is null or observed_f is null or abs(error_f - (forecast_f - observed_f)) > 0.0001)
  union all select 'scorable and missing values disagree', station, run_date, lead_day, variable, source from f where (scorable and (observed_f is null or error_f is null)) or (not scorable and error_f is not null)
  union all select 'scorable and source of the extreme disagree', station, run_date, lead_day, variable, source from f where scorable <> (extreme_source is not null)
  union all select 'prediction without a pair', station, run_date, lead_day, variable, source from pr where not exists (select 1 from raw r where r.station = pr.station and r.run_date = pr.run_date and r.lead_day = pr.lead_day and r.variable = pr.variable)
  union all select 'raw forecast of a prediction is not that of its pair', pr.station, pr.run_date, pr.lead_day, pr.variable, source from pr join raw r on r.station = pr.station and r.run_date = pr.run_date and r.lead_day = pr.lead_day and r.variable = pr.variable where raw_forecast_f is distinct from r.forecast_f
  union all select 'tmp_f is not that of the pair', f.station, f.run_date, f.lead_day, f.variable, source from f join raw r on r.station = f.station and r.run_date = f.run_date and r.lead_day = f.lead_day and r.variable = f.variable where f.tmp_f is distinct from r.tmp_f""", ("run_date",))
def fact_violations(spark, sf):
    """Rules of the fact table, over rows of which some are spoilt for each rule."""
    p = _raw_pairs(spark, sf)
    s = F.col("station")
    f = p.withColumns({
        "source": F.lit("raw_nbm"),
        "error_f": F.when(s % 17 == 0, F.col("error_f") + 1).otherwise(F.col("error_f")),
        "scorable": F.when(s % 19 == 0, ~F.col("scorable")).otherwise(F.col("scorable")),
        "extreme_source": F.when(s % 23 != 0, F.col("extreme_source")),
        "tmp_f": F.when(s % 29 != 0, F.col("tmp_f")),
    })
    moved = F.when(s % 31 == 0, F.date_add("run_date", 400)).otherwise(F.col("run_date"))
    made_of = F.when(s % 37 == 0, F.col("forecast_f") + 5).otherwise(F.col("forecast_f"))
    pred = p.where("lead_day < 3").select("station", moved.alias("run_date"), "lead_day", "variable", F.lit("baseline").alias("source"), made_of.alias("raw_forecast_f"))
    return fact.violations(f, p, pred).select("rule", *fact.KEY, "source")


# --- log and scorecard ------------------------------------------------------------


def _issued(spark, sf):
    p = fx.pairs(spark, sf)
    rows = p.select(*fact.KEY, "runtime", "target_date", F.lit("baseline").alias("source"), "window_end", F.floor(F.col("forecast_f") / 2).cast("double").alias("forecast_f"), F.floor("forecast_f").cast("double").alias("raw_forecast_f"))
    return p, rows.withColumn("issued_at", F.col("runtime") + F.expr("interval 2 hours"))


_ISSUED = fx.PAIRS + ", log as (select station, run_date, lead_day, variable, runtime, target_date, 'baseline' as source, window_end, floor(forecast_f / 2)::double as forecast_f, floor(forecast_f)::double as raw_forecast_f, runtime + interval 2 hours as issued_at from pairs)"


@query("with " + _ISSUED + """, l as (select run_date, concat_ws('|', station, cast(run_date as varchar), cast(lead_day as varchar), variable, source, cast(target_date as varchar), cast(epoch_us(runtime) as varchar),
  cast(epoch_us(window_end) as varchar), cast(epoch_us(issued_at) as varchar), cast(forecast_f as varchar), cast(raw_forecast_f as varchar)) as line from log),
  h as (select run_date, sha256(line) as line from l),
  b as (select run_date, substr(line, 1, 3) as block, count(*) as n, sha256(string_agg(line, chr(10) order by line)) as hash from h group by run_date, block)
  select run_date, sum(n)::bigint as n_rows, sha256(string_agg(block || ':' || hash, chr(10) order by block)) as hash from b group by run_date""", ("run_date",))
def log_hashes(spark, sf):
    from veritide.operators import log

    return log.partition_hashes(_issued(spark, sf)[1])


@query("with " + _ISSUED + """, d as (select distinct run_date from log) select run_date, case when k = 1 then 'hash' when k = 2 then 'row count' end as problem
  from (select run_date, dense_rank() over (order by run_date) as g from d), (values (1), (2)) v(k) where g = 3 and k = 1 or g = 5
  union all select run_date, 'unsealed rows' from (select run_date, dense_rank() over (order by run_date desc) as g from d) where g = 1""", ("run_date",))
def log_verify(spark, sf):
    from pyspark.sql import Window as W

    from veritide.operators import log

    rows = _issued(spark, sf)[1]
    seals = log.seal_rows(rows)
    last = rows.agg(F.max("run_date")).first()[0]
    seals = seals.where(F.col("run_date") < F.lit(last))  # the last date was never sealed
    order = F.dense_rank().over(W.orderBy("run_date"))
    days = rows.select("run_date").distinct().withColumn("g", order)
    bad = rows.join(days, "run_date")
    first = F.row_number().over(W.partitionBy("run_date").orderBy(*log.KEY))
    bad = bad.withColumn("k", first)
    bad = bad.withColumn("forecast_f", F.when((F.col("g") == 3) & (F.col("k") == 1), F.col("forecast_f") + 1).otherwise(F.col("forecast_f")))
    bad = bad.unionByName(bad.where("g = 5 and k = 1")).drop("g", "k")
    return log.verify_rows(bad, seals)


@query("with " + _ISSUED + " select station, run_date, lead_day, variable from log where window_end <= timestamp '2001-03-01 12:00:00'", ("run_date",))
def late_rows(spark, sf):
    from veritide.operators import log

    return log.late_rows(_issued(spark, sf)[1], "2001-03-01 12:00:00").select(fact.KEY)


@query("with " + _ISSUED + """, last as (select max(l.target_date) as t from log l join pairs p using (station, run_date, lead_day, variable) where p.scorable),
ins as (select l.* from log l, last where target_date <= t and target_date > t - 30),
u as (select station, run_date, lead_day, variable, source, forecast_f from ins union all select station, run_date, lead_day, variable, 'raw_nbm', raw_forecast_f from ins)
select station, run_date, lead_day, variable, source, coalesce(p.scorable, false) as scorable, round(case when p.scorable then u.forecast_f - p.observed_f end, 6) as error_f
from u left join pairs p using (station, run_date, lead_day, variable)""", ("run_date",))
def scorecard_window(spark, sf):
    p, log = _issued(spark, sf)
    return r6(report.scorecard_rows(log, p).select(*fact.KEY, "source", "scorable", "error_f"), "error_f")


# --- published documents ------------------------------------------------------------

_CITY = fx.FACT + f""", st as (select station, variable, lead_day, season, {SCORE_COLS.format(ref='raw_nbm')} from withref where source = 'raw_nbm' group by station, variable, lead_day, season, source),
ci as (select *, bias - 2000000.0 as bias_lo, bias + 2000000.0 as bias_hi, n_blocks < 10 as min_sample_flag, not (bias - 2000000.0 > 0 or bias + 2000000.0 < 0) as no_detectable_bias from st)"""


def _case(column: str, words: dict) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in words.items()) + " end"


def _city(spark, sf):
    rows = fx.fact(spark, sf).where("source = 'raw_nbm'")
    st = r6(score.slice_scores(score.prepare(rows), ["station", "variable", "lead_day", "season"]), "bias", "mae", "skill")
    st = st.withColumns({"bias_lo": F.col("bias") - 2000000.0, "bias_hi": F.col("bias") + 2000000.0, "min_sample_flag": F.col("n_blocks") < 10})
    return st.withColumn("no_detectable_bias", ~((F.col("bias_lo") > 0) | (F.col("bias_hi") < 0)))


@query("with " + _CITY + """, r as (select *, row_number() over (partition by station order by (not no_detectable_bias and not min_sample_flag) desc, abs(bias) desc, variable, case season when 'DJF' then 0 when 'MAM' then 1 when 'JJA' then 2 else 3 end) as k,
  bool_or(not min_sample_flag) over (partition by station) as enough from ci where lead_day = 1)
  select station, not no_detectable_bias and not min_sample_flag as significant, case when not no_detectable_bias and not min_sample_flag then
    concat(""" + _case("variable", VARIABLE_WORDS) + """, ' run ', printf('%.1f°F ', round(abs(bias), 1)), case when bias > 0 then 'warm' else 'cold' end, ' in ', """ + _case("season", SEASON_WORDS) + """, ' (day-ahead forecasts).')
    when enough then 'No detectable bias in day-ahead forecasts.' else 'Not enough data yet.' end as text,
  case when not no_detectable_bias and not min_sample_flag then variable end as variable, case when not no_detectable_bias and not min_sample_flag then season end as season,
  case when not no_detectable_bias and not min_sample_flag then case when bias > 0 then 'warm' else 'cold' end when enough then 'none' else 'few' end as side from r where k = 1""")
def city_summary(spark, sf):
    got = report.city_summary(_city(spark, sf))
    side = F.when(F.col("text").contains(" warm "), "warm").when(F.col("text").contains(" cold "), "cold").when(F.col("text").startswith("No detectable"), "none").otherwise("few")
    return got.select("station", "significant", "text", "variable", "season", side.alias("side"))


@query("with " + _CITY + " select station, variable, round(case when bool_or(not min_sample_flag) then sum(n * mae) / sum(n) end, 3) as mae from ci where lead_day = 1 group by station, variable")
def typical_miss(spark, sf):
    got = report.typical_miss(_city(spark, sf))
    return got.withColumn("mae", F.round("mae", 3))


@query("with " + _CITY + ", f(floor) as (values (5), (21)), l(leads) as (values ('all'), ('lead 1')) select leads, floor::int as floor, count(*) as slices, count(*) filter (n_blocks >= floor and not no_detectable_bias) as claims from ci, f, l where leads = 'all' or lead_day = 1 group by leads, floor")
def claims_under_floors(spark, sf):
    return report.claims_under_floors(_city(spark, sf), (5, 21))


@query("with " + _CITY + """, w as (select station, variable, lead_day, season, bias / 1e9 as bias, (bias - 2000000.0) / 1e9 as lo, (bias + 2000000.0) / 1e9 as hi, not no_detectable_bias as k from ci),
r as (select *, round(bias, 2) + 0.0 as rb, round(lo, 2) + 0.0 as rl, round(hi, 2) + 0.0 as rh from w),
s as (select station, variable, lead_day, season, case when k and bias > 0 and rb <= 0 then 0.01 when k and bias < 0 and rb >= 0 then -0.01 else rb end as b,
  case when k and lo > 0 and rl <= 0 then 0.01 when k and lo < 0 and rl >= 0 then -0.01 else rl end as l, case when k and hi > 0 and rh <= 0 then 0.01 when k and hi < 0 and rh >= 0 then -0.01 else rh end as h from r)
select station, variable, lead_day, season, round(least(greatest(b, l), h), 2) + 0.0 as bias, round(l, 2) + 0.0 as bias_lo, round(h, 2) + 0.0 as bias_hi from s""")
def rounded_intervals(spark, sf):
    st = _city(spark, sf).withColumns({c: F.col(c) / 1e9 for c in ("bias", "bias_lo", "bias_hi")})
    got = report.round_interval(st, "bias", "bias_lo", "bias_hi", ~F.col("no_detectable_bias"))
    return got.select("station", "variable", "lead_day", "season", *[(F.round(c, 2) + 0.0).alias(c) for c in ("bias", "bias_lo", "bias_hi")])


@query("with " + _CITY + ", p as (select *, case when n % 5 = 0 then not no_detectable_bias else no_detectable_bias end as flag from ci) select station, variable, lead_day, season from p where flag <> no_detectable_bias")
def flag_errors(spark, sf):
    """Statistics of which every fifth has its flag turned."""
    st = _city(spark, sf)
    st = st.withColumn("no_detectable_bias", F.when(F.col("n") % 5 == 0, ~F.col("no_detectable_bias")).otherwise(F.col("no_detectable_bias")))
    return score.flag_errors(st).select("station", "variable", "lead_day", "season")


@query("with " + _CITY + " select station, variable, lead_day, season, n, bias, mae from ci")
def station_documents(spark, sf):
    """What the documents of all stations hold, read back from their text."""
    docs = report.station_documents(_city(spark, sf).select("station", "variable", "lead_day", "season", "n", "bias", "mae"))
    back = F.from_json("document", "station string, stats array<struct<variable:string,lead_day:int,season:string,bias:double,mae:double,n:long>>", {"mode": "FAILFAST"})
    rows = docs.select(back.alias("d")).select("d.station", F.explode("d.stats").alias("s"))
    return rows.select("station", "s.variable", "s.lead_day", "s.season", "s.n", "s.bias", "s.mae")
