"""Queries on what is stored: the log, slices, artifacts, contracts and co-partitioned tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritide.functions.calendar import window
from veritide.operators import artifacts, fact, log, models, quality, report, schema_check, windows
from veritide.plans import fixtures as fx
from veritide.plans import scoring
from veritide.registry import query
from veritide.sources import buckets, commits, sinks
from veritide.staging import staged_path

# --- the log --------------------------------------------------------------------------

_APPENDED = fx.PAIRS + """, iss as (select station, run_date, lead_day, variable, runtime, target_date, 'baseline' as source, window_end, floor(forecast_f / 2)::double as forecast_f, floor(forecast_f)::double as raw_forecast_f,
  runtime + case when day(run_date) % 5 = 0 then interval 40 hour when run_date = date '1996-03-01' then interval 90 hour else interval 2 hour end as issued_at from pairs),
ln as (select run_date, concat_ws('|', station, cast(run_date as varchar), cast(lead_day as varchar), variable, source, cast(target_date as varchar), cast(epoch_us(runtime) as varchar), cast(epoch_us(window_end) as varchar),
  cast(epoch_us(issued_at) as varchar), cast(forecast_f as varchar), cast(raw_forecast_f as varchar), '-', '-', '-', '-') as line from iss where window_end > issued_at),
hs as (select run_date, sha256(line) as line from ln), bk as (select run_date, substr(line, 1, 3) as block, count(*) as n, sha256(string_agg(line, chr(10) order by line)) as hash from hs group by all),
se as (select run_date, sum(n)::bigint as n_rows, sha256(string_agg(block || ':' || hash, chr(10) order by block)) as hash from bk group by run_date),
lt as (select run_date, count(*) filter (window_end <= issued_at) as n_late from iss group by run_date)"""


@query("with " + _APPENDED + " select run_date, n_rows, n_late, hash from se join lt using (run_date)", ("run_date",))
def log_append(spark, sf):
    """Every run date appended and sealed in one commit; some rows are late, and one date only has such rows."""
    day = F.col("run_date")
    after = F.when(F.dayofmonth(day) % 5 == 0, F.expr("interval 40 hours")).when(day == F.lit("1996-03-01").cast("date"), F.expr("interval 90 hours")).otherwise(F.expr("interval 2 hours"))
    rows = fx.pairs(spark, sf).select(*fact.KEY, "runtime", "target_date", F.lit("baseline").alias("source"), "window_end", F.floor(F.col("forecast_f") / 2).cast("double").alias("forecast_f"), F.floor("forecast_f").cast("double").alias("raw_forecast_f"), (F.col("runtime") + after).alias("issued_at"))
    path = staged_path(spark)
    log.append_dates(spark, path, rows.repartition("run_date"), ["baseline"])
    kept, seals = log.read_log(spark, path)
    return log.partition_hashes(kept).join(seals.select("run_date", "n_late", "n_rows", "hash"), ["run_date", "n_rows", "hash"]).select("run_date", "n_rows", "n_late", "hash")


_SPOILT = fx.PAIRS + """, lg as (select station, run_date, lead_day, variable, s.source, floor(forecast_f)::double + case when s.source = 'challenger' and day(run_date) = 7 then 1 else 0 end as raw_forecast_f from pairs, (values ('baseline'), ('challenger')) s(source))"""


@query("with " + _SPOILT + " select station, run_date, lead_day, variable, count(distinct raw_forecast_f) as n from lg group by all having count(distinct raw_forecast_f) > 1", ("run_date",))
def raw_conflicts(spark, sf):
    """Keys whose sources disagree on the raw forecast they corrected: planted on some dates."""
    p = fx.pairs(spark, sf).withColumn("source", F.explode(F.array(F.lit("baseline"), F.lit("challenger"))))
    off = F.when((F.col("source") == "challenger") & (F.dayofmonth("run_date") == 7), 1).otherwise(0)
    return report.raw_conflicts(p.select(*fact.KEY, "source", (F.floor("forecast_f") + off).cast("double").alias("raw_forecast_f")))


# --- slices -----------------------------------------------------------------------------

_MONTHS = "mo as (select o_orderstatus as status, cast(date_trunc('month', o_orderdate) as date) as month, o_orderpriority as priority, count(*) as n from orders group by all)"


@query("with " + _MONTHS + " select status, month, priority, n from mo where not (status = 'F' and month between date '1997-01-01' and date '1998-06-30') union all select status, month, priority, n * 2 from mo where status = 'F' and month between date '1997-01-01' and date '1998-06-30' and n > 1", ("month",))
def replace_slice(spark, sf):
    """Months of a status replaced in one commit in a table that holds all; rows of the slice that have no successor go."""
    o = fx.table(spark, sf, "orders")
    rows = o.groupBy(F.col("o_orderstatus").alias("status"), F.trunc("o_orderdate", "month").alias("month"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    path = staged_path(spark)
    sinks.replace_slice(rows.repartition("month"), path, {}, "month", "1900-01-01", "2100-01-01")
    lo, hi = "1997-01-01", "1998-06-30"
    new = rows.where((F.col("status") == "F") & F.col("month").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")) & (F.col("n") > 1)).withColumn("n", F.col("n") * 2)
    sinks.replace_slice(new.repartition("month"), path, {"status": "F"}, "month", lo, hi)
    return commits.read_dates(spark, path, rows.schema, "month")


# --- artifacts and runs ---------------------------------------------------------------------


@query("""with d as (select cast(o_orderdate as date) as run_date, sum(o_orderkey) as k from orders group by 1), a as (select run_date as retrained_on, k as n_train_rows from d where day(run_date) in (2, 5, 6, 11)),
s as (select run_date from d where day(run_date) % 2 = 1),
c as (select d.run_date, a.retrained_on, a.n_train_rows, row_number() over (partition by d.run_date order by a.retrained_on) as r from d join a on date_trunc('month', d.run_date) = date_trunc('month', a.retrained_on) and a.retrained_on <= d.run_date
  where a.retrained_on = d.run_date or a.retrained_on in (select run_date from s))
select d.run_date, c.retrained_on, c.n_train_rows::bigint as n_train_rows from d left join c on c.run_date = d.run_date and c.r = 1""", ("run_date", "retrained_on"))
def artifact_choice(spark, sf):
    """The artifact that governs each run date: some were fitted on dates that the log never sealed."""
    days = fx.table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("run_date")).agg(F.sum("o_orderkey").alias("k"))
    number = F.dayofmonth("run_date")
    known = days.where(number.isin(2, 5, 6, 11)).select(*[(F.col("run_date") if c == "retrained_on" else F.col("k") if c == "n_train_rows" else F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in artifacts.ARTIFACTS.split(", "))])
    return artifacts.month_artifacts(known, days.where(number % 2 == 1), days).select("run_date", "retrained_on", "n_train_rows")


@query("with " + fx.PAIRS + """, r as (select run_date, min(run_date) over (partition by date_trunc('month', run_date)) as retrained_on, min(runtime) over (partition by date_trunc('month', run_date)) as cut from (select distinct run_date, runtime from pairs))
select run_date, retrained_on, (select max(window_end) from pairs p where p.scorable and p.window_end < r.cut) as trained_through from r""", ("run_date", "retrained_on"))
def trained_through(spark, sf):
    """The last close that each run's refit could know."""
    p = fx.pairs(spark, sf)
    got = models.walk_forward(p, models.RawModel(), *scoring._all_runs(spark, sf))
    return got.select("run_date", "retrained_on", "trained_through").distinct()


# --- contracts ---------------------------------------------------------------------------------

_NOTES = "nt as (select event_id, concat('{\"id\": ', event_id, ', \"kind\": \"', event_type, '\"', case when event_id % 7 = 0 then '' else concat(', \"cells\": [', props, ', {\"k\": ', event_id % 50, case when event_id % 11 = 0 then ', \"z\": 1' else '' end, '}]') end, case when event_id % 13 = 0 then '' else '}' end) as doc, cast(props->>'k' as int) as k from events)"
_NOTE_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["id", "kind", "cells"],
    "properties": {"id": {"type": "integer"}, "kind": {"type": "string", "enum": ["view", "click", "purchase"]}, "cells": {"type": "array", "items": {"type": "object", "additionalProperties": False, "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 3, "maximum": 90}}}}},
}


@query("with " + _NOTES + """, g as (select * from nt where event_id % 13 <> 0), e as (select event_id, event_type from events)
select * from (select '$: not a document' as problem, count(*) as n from nt where event_id % 13 = 0
union all select '$.cells: missing', count(*) from g where event_id % 7 = 0
union all select '$.kind: not one of view, click, purchase', count(*) from g join e using (event_id) where event_type not in ('view', 'click', 'purchase')
union all select '$.cells[].k: beyond minimum 3', count(*) filter (k < 3) + count(*) filter (event_id % 50 < 3) from g where event_id % 7 <> 0
union all select '$.cells[].k: beyond maximum 90', count(*) from g where event_id % 7 <> 0 and k > 90
union all select '$.cells[].z: not allowed', count(*) from g where event_id % 7 <> 0 and event_id % 11 = 0) where n > 0""")
def contract_violations(spark, sf):
    """Documents made of all events, checked against a JSON Schema with nested arrays."""
    e, i = fx.table(spark, sf, "events"), F.col("event_id")
    extra = F.when(i % 11 == 0, ', "z": 1').otherwise("")
    cells = F.when(i % 7 == 0, "").otherwise(F.concat(F.lit(', "cells": ['), "props", F.lit(', {"k": '), (i % 50).cast("string"), extra, F.lit("}]")))
    doc = F.concat(F.lit('{"id": '), i.cast("string"), F.lit(', "kind": "'), "event_type", F.lit('"'), cells, F.when(i % 13 == 0, "").otherwise("}"))
    return schema_check.contract_violations(e.select(doc.alias("document")), _NOTE_SCHEMA)


# --- repairs and windows ---------------------------------------------------------------------------

_KEYED = "hk as (select user_id as entity, cast(date_trunc('hour', ts) as timestamp) as hour, max(case when event_id % 2 = 0 then event_type end) as a, case when event_id % 3 = 0 then 'x' end as b from events group by user_id, date_trunc('hour', ts), event_id % 3 = 0, event_id % 2 = 0)"


@query("with " + _KEYED + ", u as (select entity, hour, max(b) as b, count(*) as n from hk group by entity, hour) select (select sum(n) from u)::bigint as rows_before, count(*) as rows_after, count(*) filter (n > 1) as keys_collapsed, count(b) as with_b from u")
def dedupe_apply(spark, sf):
    """A stored table repaired in place: keys collapsed, counts verified, then put in its place in one commit."""
    e = fx.table(spark, sf, "events")
    third, half = F.col("event_id") % 3 == 0, F.col("event_id") % 2 == 0
    rows = e.groupBy(F.col("user_id").alias("entity"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), third.alias("third"), half.alias("half")).agg(F.lit(None).cast("string").alias("a"))
    rows = rows.select("entity", "hour", "a", F.when(F.col("third"), "x").alias("b"), F.col("hour").cast("date").alias("day"))
    path = staged_path(spark)
    sinks.replace_slice(rows.repartition("day"), path, {}, "day", "1900-01-01", "2100-01-01")
    report = quality.dedupe_stored(spark, path, rows.schema, ["entity", "hour", "day"], "day")
    after = commits.read_dates(spark, path, rows.schema, "day")
    return after.agg(F.count("b").alias("with_b"), F.count("*").alias("rows_after")).select(F.lit(report["rows_before"]).cast("long").alias("rows_before"), "rows_after", F.lit(report["keys_collapsed"]).cast("long").alias("keys_collapsed"), "with_b")


@query("with " + fx.EVENTS + ", " + fx.REPORTS + """, st as (select distinct entity from ev), dd as (select cast(unnest(range(date '2024-01-01', date '2024-01-31', interval 1 day)) as date) as target_date),
win as (select entity, variable, target_date, cast(target_date as timestamp) + case when variable = 'max' then interval 12 hour else interval 0 hour end as window_start, cast(target_date as timestamp) + case when variable = 'max' then interval 30 hour else interval 18 hour end as window_end from st, dd, (values ('max'), ('min')) v(variable)),
hr as (select w.entity, w.variable, w.window_start, count(e.reading) as n_obs, case when count(distinct date_trunc('hour', e.valid)) >= 1 then case when w.variable = 'max' then max(e.reading) else min(e.reading) end end as hourly_f
  from win w left join ev e on w.entity = e.entity and e.valid >= w.window_start and e.valid < w.window_end group by w.entity, w.variable, w.window_start),
pe as (select *, window_start + to_hours(h) as period_end from win, (values (6), (12), (18)) p(h)),
pm as (select p.entity, p.variable, p.window_start, p.period_end, arg_max(case when p.variable = 'max' then max_6h_f else min_6h_f end, r.valid) as v
  from pe p join rep r on p.entity = r.entity and r.valid >= p.period_end - interval 6 hour and r.valid < p.period_end
  where case when p.variable = 'max' then max_6h_f else min_6h_f end is not null group by all),
ti as (select entity, variable, window_start, case when count(*) = 3 then case when variable = 'max' then max(v) else min(v) end end as tiled_f from pm group by entity, variable, window_start)
select variable, count(*) as n_windows, count(tiled_f) as n_tiled, count(hourly_f) as n_hourly, count(*) filter (n_obs = 0) as n_empty, sum(tiled_f - hourly_f)::bigint as diff
from win join hr using (entity, variable, window_start) left join ti using (entity, variable, window_start) group by variable""")
def resolved_scaffold(spark, sf):
    """Every station, target date and variable resolved by both methods, and the two compared."""
    e = fx.events(spark, sf).select("entity", "valid", "reading")
    w = quality.window_scaffold(e.select(F.col("entity").alias("station")), "2024-01-01", "2024-01-30").withColumnRenamed("station", "entity")
    start, end = window("target_date", "variable")
    w = w.withColumns({"window_start": start, "window_end": end})
    got = windows.tiled_extreme(windows.hourly_extreme(w, e, coverage=1 / 18), fx.reports(spark, sf), lookback="6 hours")
    return got.groupBy("variable").agg(F.count("*").alias("n_windows"), F.count("tiled_f").alias("n_tiled"), F.count("hourly_f").alias("n_hourly"), F.count_if(F.col("n_obs") == 0).alias("n_empty"), F.sum(F.col("tiled_f") - F.col("hourly_f")).alias("diff"))


# --- co-partitioned tables ----------------------------------------------------------------------------


@query("select o_orderkey, o_custkey, l_linenumber, round(l_extendedprice * 100)::bigint as cents, n from orders join lineitem on o_orderkey = l_orderkey join (select l_orderkey, count(*) as n from lineitem group by all) using (l_orderkey)")
def copartitioned_join(spark, sf):
    """Orders and their lines from tables bucketed by the order: neither the joins nor the count shuffle."""
    orders = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    lines = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    o, li = (buckets.bucketed(df, ["k"], 16, staged_path(spark)) for df in (orders, lines))
    n = li.groupBy("k").agg(F.count("*").alias("n"))
    return o.join(li, "k").join(n, "k").select(F.col("k").alias("o_orderkey"), "o_custkey", "l_linenumber", "cents", "n")
