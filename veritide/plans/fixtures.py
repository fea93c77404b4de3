"""Forecast panels derived from the given tables, in Spark and as SQL.

Errors are whole cents, so that sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.functions.calendar import at_hour


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Customers of a station, so that stations grow with the table.
CUSTOMERS = 100


def station(key: str, shift: int = 0):
    """The station that a customer's orders belong to."""
    return F.concat(F.lit("S"), F.lpad(F.expr(f"cast(({key} + {shift}) div {CUSTOMERS} as string)"), 7, "0"))


def station_sql(key: str, shift: int = 0) -> str:
    return f"concat('S', lpad(cast(({key} + {shift}) // {CUSTOMERS} as varchar), 7, '0'))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw verification pairs: orders as forecasts, their largest line as the outcome.

    Nearly every order is a pair of its own: those of one station, date, lead and variable are one.
    """
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    seen = li.groupBy("l_orderkey").agg((F.max("l_extendedprice") * 2.0).alias("obs"))
    base = o.join(seen, o.o_orderkey == seen.l_orderkey, "left").select(
        station("o_custkey").alias("station"),
        F.col("o_orderdate").cast("date").alias("run_date"),
        (1 + F.col("o_orderkey") % 3).cast("int").alias("lead_day"),
        F.when(F.col("o_orderkey") % 2 == 0, "max").otherwise("min").alias("variable"),
        F.col("o_totalprice").alias("fc"),
        "obs",
    )
    p = base.groupBy("station", "run_date", "lead_day", "variable").agg(F.max("fc").alias("forecast_f"), F.max("obs").alias("observed_f"), (F.count("obs") > 0).alias("scorable"))
    target = F.date_add("run_date", F.col("lead_day"))
    p = p.withColumns({"runtime": at_hour("run_date", 13), "target_date": target, "window_end": at_hour(target, 18)})
    return p.withColumn("error_f", F.when(F.col("scorable"), F.round((F.col("forecast_f") - F.col("observed_f")) * 100).cast("long")))


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pairs`` as source raw_nbm, and a baseline with half their error at leads 1 and 2."""
    p = pairs(spark, sf_dir)
    half = p.where("lead_day <= 2").withColumn("error_f", F.floor(F.col("error_f") / 2.0)).withColumn("source", F.lit("baseline"))
    return p.withColumn("source", F.lit("raw_nbm")).unionByName(half)


PAIRS = f"""li as (select l_orderkey, max(l_extendedprice) * 2.0 as obs from lineitem group by l_orderkey),
base as (select {station_sql("o_custkey")} as station, cast(o_orderdate as date) as run_date,
  cast(1 + o_orderkey % 3 as int) as lead_day, case when o_orderkey % 2 = 0 then 'max' else 'min' end as variable,
  o_totalprice as fc, obs from orders left join li on o_orderkey = l_orderkey),
pairs0 as (select station, run_date, lead_day, variable, max(fc) as forecast_f, max(obs) as observed_f, count(obs) > 0 as scorable
  from base group by all),
pairs as (select *, cast(run_date as timestamp) + interval 13 hour as runtime, run_date + lead_day as target_date,
  cast(run_date + lead_day as timestamp) + interval 18 hour as window_end,
  case when scorable then cast(round((forecast_f - observed_f) * 100) as bigint) end as error_f from pairs0)"""

FACT = (
    PAIRS
    + """,
fact0 as (select *, 'raw_nbm' as source from pairs union all
  select * replace (cast(floor(error_f / 2.0) as bigint) as error_f), 'baseline' as source from pairs where lead_day <= 2),
fact as (select *, month(target_date) as month, case when month(target_date) in (12, 1, 2) then 'DJF' when month(target_date) in (3, 4, 5) then 'MAM'
  when month(target_date) in (6, 7, 8) then 'JJA' else 'SON' end as season,
  cast(floor((run_date - date '1970-01-01') / 14.0) as bigint) as block_id from fact0 where scorable and error_f is not null),
withref as (select f.*, r.error_f as ref from fact f left join (select * from fact where source = 'raw_nbm') r
  on f.station = r.station and f.run_date = r.run_date and f.lead_day = r.lead_day and f.variable = r.variable)"""
)

#: Versions (half-open, the last one open) and cycle regimes (closed).
VERSIONS = [("v1", "1995-01-01", "1996-03-05"), ("v2", "1996-03-05", "1997-10-10"), ("v3", "1997-10-10", "1999-01-01"), ("v4", "1999-06-01", "2000-05-15"), ("v5", "2000-05-15", None)]
REGIMES = [("13z", 13, "1995-01-01", "1998-04-30"), ("12z", 12, "1998-05-01", None)]


def versions(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(VERSIONS, "version string, f string, t string")
    return df.select("version", F.to_timestamp_ntz("f").alias("valid_from"), F.to_timestamp_ntz("t").alias("valid_to"))


def regimes(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(REGIMES, "regime string, cycle_hour int, f string, t string")
    return df.select("regime", "cycle_hour", F.to_date("f").alias("valid_from"), F.to_date("t").alias("valid_to"))


def _values(rows, casts) -> str:
    one = lambda v, c: f"cast({'null' if v is None else repr(v)} as {c})"
    return ", ".join("(" + ", ".join(one(v, c) for v, c in zip(r, casts, strict=True)) + ")" for r in rows)


DIMS = f"""versions(version, valid_from, valid_to) as (values {_values(VERSIONS, ["varchar", "timestamp", "timestamp"])}),
regimes(regime, cycle_hour, valid_from, valid_to) as (values {_values(REGIMES, ["varchar", "int", "date", "date"])})"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings: (entity, valid, reading in cents)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("entity"), F.col("ts").alias("valid"), F.round(F.col("value") * 100).cast("long").alias("reading"), "event_type", "event_id")


EVENTS = "ev as (select user_id as entity, ts as valid, cast(round(value * 100) as bigint) as reading, event_type, event_id from events)"


def day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A maximum and a minimum window for each entity and day with readings."""
    from veritide.functions.calendar import window

    days = events(spark, sf_dir).select("entity", F.col("valid").cast("date").alias("target_date")).distinct()
    w = days.withColumn("variable", F.explode(F.array(F.lit("max"), F.lit("min"))))
    start, end = window("target_date", "variable")
    return w.withColumns({"window_start": start, "window_end": end})


WINDOWS = (
    EVENTS
    + """,
dv as (select distinct entity, cast(valid as date) as target_date from ev),
win as (select entity, target_date, variable, cast(target_date as timestamp) + case when variable = 'max' then interval 12 hour else interval 0 hour end as window_start,
  cast(target_date as timestamp) + case when variable = 'max' then interval 30 hour else interval 18 hour end as window_end
  from dv, (values ('max'), ('min')) v(variable))"""
)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour groups: readings of the last hour before a synoptic hour carry them."""
    e = events(spark, sf_dir)
    late = F.hour("valid") % 6 >= 3
    return e.select("entity", "valid", F.when(late, F.col("reading")).alias("max_6h_f"), F.when(F.col("event_type") != "view", F.col("reading")).alias("min_6h_f"))


REPORTS = "rep as (select entity, valid, case when hour(valid) % 6 >= 3 then reading end as max_6h_f, case when event_type <> 'view' then reading end as min_6h_f from ev)"


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps: cheap orders count as missing days of their station, the priority as the reason."""
    o = table(spark, sf_dir, "orders").where("o_totalprice < 60000")
    return o.select(station("o_custkey").alias("station"), F.col("o_orderdate").cast("date").alias("gap_date"), F.substring("o_orderpriority", 1, 1).alias("reason"))


GAPS = f"gaps as (select {station_sql('o_custkey')} as station, cast(o_orderdate as date) as gap_date, substr(o_orderpriority, 1, 1) as reason from orders where o_totalprice < 60000)"


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(station("c_custkey", 150).alias("station")).distinct()


STATIONS = f"stations as (select distinct {station_sql('c_custkey', 150)} as station from customer)"
