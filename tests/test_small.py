"""Small functions, each on a few rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veritide.functions import calendar, text
from veritide.operators import models, quality, series
from veritide.sources import readers
from veritide.streaming import ingest


def test_month_spans(spark):
    df = spark.sql("select date'2023-01-20' as lo, date'2023-03-02' as hi union all select date'2023-05-05', date'2023-05-05' union all select null, date'2023-05-05'")
    got = df.select("lo", calendar.month_spans("lo", "hi").alias("s")).collect()
    spans = {r.lo: r.s and [(s.first.isoformat(), s.last.isoformat()) for s in r.s] for r in got}
    assert spans[dt.date(2023, 1, 20)] == [("2023-01-20", "2023-01-31"), ("2023-02-01", "2023-02-28"), ("2023-03-01", "2023-03-02")]
    assert spans[dt.date(2023, 5, 5)] == [("2023-05-05", "2023-05-05")] and spans[None] is None


def test_targets_and_leads(spark):
    df = spark.sql("select timestamp_ntz'2023-07-16 00:00:00' as t, date'2023-07-14' as run union all select timestamp_ntz'2023-07-15 12:00:00', date'2023-07-14'")
    date, variable = calendar.target_of("t")
    got = {(r.d, r.v, r.n) for r in df.select(date.alias("d"), variable.alias("v"), calendar.lead_day(date, "run").alias("n")).collect()}
    assert got == {(dt.date(2023, 7, 15), "max", 1), (dt.date(2023, 7, 15), "min", 1)}
    with pytest.raises(Exception, match="not a verification hour"):
        spark.sql("select timestamp_ntz'2023-07-15 06:00:00' as t").select(calendar.target_of("t")[1]).collect()


def test_late_rows_and_days(spark, tmp_path):
    df = spark.sql("select timestamp_ntz'2023-01-02 12:00:00' as window_end, timestamp_ntz'2023-01-02 12:00:00' as arrived_at, date'2023-01-01' as run_date union all select timestamp_ntz'2023-01-02 12:00:00', timestamp_ntz'2023-01-02 11:59:59', date'2023-01-20'")
    assert [r.late for r in ingest.split_late(df).orderBy("run_date").collect()] == [True, False]
    path = str(tmp_path / "t")
    df.write.partitionBy("run_date").parquet(path)
    near = readers.read_days(spark, path, "2023-01-02", "2023-01-10", columns=["run_date", "window_end"])
    assert [r.run_date for r in near.collect()] == [dt.date(2023, 1, 1)]
    with pytest.raises(ValueError):
        readers.read_days(spark, path, "2023-01-02", "2023-01-10", columns=["nothing"])


def test_repaired_keys(spark):
    rows = [(1, "a", 1.0, None), (1, "a", None, 5), (2, "b", 2.0, 6), (3, "c", None, None), (None, "d", 1.0, 1), (3, "c", None, None)]
    df = spark.createDataFrame(rows, "k int, name string, x double, y int")
    fixed = quality.dedupe(df, ["k", "name"])
    assert sorted((tuple(r) for r in fixed.collect()), key=str) == sorted([(1, "a", 1.0, 5), (2, "b", 2.0, 6), (3, "c", None, None), (None, "d", 1.0, 1)], key=str)
    before = quality.dedupe_report(df, ["k", "name"]).first()
    assert (before.rows_before, before.rows_after, before.keys_collapsed) == (6, fixed.count(), 2)


def test_first_passing_and_raw_model(spark):
    cov = spark.createDataFrame([(2, 0.95), (2, 0.85), (3, 0.91), (3, 0.92), (4, 0.99)], "block_days int, coverage double")
    assert series.first_passing(cov, 1).first().block_days == 3 and series.first_passing(cov, 2, 2).count() == 0
    rows = spark.createDataFrame([(1.5,), (None,)], "forecast_f double")
    assert [(r.forecast, r.fallback) for r in models.RawModel().correct(rows, rows).collect()] == [(1.5, False), (None, False)]


def test_states_and_gap_dates(spark):
    df = spark.createDataFrame([("TX", "2023-07-14@05:51"), ("AK", "2023-07-15"), (None, None)], "state string, expected string")
    assert [r.state for r in text.contiguous_states(df).collect()] == ["TX"]
    got = [r.d for r in df.select(quality.gap_date().alias("d")).collect()]
    assert got == [dt.date(2023, 7, 14), dt.date(2023, 7, 15), None]


def test_bias_is_not_worn_down_by_bad_or_large_errors(spark):
    at = dt.datetime(2023, 1, 1)
    day = lambda k: at + dt.timedelta(days=k)
    rows = [("A", 1, "max", day(k), float("nan") if k == 3 else 1e9 if k < 40 else 0.2) for k in range(120)]
    closed = spark.createDataFrame(rows, "station string, lead_day int, variable string, window_end timestamp_ntz, error_f double")
    asked = spark.createDataFrame([("A", 1, "max", day(k)) for k in (5, 119)], "station string, lead_day int, variable string, known_until timestamp_ntz")
    got = {r.known_until: (r.bias, r.n_pairs) for r in models.rolling_bias(closed, asked).collect()}
    assert got == {day(5): (1e9, 5), day(119): (0.2, 30)}
