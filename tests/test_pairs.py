"""From files to the fact table, with answers worked out by hand."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from veritide.operators import fact
from veritide.sources import readers

GUIDANCE = """station,runtime,ftime,tmp,txn,xnd
KAAA,2023-07-14 13:00:00,2023-07-15 12:00:00,58,60,2
KAAA,2023-07-14 13:00:00,2023-07-16 00:00:00,80,90,3
KAAA,2023-07-14 13:00:00,2023-07-16 12:00:00,57,61,2
KAAA,2023-07-14 13:00:00,2023-07-17 00:00:00,81,91,
KAAA,2023-07-14 13:00:00,2023-07-17 12:00:00,59,,2
KAAA,2023-07-14 13:00:00,2023-07-19 00:00:00,59,92,2
"""

# maxima of the six hours before 18, 00 and 06 (31.1, 32.2, 30.0 degrees), minima before 06, 12 and 18 (15.6, 16.1, 20.0)
REPORTS = [
    ("2023-07-15 05:53", "60.1", "20156"), ("2023-07-15 11:53", "61.0", "20161"), ("2023-07-15 17:53", "80.0", "10311 20200"),
    ("2023-07-15 23:53", "85.0", "10322"), ("2023-07-16 05:53", "70.0", "10300 20211"),
    ("2023-07-15 17:10", "99.0", "10400"),  # earlier in the hour: the last report counts
    ("2023-07-15 16:55", "98.0", "10390"),  # more than an hour before the end of its period
    ("2023-07-16 11:53", "66.0", "20150"),  # the period that ends at 18 has no report
]


@pytest.fixture
def pairs(spark, tmp_path):
    (tmp_path / "g.csv").write_text(GUIDANCE)
    (tmp_path / "h.csv").write_text("station,valid,tmpf,metar\n" + "".join(f"AAA,{t},{f},KAAA RMK A02 {g}\n" for t, f, g in REPORTS))
    (tmp_path / "d.json").write_text(json.dumps({"station": "KAAA", "results": [{"valid": "2023-07-15", "high": "91", "low": "59"}, {"valid": "2023-07-16", "high": "M", "low": "60"}]}))
    regimes = spark.sql("select '13z' as regime, 13 as cycle_hour, date'2020-01-01' as valid_from, cast(null as date) as valid_to")
    versions = spark.sql("select 'v1' as version, timestamp_ntz'2020-01-01 00:00:00' as valid_from, timestamp_ntz'2023-07-14 13:00:00' as valid_to union all select 'v2', timestamp_ntz'2023-07-14 13:00:00', null")
    guidance = readers.read_guidance(spark, [str(tmp_path / "g.csv")], regimes)
    hourly, gaps = readers.read_hourly(spark, [str(tmp_path / "h.csv")], spark.createDataFrame([("KAAA",)], "station string"))
    daily = readers.read_daily(spark, [str(tmp_path / "d.json")], "2023-01-01", "2023-12-31")
    assert gaps.count() == 0
    return fact.pairs_from(guidance, hourly.select("station", "valid", "tmpf"), hourly, daily, versions, regimes)


def test_known_answers(pairs):
    got = {(str(r.target_date), r.variable): r for r in pairs.collect()}
    assert {k: r.lead_day for k, r in got.items()} == {("2023-07-15", "min"): 1, ("2023-07-15", "max"): 1, ("2023-07-16", "min"): 2, ("2023-07-16", "max"): 2}
    low, high = got["2023-07-15", "min"], got["2023-07-15", "max"]
    assert (low.observed_f, low.error_f, low.extreme_source) == (pytest.approx(60.08), pytest.approx(-0.08), "tiled")
    assert (high.observed_f, high.error_f, high.periods_found) == (pytest.approx(89.96), pytest.approx(0.04), 3)
    assert (low.daily_f, high.daily_f, high.version, high.regime) == (59, 91, "v2", "13z")
    late = got["2023-07-16", "min"]
    assert (late.scorable, late.error_f, late.periods_found, late.daily_f) == (False, None, 2, 60)
    assert got["2023-07-16", "max"].spread_f is None and got["2023-07-16", "max"].daily_f is None
    assert low.run_date == dt.date(2023, 7, 14) and low.window_start == dt.datetime(2023, 7, 15)


def test_a_sound_fact_table_breaks_no_rule(pairs):
    pred = pairs.select(*fact.KEY, F.lit("baseline").alias("source"), (F.col("forecast_f") - 1).alias("forecast_f"), F.col("forecast_f").alias("raw_forecast_f"))
    facts = fact.build_fact(pairs, pred)
    assert facts.count() == 8 and fact.violations(facts, pairs, pred).count() == 0
    bad = facts.withColumn("error_f", F.when(F.col("source") == "baseline", None).otherwise(F.col("error_f")))
    rules = {r.rule for r in fact.violations(bad, pairs, pred).collect()}
    assert rules == {"error is not forecast minus observed", "scorable and missing values disagree"}
    lost = {r.rule for r in fact.violations(facts, pairs.where("variable = 'max'"), pred).collect()}
    assert lost == {"prediction without a pair"}
