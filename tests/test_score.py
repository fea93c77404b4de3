import datetime as dt

import numpy as np
import pytest

from veritide.operators import models, report, score

COLS = "station string, run_date date, lead_day int, variable string, source string, target_date date, scorable boolean, error_f double"


def rows(spark, items):
    d = dt.date(2023, 1, 1)
    return spark.createDataFrame([("A", d + dt.timedelta(k), 1, "max", s, d + dt.timedelta(k + 1), True, e) for k, s, e in items], COLS)


def test_known_answers(spark):
    df = rows(spark, [(0, "raw_nbm", 1.0), (20, "raw_nbm", -2.0), (40, "raw_nbm", 3.0), (0, "challenger", 0.5), (20, "challenger", -1.0), (60, "challenger", 10.0)])
    got = {r.source: r for r in score.score(df, n_boot=200).collect()}
    raw, ch = got["raw_nbm"], got["challenger"]
    assert (raw.bias, raw.mae, raw.skill, raw.skill_lo) == (pytest.approx(2 / 3), 2, 0, 0)
    assert (ch.bias, ch.mae, ch.skill) == (pytest.approx(9.5 / 3), pytest.approx(11.5 / 3), pytest.approx(0.5))
    assert raw.n == 3 and raw.n_blocks == 3 and raw.min_sample_flag and raw.bias_lo <= raw.bias <= raw.bias_hi
    assert ch.skill_lo == pytest.approx(0.5) and ch.skill_hi == pytest.approx(0.5)


def test_intervals_do_not_depend_on_other_slices(spark):
    rng = np.random.default_rng(0)
    items = [(k, "raw_nbm", float(x)) for k, x in enumerate(rng.normal(1, 2, 200))]
    a = score.score(rows(spark, items), ["variable"], n_boot=300)
    other = rows(spark, items).selectExpr("station", "run_date", "lead_day", "'min' as variable", "source", "target_date", "scorable", "error_f + 3 as error_f")
    b = score.score(rows(spark, items).unionByName(other), ["variable"], n_boot=300).where("variable = 'max'")
    assert a.collect() == b.collect()
    r = a.first()
    assert not r.no_detectable_bias and r.bias_lo < r.bias < r.bias_hi
    # the interval of a mean of 15 independent blocks is about that of the normal distribution
    assert (r.bias_hi - r.bias_lo) == pytest.approx(2 * 1.96 * 2 / np.sqrt(200), rel=0.5)


def test_edges_and_errors(spark):
    df = rows(spark, [(0, "raw_nbm", 1.0)])
    one = score.score(df).first()
    assert one.bias_lo is None and one.no_detectable_bias
    assert score.score(df.where("lead_day = 9")).count() == 0
    for bad in ({"by": ["city"]}, {"reference": "nobody"}, {"n_boot": 0}, {"ci_level": 1.0}):
        with pytest.raises(ValueError):
            score.score(df, **bad)
    with pytest.raises(ValueError, match="error_f"):
        score.score(df.drop("error_f"))
    zero = rows(spark, [(0, "raw_nbm", 0.0), (30, "raw_nbm", 0.0), (0, "x", 1.0), (30, "x", 2.0)])
    assert score.score(zero).where("source = 'x'").first().skill is None


def test_blocks_are_floored_before_1970(spark):
    from veritide.functions.calendar import block_id, season

    df = spark.sql("select date'1969-12-31' as d union all select date'1970-01-01' union all select date'1970-01-15'").select("d", block_id("d").alias("b"), season("d").alias("s"))
    assert sorted((r.b, r.s) for r in df.collect()) == [(-1, "DJF"), (0, "DJF"), (1, "DJF")]


def test_walk_is_strict_at_the_cutoff(spark):
    day = lambda k, h=0: dt.datetime(2023, 5, 1) + dt.timedelta(days=k, hours=h)
    rows = []
    for k in range(60):
        # windows close exactly at the run of the next day: not known then
        rows.append(("A", day(k).date(), day(k, 13), 1, "max", day(k + 1).date(), 100.0, day(k + 1, 13), True, float(k)))
    schema = "station string, run_date date, runtime timestamp_ntz, lead_day int, variable string, target_date date, forecast_f double, window_end timestamp_ntz, scorable boolean, error_f double"
    df = spark.createDataFrame(rows, schema)
    got = {r.run_date: r for r in models.walk_forward(df, models.RollingBias(30, 15), "2023-05-01", "2023-06-29", "daily").collect()}
    for k in range(60):
        known = [j for j in range(60) if j + 1 < k]
        used = [j for j in known if j > max(known) - 30] if known else []
        r = got[day(k).date()]
        assert r.fallback == (len(used) < 15)
        assert r.forecast == pytest.approx(100 - np.mean(used) if len(used) >= 15 else 100)
        assert r.trained_through == (day(max(known) + 1, 13) if known else None)
    with pytest.raises(ValueError, match="run time"):
        models.walk_forward(df.unionByName(df.selectExpr("station", "run_date", "runtime + interval 1 hour as runtime", "lead_day + 1 as lead_day", "variable", "target_date", "forecast_f", "window_end", "scorable", "error_f")), models.RawModel(), "2023-05-01", "2023-05-02")
    with pytest.raises(ValueError):
        models.RollingBias(10, 15)


def test_rounding_keeps_the_sign(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.001, 0.0004, 0.02), (-0.004, -0.3, -0.001), (0.5, -0.2, 1.0)], "b double, lo double, hi double")
    keep = (F.col("lo") > 0) | (F.col("hi") < 0)
    got = [tuple(r) for r in report.round_interval(df, "b", "lo", "hi", keep).collect()]
    assert got == [(0.01, 0.01, 0.02), (-0.01, -0.3, -0.01), (0.5, -0.2, 1.0)]
