import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritide.operators import quantiles, score


def test_quantiles_equal_percentile(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([1, None]), rng.choice([None, rng.gauss(0, 1), float(rng.randint(0, 3)), 7.0])) for _ in range(4000)]
    rows += [("one", 1, 5.0), ("nulls", 1, None), ("two", 1, 1.0), ("two", 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, s int, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = quantiles.exact_quantiles(df.groupBy("k", "s", "v").agg(F.count("*").alias("n")), ["k", "s"], "v", {"low": 0.05, "mid": 0.5, "high": 0.95, "least": 0.0, "most": 1.0})
    spread = got.sparkSession.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = df.groupBy("k", "s").agg(*[F.expr(f"percentile(v, {q})").alias(n) for n, q in (("low", 0.05), ("mid", 0.5), ("high", 0.95), ("least", 0), ("most", 1))])
    key = lambda r: (r.k, r.s is None)
    a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(a) == len(b) == 7 and int(spread) > 1
    for x, y in zip(a, b, strict=True):
        assert (x.k, x.s) == (y.k, y.s) and [x.low, x.mid, x.high, x.least, x.most] == pytest.approx([y.low, y.mid, y.high, y.least, y.most])
    assert quantiles.exact_quantiles(df.limit(0).groupBy("k", "s", "v").agg(F.count("*").alias("n")), ["k", "s"], "v", {"mid": 0.5}).count() == 0


def test_draws_are_uniform_and_of_each_slice():
    blocks = np.eye(50)
    got = score.resampled(blocks, "max/1/raw", 2000, 1)
    assert (got.sum(axis=1) == 50).all() and abs(got.mean() - 1) < 1e-9
    assert abs(got.var() - 0.98) < 0.05 and np.abs(got.mean(axis=0) - 1).max() < 0.12  # multinomial
    assert (got == score.resampled(blocks, "max/1/raw", 2000, 1)).all()
    assert not (got == score.resampled(blocks, "max/1/raw", 2000, 2)).all() and not (got == score.resampled(blocks, "min/1/raw", 2000, 1)).all()
    assert int(score.mixed(12345)) == int(score.mixed(np.uint64(12345)))


def test_interval_rules(spark):
    rows = [("one", 1, 2.0, 1.0), ("zero", 1, 0.0, 0.0), ("zero", 2, 0.0, 0.0), ("some", 1, 1.0, 1.0), ("some", 2, 3.0, 1.0), ("none", 1, 1.0, None), ("same", 1, 2.0, 1.0), ("same", 2, 4.0, 2.0)]
    sums = spark.createDataFrame(rows, "k string, block_id long, num double, den double")
    got = {r.k: (r.n_blocks, r.lo, r.hi) for r in score.bootstrap(sums, ["k"], "num", "den").collect()}
    assert got == {"one": (1, None, None), "zero": (2, None, None), "some": (2, 1.0, 3.0), "same": (2, 2.0, 2.0)}
