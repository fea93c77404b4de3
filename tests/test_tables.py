"""Queries over small tables made for them, against their SQL or answers worked out by hand."""

import datetime as dt
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from veritide import registry
from veritide.operators import quality

registry.load()

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"


def write(spark, folder, orders, lines=()):
    spark.createDataFrame(orders, ORDERS).coalesce(1).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_extendedprice double").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")


def both(spark, folder, name):
    """Rows of a query and of its SQL."""
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = registry.QUERIES[name](spark, str(folder))
    return sorted(map(tuple, df.collect())), sorted(con.execute(f"select {', '.join(df.columns)} from ({registry.ORACLES[name]})").fetchall())


@pytest.mark.parametrize("large", [11, 12])
def test_coverage_that_meets_a_limit_exactly(spark, tmp_path, large):
    """25 pairs, 11 of them with a large error, have coverage 0.956; pairs that are all large have 0.9."""
    orders = [(0, 0, "F", 1.0, dt.datetime(1996, 1, 1))]  # lead 1: one shape passes
    for s in range(1, 41):
        orders += [(6 * (100 * s + d) + 1, 100 * s, "F", 1e6 if (d + s) * 7 % 25 < large else 1.0, dt.datetime(1996, 1, 1) + dt.timedelta(days=d)) for d in range(25) if s % 5]  # lead 2
        orders += [(6 * (100 * s + d) + 5, 100 * s, "F", 1e6, dt.datetime(1996, 1, 1) + dt.timedelta(days=d)) for d in range(s % 20)]  # lead 3
    write(spark, tmp_path, orders, [(o[0], 0.5) for o in orders])
    got, want = both(spark, tmp_path, "rerun_shapes")
    assert got == want and [r for r in got if r[1] == 15] == ([] if large == 11 else [(f"S{s:07d}", 15) for s in range(1, 41) if s % 5])
    got, want = both(spark, tmp_path, "sample_floor")
    assert got == want == [(8,)]


def test_first_stable_of_a_long_group(spark):
    """200,000 rows of one group: rows that each look at all later ones would take hours."""
    k = F.col("id")
    version = F.when((k == 150_000) | (k < 100_000) & (k % 3 == 0), "A").otherwise("B")
    df = spark.range(200_000).select(F.lit(1).alias("g"), k.alias("k"), version.alias("v"))
    begun = time.monotonic()
    got = [tuple(r) for r in quality.first_stable(df, "k", "v", ["g"]).collect()]
    assert got == [(1, "B", 150_001)] and time.monotonic() - begun < 60


def test_first_stable_of_odd_groups_equals_its_sql(spark, tmp_path):
    flips = [(0, 0, "F"), (50, 0, "O"), (100, 0, None), (150, 0, "O"), (200, 50, "O"), (51, 1, "F"), (101, 1, None), (2, 2, None), (52, 2, "P"), (102, 2, "P"), (3, None, "P"), (53, None, "F"), (None, 3, "F"), (54, 3, "F"), (4, 3, "O"), (None, 4, "F"), (5, 4, "O")]
    write(spark, tmp_path, [(k, c, v, 1.0, dt.datetime(1996, 1, 1)) for k, c, v in flips])
    con = duckdb.connect()
    con.execute(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    df = registry.QUERIES["first_stable"](spark, str(tmp_path))
    got = {tuple(r) for r in df.collect()}
    assert got == set(con.execute(f"select g, version, stable_from from ({registry.ORACLES['first_stable']})").fetchall())
    assert got == {(0, "O", 150), (2, "P", 52), (None, "F", 53), (3, "F", 54), (4, "F", None)}


def test_first_stable_without_groups_and_with_ties(spark):
    df = spark.createDataFrame([(1, "A"), (2, "B"), (2, "A"), (3, "B")], "k int, v string")
    whole = lambda rows: [tuple(r) for r in quality.first_stable(rows, "k", "v").collect()]
    assert whole(df) == [("B", 2)] and whole(df.where("k < 3")) == [("B", 2)] and whole(df.where("k < 2")) == [("A", 1)] and whole(df.limit(0)) == []
