"""Co-partitioned tables: what their joins and counts give, and that their plans shuffle nothing."""

import re

from pyspark.sql import functions as F

from veritide.plans import records
from veritide.sources import buckets

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_on_the_bucket_keys_have_no_exchange(spark, tmp_path):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = records.copartitioned_join(spark, SF)
        assert not re.search(r"Exchange (hash|range|round)", plan_of(got)) and plan_of(got).count("SortMergeJoin") == 2
        assert got.count() > 1000
        a = buckets.bucketed(spark.range(100).selectExpr("id % 10 as s", "id as d", "id * 2 as x"), ["s", "d"], 4, str(tmp_path / "a"))
        b = buckets.bucketed(spark.range(50).selectExpr("id % 10 as s", "id as d", "id * 3 as y"), ["s", "d"], 4, str(tmp_path / "b"))
        both = a.join(b, ["s", "d"])
        assert "Exchange" not in plan_of(both)
        assert sorted((r.d, r.x, r.y) for r in both.collect()) == [(d, 2 * d, 3 * d) for d in range(50)]
        assert "Exchange" not in plan_of(a.groupBy("s", "d").agg(F.count("*")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
