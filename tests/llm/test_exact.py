import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from veritide.llm import exact, queries

SF = "/root/testdata/sf0.01"


def plain(rows, keep):
    """(id, text) rows: keep_id, size and digest of each, and how many rows of each text stay."""
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    best = {t: (max if keep == "largest" else min)((d for d in own if d is not None), default=None) for t, own in groups.items()}
    return sorted(((d, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows), key=str)


def check(docs, rows, keep, **options):
    got = exact.exact_groups(docs, keep=keep, **options).collect()
    assert sorted(((r.id, r.keep_id, r.group_size, r.sha256) for r in got), key=str) == plain(rows, keep)
    stay = [r for r in got if r.kept]
    assert len(stay) == len({r.sha256 for r in got}) == len({r.sha256 for r in stay}) and all(r.id == r.keep_id for r in stay)
    return got


def test_matches_sql(spark):
    got = sorted(tuple(r) for r in queries.op13_exact_sort(spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert got == sorted(con.execute(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({exact.exact_sql()})").fetchall())


def test_edges(spark):
    long = "x" * 300_000
    rows = [(1, "a"), (2, "a"), (2, "a"), (None, "a"), (None, None), (None, ""), (5, long), (4, long), (6, long + "y"), (7, "A "), (8, " a"), (9, "é"), (10, "é"), (2**60 + 1, "b"), (2**60 + 3, "b")]
    rows += [(k, "x" * 64 + str(k % 3)) for k in range(20, 50)]  # the leading bytes say nothing
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, UID string").repartition(3, "text").cache()
    for keep in ("largest", "smallest"):
        check(docs, rows, keep)
    assert exact.exact_groups(docs.limit(0)).count() == 0
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 4, 6, 7, 8, 9, 10, 2**60 + 1, 20, 21, 22}
    folded = exact.exact_groups(docs, normalise=exact.fold_text).where("sha256 = sha2('a', 256)").collect()
    assert len(folded) == 6 and {r.keep_id for r in folded} == {1} and sum(r.kept for r in folded) == 1


def test_hot_group_is_dealt_to_many_ranges(spark):
    rng = random.Random(5)
    rows = [(k if rng.random() < 0.9 else None, "hot") for k in range(4000)] + [(k, f"own {k % 3000}") for k in range(4000, 10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).cache()
    for shares in (16, 4096):
        check(docs, rows, "largest", shares=shares)
    made = exact.keyed_rows(docs, "doc_id", "text").select("uid", F.col("c0").alias("id"), F.col("c1").cast("binary").alias("body"))
    runs = exact._sorted_runs(made.select("*", F.substring("body", 1, 64).alias("lead"), F.xxhash64("body").alias("digest")), len(rows), "largest", 16)
    sizes = [r["count"] for r in runs.where("salts > 1").groupBy("salt").count().collect()]
    assert len(sizes) == 7 and max(sizes) < 800


def test_plan_has_one_exchange_of_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = exact.keyed_rows(docs, "doc_id", "text").select("uid", F.col("c0").alias("id"), F.col("c1").cast("binary").alias("body"))
    runs = exact._sorted_runs(made.select("*", F.substring("body", 1, 64).alias("lead"), F.xxhash64("body").alias("digest")), 1000, "largest", 16)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
