"""Exact duplicates by a content sort.

Sampled splitters deal the rows to ranges of their bytes, each range is sorted outside memory, and
rows that come to lie side by side are compared whole. Everything is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, fresh, keyed_rows, stage

#: Leading bytes of a text in a splitter. With them go 64 bits of digest and a salt, so that the
#: splitters, which Spark samples on the driver, have a fixed size however long the texts are.
LEAD = 64

#: A digest with more than 1 / SHARES of all rows is hot: at most SHARES digests are.
SHARES = 4096


def fold_text(text: Column) -> Column:
    """A normalisation for :func:`exact_groups`: A-Z in lower case, runs of ASCII white space as one space."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, "[\\x20\\x09-\\x0D]+", " "))


def _sorted_runs(rows: DataFrame, total: int, keep: str, shares: int) -> DataFrame:
    """Rows without their bytes, with the run of equal neighbours that each one lies in.

    A hot digest is dealt to as many ranges as keep each at 1 / ``shares`` of the rows, so that a
    group of copies, whatever its size, is sorted by many tasks.
    """
    counts = rows.groupBy("digest").agg(F.count("*").alias("n"))
    hot = counts.where(F.col("n") * shares > total)  # `shares` rows at most, whatever the table
    parts = hot.select("digest", F.ceil(F.col("n") * shares / F.lit(max(total, 1))).cast("long").alias("salts"))
    dealt = rows.join(F.broadcast(parts), "digest", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts")))
    # The ranges satisfy what the windows ask of their partitions: no further exchange follows.
    ranges = dealt.repartitionByRange("lead", "digest", "salt")
    order = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    near = Window.partitionBy("lead", "digest", "salt").orderBy("body", order, "uid")
    heads = ranges.withColumn("head", ~F.lag("body").over(near).eqNullSafe(F.col("body")))
    run = F.sum(F.col("head").cast("long")).over(near.rowsBetween(Window.unboundedPreceding, 0))
    return heads.withColumn("run", run).select("lead", "digest", "salts", "salt", "run", "head", "uid", "id", F.sha2("body", 256).alias("sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, shares: int = SHARES) -> DataFrame:
    """``uid, id, keep_id, group_size, kept, sha256`` of every row; ``uid`` numbers the rows of ``docs``.

    Rows whose bytes are equal after ``normalise`` (no change without one) are a group; the row
    with the smallest (``keep="largest"``: the largest) id stays, a null id only if the group has
    no other. Of rows that agree in text and id, one stays. ``sha256`` is that of the normalised
    text in UTF-8. Copies are compared whole, byte by byte, within a range; the ranges that share
    a hot group then meet by that SHA-256.

    A null text counts as empty, and empty texts are equal; texts of any length are compared
    whole; repeated rows are rows like any other; other columns are not read; an empty table
    gives an empty one. ``docs`` must give the same rows in the same partitions each time it is
    evaluated, as stored tables do.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    text = F.coalesce(F.col("c1").cast("string"), F.lit(""))
    body = (normalise(text) if normalise else text).cast("binary")
    rows = keyed_rows(docs, id_col, text_col).select("uid", F.col("c0").alias("id"), body.alias("body"))
    rows = rows.select("*", F.substring("body", 1, LEAD).alias("lead"), F.xxhash64("body").alias("digest"))
    runs = _sorted_runs(rows, docs.count(), keep, shares)

    own = Window.partitionBy("lead", "digest", "salt", "run")
    best = F.max(F.when(F.col("head"), F.struct("id", "uid"))).over(own)
    runs = stage(runs.select("digest", "salts", "salt", "run", "head", "uid", "id", "sha256", F.count("*").over(own).alias("n"), best.alias("best")))

    # One row for each range of a hot group: `salts` of them at most for a text.
    parts = runs.where("head and salts > 1")
    whole = Window.partitionBy("digest", "sha256")
    rank = F.col("best.id").desc_nulls_last() if keep == "largest" else F.col("best.id").asc_nulls_last()
    first = F.first("best").over(whole.orderBy(rank, "best.uid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    merged = parts.select("digest", "salt", "run", F.sum("n").over(whole).alias("all_n"), first.alias("all_best"))
    out = runs.where("salts > 1").join(merged, ["digest", "salt", "run"]).withColumns({"n": F.col("all_n"), "best": F.col("all_best")})
    out = runs.where("salts = 1").unionByName(out.select(runs.columns))
    return out.select("uid", "id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("uid") == F.col("best.uid")).alias("kept"), "sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """``docs`` with the one row of each group that :func:`exact_groups` keeps; all columns stay."""
    (uid,) = fresh(docs, "uid")
    stay = exact_groups(docs, id_col, text_col, keep, normalise).where("kept").select(F.col("uid").alias(uid))
    numbered = docs.select(F.monotonically_increasing_id().alias(uid), *[column(docs, c) for c in docs.columns])
    return numbered.join(stay, uid, "left_semi").drop(uid)


def exact_sql(table: str = "documents") -> str:
    """DuckDB SQL for ``op13_exact_sort``."""
    return f"""
with d as (select doc_id, coalesce(text, '') as t from {table}),
r as (select doc_id, t, count(*) over (partition by t) as group_size,
  first_value(doc_id) over w as keep_id, row_number() over w as k
  from d window w as (partition by t order by doc_id desc nulls last))
select doc_id, keep_id, group_size::bigint as group_size, k = 1 as kept, sha256(t) as text_sha256 from r
"""
