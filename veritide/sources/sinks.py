"""Writers: replaced slices, first-seen gaps, CSV and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import commit_dates, numbers, read_dates


def replace_slice(new: DataFrame, path: str, slice_values: dict, date: str, lo: str, hi: str) -> int:
    """Replace the rows of ``slice_values`` (column: value) and dates in [lo, hi] of a table by ``new``.

    The table is read with :func:`read_dates`. Untouched rows of the affected dates are put beside
    the new ones, and all dates change in one commit: a reader sees the old slice or the new one,
    and so does a repeat after a crash. Rows of ``new`` outside the slice are an error; a second
    writer that was faster is a ``Conflict``. Returns the number of the commit.
    """
    spark = new.sparkSession
    mine = F.lit(True)
    for c, v in slice_values.items():
        mine = mine & F.col(c).eqNullSafe(F.lit(v))
    span = F.col(date).between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    if not new.where(~F.coalesce(mine & span, F.lit(False))).isEmpty():
        raise ValueError("rows outside the slice")
    seen = max(numbers(spark, f"{path}/commits"), default=0)
    old = read_dates(spark, path, new.schema, date, seen or None).where(span)
    touched = old.where(mine).select(date).unionByName(new.select(date)).distinct()
    others = old.where(~F.coalesce(mine, F.lit(False))).join(touched, date, "left_semi")
    return commit_dates(others.select(new.columns).unionByName(new), path, date, touched, seen)


def merge_rows(new: DataFrame, path: str, keys: list[str], date: str) -> int:
    """Put ``new`` into a table that is kept by ``date``: a row replaces the one of the same keys and date.

    Dates that ``new`` does not hold are neither read nor written; of rows of ``new`` that agree
    in keys and date one stays. A repeat gives the same table; all dates change in one commit. The
    table is read with :func:`read_dates`. Returns the number of the commit.
    """
    spark = new.sparkSession
    new = new.dropDuplicates([*keys, date])
    seen = max(numbers(spark, f"{path}/commits"), default=0)
    touched = new.select(date).distinct()
    old = read_dates(spark, path, new.schema, date, seen or None).join(touched, date, "left_semi")
    same = [old[c].eqNullSafe(new[c]) for c in [*keys, date]]
    return commit_dates(old.join(new, same, "left_anti").select(new.columns).unionByName(new), path, date, touched, seen)


def merge_first_seen(old: DataFrame, new: DataFrame, keys: list[str], now: str, inside=None) -> DataFrame:
    """The gaps of ``new``: known ones keep their ``first_seen``, others get ``now``; vanished ones go.

    ``inside`` is the condition of the slice that is replaced; old rows outside it stay, new
    rows outside it are an error.
    """
    at = F.to_timestamp_ntz(F.lit(now))
    if inside is not None and not new.where(~F.coalesce(inside, F.lit(False))).isEmpty():
        raise ValueError("a gap outside the slice")
    seen = old.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"))
    fresh = new.select(*keys).distinct().join(seen, keys, "left").withColumn("first_seen", F.coalesce("first_seen", at))
    if inside is None:
        return fresh
    return old.where(~F.coalesce(inside, F.lit(False))).select(*keys, "first_seen").unionByName(fresh)


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables under the union of their columns."""
    return old.unionByName(new, allowMissingColumns=True)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_extract(df: DataFrame, path: str, order: list[str], files: int = 1) -> DataFrame:
    """A table as Parquet files in ``order``, to hand on or to read elsewhere; returns a reader of them."""
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_documents(docs: DataFrame, path: str, key: str = "station", text: str = "document") -> None:
    """JSON texts as lines under one folder per key."""
    docs.select(key, text).write.mode("overwrite").partitionBy(key).text(path)


def write_manifest(spark: SparkSession, path: str, **facts) -> None:
    """A manifest with the given facts, in key order."""
    spark.range(1).select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(facts.items())])).alias("value")).coalesce(1).write.mode("overwrite").text(path)
