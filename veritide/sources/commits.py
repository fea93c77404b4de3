"""Commits that neither a crash nor a second writer leaves half done.

Rows are written to folders that nobody reads yet. What makes them count is one small file under
the next free number, which appears whole or not at all. Readers take the rows that the numbered
files name, so a writer that stops anywhere before that file has changed nothing, and its run is
simply repeated.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(ValueError):
    """Another writer has taken the number; read again and repeat."""


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    at, fs = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Create the file ``path`` with ``text``, whole or not at all; :class:`Conflict` if it is there already.

    It is written under a name that readers skip and renamed without overwriting, which is
    atomic on HDFS; a store without such a rename needs one writer at a time.
    """
    jvm = spark._jvm
    at, fs = _path(spark, path)
    at = fs.makeQualified(at)
    fs.mkdirs(at.getParent())
    aside = jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    keep = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no option: never overwrite
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, at, keep)
    except Exception as e:
        fs.delete(aside, False)
        if fs.exists(at):
            raise Conflict(f"{path} is there already") from e
        raise


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the commits in a folder, ascending."""
    return sorted(int(n.removesuffix(".json")) for n in names(spark, path) if n.removesuffix(".json").isdigit())


def numbered(path: str, n: int) -> str:
    return f"{path}/{n:010d}.json"


def as_lines(rows: list[dict]) -> str:
    return "".join(json.dumps(r, sort_keys=True) + "\n" for r in rows)


def manifest(spark: SparkSession, path: str, date: str, n: int | None = None) -> DataFrame:
    """``date, attempt``: the folder that holds each date as of commit ``n`` (default: the last); a row for each date."""
    schema = f"`{date}` date, attempt string"
    every = numbers(spark, f"{path}/commits")
    if not every:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(numbered(f"{path}/commits", every[-1] if n is None else n))


def read_dates(spark: SparkSession, path: str, schema, date: str, n: int | None = None) -> DataFrame:
    """A table that :func:`commit_dates` has written, as of commit ``n`` (default: the last).

    ``schema`` names the columns of the table, ``date`` among them. Only folders that the commit
    names are listed; a filter on ``date`` prunes them.
    """
    held = manifest(spark, path, date, n)
    attempts = [r.attempt for r in held.select("attempt").distinct().collect()]  # at most a row for each date
    empty = spark.createDataFrame([], schema)
    if not attempts:
        return empty
    folders = [f"{path}/data/attempt={a}" for a in attempts]
    found = spark.read.schema(empty.withColumn("attempt", F.lit("")).schema).option("basePath", f"{path}/data").parquet(*folders)
    return found.join(held, [date, "attempt"], "left_semi").select(empty.columns)


def commit_dates(rows: DataFrame, path: str, date: str, dates: DataFrame, seen: int) -> int:
    """Replace the ``dates`` of a table by ``rows`` in one commit; a date without rows is gone from it.

    ``seen`` is the number of the commit that ``rows`` were made from (0: none); if there is a
    later one, :class:`Conflict` is raised and the table stays as it is. Returns the new number.
    """
    spark = rows.sparkSession
    attempt = uuid.uuid4().hex
    folder = f"{path}/data/attempt={attempt}"
    rows.write.partitionBy(date).parquet(folder)
    written = spark.read.schema(rows.schema).parquet(folder).select(date).distinct().withColumn("attempt", F.lit(attempt))
    kept = manifest(spark, path, date, seen).join(dates.select(date).distinct(), date, "left_anti") if seen else None
    lines = written if kept is None else kept.select(date, "attempt").unionByName(written)
    named = [{date: str(r[0]), "attempt": r.attempt} for r in lines.orderBy(date).collect()]  # a row for each date
    try:
        if any(r[date] == "None" for r in named):
            raise ValueError(f"a row without {date}")
        publish(spark, numbered(f"{path}/commits", seen + 1), as_lines(named))
    except ValueError:
        delete(spark, folder)
        raise
    return seen + 1


def unused(spark: SparkSession, path: str, date: str) -> list[str]:
    """Attempts that the last commit does not name: replaced, or left by a writer that stopped."""
    used = {r.attempt for r in manifest(spark, path, date).select("attempt").distinct().collect()}
    return [n for n in (x.removeprefix("attempt=") for x in names(spark, f"{path}/data")) if n not in used]


def sweep(spark: SparkSession, path: str, date: str) -> list[str]:
    """Delete the :func:`unused` attempts and the commits before the last; no writer may be at work, and no reader of an earlier commit."""
    gone = unused(spark, path, date)
    for a in gone:
        delete(spark, f"{path}/data/attempt={a}")
    for n in numbers(spark, f"{path}/commits")[:-1]:
        delete(spark, numbered(f"{path}/commits", n))
    return gone
