"""Helpers that the corpus operators share: staged tables, fresh column names, text batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritide import staging

#: ASCII white space, the separators of every word count in this package.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"

#: Tables staged within each open :func:`scratch`.
_open: list[list[DataFrame]] = []


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it; cuts the lineage."""
    out = staging.stage(df)
    if _open:
        _open[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes the tables that are staged within it, but for those taken out of the list it gives."""
    made: list[DataFrame] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.pop()
        for df in made:
            drop_staged(df)


def hand_up(made: list[DataFrame], df: DataFrame) -> DataFrame:
    """Take a staged ``df`` out of its scratch list ``made`` and leave it to the scratch around that one, if there is any."""
    made[:] = [x for x in made if x is not df]
    if len(_open) > 1:
        _open[-2].append(df)
    return df


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Arrow batches of ``rows`` rows at most for the jobs that run within it: whole texts or shingle sets make large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a table from :func:`stage` that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/staged-" in at:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that clash with none of ``df``, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(df: DataFrame, name: str):
    """The column called ``name``, also where it holds dots or backticks."""
    return df[f"`{name.replace('`', '``')}`"]


def numbers_as_text(df: DataFrame, name: str) -> tuple[DataFrame, T.DataType]:
    """``df`` with the column ``name`` ready for pandas, and the type to cast it back to afterwards.

    Beside a null, pandas holds whole numbers as doubles, which rounds large ones; as text they pass unchanged.
    """
    kind = df.schema[name].dataType
    return (df.withColumn(name, F.col(name).cast("string")) if isinstance(kind, T.NumericType) else df), kind


def keyed_rows(df: DataFrame, *cols: str) -> DataFrame:
    """``cols`` of ``df`` as ``c0, c1, ...`` beside a number ``uid`` of each row.

    The number is that of the row in its scan partition, so a recomputed partition gives the
    same ones; equal rows, and rows whose own key is null, keep apart.
    """
    picked = df.select(*[column(df, c).alias(f"c{i}") for i, c in enumerate(cols)])
    return picked.select(F.monotonically_increasing_id().alias("uid"), "*")

