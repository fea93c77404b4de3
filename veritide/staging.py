"""Tables that are written once and read again, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one on a local master."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-staged-", dir="/tmp"))
    return f"file://{_own_dir[0]}"


def staged_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder; what is written there goes when the application ends."""
    at = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder.getParent())
    fs.deleteOnExit(folder)
    return at


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it; cuts the lineage. It goes when the application ends."""
    spark = df.sparkSession
    at = staged_path(spark)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
