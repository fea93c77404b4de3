"""Readers of guidance, observation and registry files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritide.functions.text import ambiguity_reason, remark_groups, short_code
from veritide.operators.contracts import require
from veritide.operators.fact import hour_of

GUIDANCE = ["runtime", "ftime", "station", "txn", "xnd", "tmp"]


def _headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The files of each distinct header line."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    first = lines.where("at = 0").groupBy("path").agg(F.first("value").alias("header"))
    out: dict[str, list[str]] = {}
    for r in first.collect():  # a row per file
        out.setdefault(r.header, []).append(r.path)
    return out


def read_by_name(spark: SparkSession, paths: list[str], needed: list[str], null: str = "") -> DataFrame:
    """CSV files read by header name: ``needed`` columns as text, empty fields null.

    Headers drift, and one read of many files would apply the first header to all of them by
    position; files are read per distinct header instead. A header without a needed column is
    an error that names it.
    """
    out = None
    for header, files in sorted(_headers(spark, paths).items()):
        names = [h.strip() for h in header.split(",")]
        missing = [c for c in needed if c not in names]
        if missing:
            raise ValueError(f"missing required column(s): {', '.join(missing)} in {files[0]}")
        schema = T.StructType([T.StructField(n if n in needed else f"_{i}", T.StringType()) for i, n in enumerate(names)])
        part = spark.read.csv(files, schema=schema, header=True, nullValue=null, enforceSchema=True).select(needed)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in needed))
    return out


def read_guidance(spark: SparkSession, paths: list[str], regimes: DataFrame) -> DataFrame:
    """Guidance rows of the canonical cycle of their run date (columns as in the raw table)."""
    raw = read_by_name(spark, paths, GUIDANCE)
    t = lambda c: F.to_timestamp_ntz(c, F.lit("yyyy-MM-dd HH:mm:ss"))
    n = lambda c: F.col(c).cast("double")
    rows = raw.select("station", t("runtime").alias("runtime"), t("ftime").alias("ftime"), n("txn").alias("txn"), n("xnd").alias("xnd"), n("tmp").alias("tmp"))
    rows = hour_of(rows.withColumn("run_date", F.col("runtime").cast("date")), regimes)
    return rows.where(F.hour("runtime") == F.col("cycle_hour"))


def read_hourly(spark: SparkSession, paths: list[str], stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readings with six-hour groups, gaps of ambiguous reports); ``M`` and empty fields are null.

    ``stations`` has the four-letter ``station`` that a three-letter code in the files stands for.
    """
    raw = read_by_name(spark, paths, ["station", "valid", "tmpf", "metar"])
    known = stations.select("station", short_code("station").alias("code")).distinct()
    blank = lambda c: F.when(F.col(c) != "M", F.col(c))
    rows = raw.withColumnRenamed("station", "code").join(F.broadcast(known) if known.count() <= 100_000 else known, "code")
    rows = rows.select("station", F.to_timestamp_ntz("valid", F.lit("yyyy-MM-dd HH:mm")).alias("valid"), blank("tmpf").cast("double").alias("tmpf"), blank("metar").alias("metar"))
    got = rows.withColumns(remark_groups("metar"))
    gaps = None
    for name in ("max", "min"):
        part = got.where(f"{name}_ambiguous").select("station", F.lit("six_hour").alias("source"), F.col("valid").cast("string").alias("expected"), ambiguity_reason(name, "valid").alias("reason"))
        gaps = part if gaps is None else gaps.unionByName(part)
    return got.drop("metar", "max_ambiguous", "min_ambiguous"), gaps


def read_daily(spark: SparkSession, paths: list[str], lo: str, hi: str) -> DataFrame:
    """Daily highs and lows from JSON reports (``{"station", "results": [{"valid", "high", "low"}]}``).

    ``M`` is null, dates outside [lo, hi] go, the last record of a date wins, and days without
    either value go.
    """
    item = "struct<valid:string,high:string,low:string>"
    docs = spark.read.schema(f"station string, results array<{item}>").json(paths, multiLine=True)
    rows = docs.select("station", F.posexplode("results").alias("pos", "r")).select("station", "pos", F.to_date("r.valid").alias("local_date"), *[F.when(F.col(f"r.{c}") != "M", F.col(f"r.{c}")).cast("int").alias(f"{c}_f") for c in ("high", "low")])
    rows = rows.where(F.col("local_date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    last = rows.groupBy("station", "local_date").agg(F.max_by(F.struct("high_f", "low_f"), "pos").alias("r")).select("station", "local_date", "r.high_f", "r.low_f")
    return last.where("high_f is not null or low_f is not null")


def read_seed(spark: SparkSession, path: str, schema: str, key: list[str]) -> DataFrame:
    """A small CSV dimension with declared types; repeated keys are an error."""
    df = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")
    twice = df.groupBy(*key).count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"repeated keys: {[tuple(r)[:-1] for r in twice]}")
    return df


def read_stations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Stations from GeoJSON points: id, name, state, label, lat, lon and elevation in whole metres."""
    feature = "struct<id:string,geometry:struct<coordinates:array<double>>,properties:struct<sid:string,sname:string,state:string,elevation:double>>"
    docs = spark.read.schema(f"features array<{feature}>").json(paths, multiLine=True)
    f = docs.select(F.explode("features").alias("f"))
    p = F.col("f.properties")
    return f.select(F.coalesce(p["sid"], F.col("f.id")).alias("station"), p["sname"].alias("name"), p["state"].alias("state"), F.concat_ws(", ", p["sname"], p["state"]).alias("label"), F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[0].alias("lon"), F.round(p["elevation"]).cast("int").alias("elevation_m"))


def read_segments(spark: SparkSession, paths: list[str], bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Consecutive segments of GeoJSON lines; with ``bbox`` (lat_lo, lon_lo, lat_hi, lon_hi) those with an end inside."""
    docs = spark.read.schema("features array<struct<geometry:struct<coordinates:array<array<double>>>>>").json(paths, multiLine=True)
    line = docs.select(F.explode("features.geometry").alias("g")).select(F.col("g.coordinates").alias("c")).where(F.size("c") > 1)
    steps = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.col("c")[i - 1][1].alias("lat1"), F.col("c")[i - 1][0].alias("lon1"), F.col("c")[i][1].alias("lat2"), F.col("c")[i][0].alias("lon2")))
    out = line.select(F.explode(steps).alias("s")).select("s.*")
    if bbox is not None:
        inside = lambda k: F.col(f"lat{k}").between(bbox[0], bbox[2]) & F.col(f"lon{k}").between(bbox[1], bbox[3])
        out = out.where(inside(1) | inside(2))
    return out


def read_headers(spark: SparkSession, paths: list[str], pattern: str) -> DataFrame:
    """``path, version``: the first group of ``pattern`` in each text file's first matching line."""
    lines = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("number", "line"))
    hit = lines.where(F.col("line").rlike(pattern))
    return hit.groupBy("path").agg(F.min_by(F.regexp_extract("line", pattern, 1), "number").alias("version"))


def read_days(spark: SparkSession, path: str, lo: str, hi: str, date: str = "run_date", before: int = 1, after: int = 4, columns: list[str] | None = None) -> DataFrame:
    """A pruned read of a table by date: from ``before`` days before ``lo`` to ``after`` days after ``hi``."""
    df = spark.read.parquet(path)
    require(df, date, *(columns or []))
    df = df.where(F.col(date).between(F.date_sub(F.lit(lo).cast("date"), before), F.date_add(F.lit(hi).cast("date"), after)))
    return df.select(columns) if columns else df
