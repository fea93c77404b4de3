"""An append-only log of issued predictions with hashed, chained partitions."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritide.functions.calendar import is_finite, micros
from veritide.sources import commits

#: Version of the encoding below; a change of it must change this.
ENCODING = 3

#: Leading hexadecimal digits of a row's hash that name its block: 4,096 blocks a date.
BLOCK_DIGITS = 3

KEY = ["station", "run_date", "lead_day", "variable", "source"]

#: What a prediction was made with: the refit, the last close it knew, whether it fell back, the constants as JSON.
PROVENANCE = "retrained_on date, trained_through timestamp_ntz, fallback boolean, params string"

ROWS = f"station string, run_date date, runtime timestamp_ntz, lead_day int, variable string, target_date date, source string, window_end timestamp_ntz, forecast_f double, raw_forecast_f double, issued_at timestamp_ntz, {PROVENANCE}"
SEALS = "run_date date, version int, n_rows long, n_late long, issued_at timestamp_ntz, hash string, previous string, chain string, attempt string"

#: How a seal writes times.
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

#: The chain value before the first partition.
GENESIS = "0" * 64


def canonical(df: DataFrame):
    """The text of a row that is hashed: key, times in microseconds, doubles in the
    shortest decimal form that reads back as the same number, and its provenance if it has any columns of that."""
    bits = lambda c: F.coalesce(F.col(c).cast("double").cast("string"), F.lit("-"))
    times = [F.coalesce(micros(c).cast("string"), F.lit("-")) for c in ("runtime", "window_end", "issued_at")]
    made = [F.coalesce((micros(c) if t == "timestamp_ntz" else F.col(c)).cast("string"), F.lit("-")) for c, t in (x.split() for x in PROVENANCE.split(", ")) if c in df.columns]
    return F.concat_ws("|", *[F.col(c).cast("string") for c in KEY], F.col("target_date").cast("string"), *times, bits("forecast_f"), bits("raw_forecast_f"), *made)


def partition_hashes(rows: DataFrame) -> DataFrame:
    """``run_date, n_rows, hash`` of each run date: SHA-256 of rows, of blocks of rows, of all blocks.

    Rows are dealt to blocks by the leading digits of their own hash; a block's hash is that of
    its sorted row hashes, a date's that of its blocks in order. So no task holds more than a
    block of a date, or the blocks of one.
    """
    lines = rows.select("run_date", F.sha2(canonical(rows), 256).alias("line")).withColumn("block", F.substring("line", 1, BLOCK_DIGITS))
    blocks = lines.groupBy("run_date", "block").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("hash"))
    named = F.transform(F.array_sort(F.collect_list(F.struct("block", "hash"))), lambda b: F.concat_ws(":", b["block"], b["hash"]))
    return blocks.groupBy("run_date").agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(named, "\n"), 256).alias("hash"))


def late_rows(rows: DataFrame, now: str) -> DataFrame:
    """Rows whose window has closed by ``now``: too late to be a forecast."""
    return rows.where(F.col("window_end") <= F.to_timestamp_ntz(F.lit(now)))


def problems_of(rows: DataFrame, now, sources: list[str]) -> DataFrame:
    """``problem, n`` of rows that may not be appended at ``now``, a time or the column that holds it."""
    at = F.to_timestamp_ntz(F.lit(now)) if isinstance(now, str) else now
    rules = {
        "null key": F.greatest(*[F.col(c).isNull() for c in KEY]),
        "null time": F.col("runtime").isNull() | F.col("window_end").isNull() | at.isNull(),
        "value not finite": ~is_finite("forecast_f"),
        "unknown source": ~F.coalesce(F.col("source").isin(sources), F.lit(False)),
        "run after now": F.coalesce(F.col("runtime") > at, F.lit(False)),
    }
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    each = F.array(*[F.struct(F.lit(n).alias("problem"), F.col(f"`{n}`").alias("n")) for n in rules])
    out = counts.select(F.explode(each).alias("p")).select("p.problem", "p.n")
    twice = rows.groupBy(*KEY).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated key").alias("problem"), "n")
    return out.unionByName(twice).where("n > 0")


def read_seals(spark: SparkSession, path: str) -> DataFrame:
    """The seals of a log, one for each run date."""
    if not commits.numbers(spark, f"{path}/seals"):
        return spark.createDataFrame([], SEALS)
    return spark.read.schema(SEALS).option("timestampNTZFormat", _TIME).json(f"{path}/seals").select([c.split()[0] for c in SEALS.split(", ")])


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, seals) under ``path``; empty tables where nothing was written.

    Rows lie in a folder for each attempt and run date. Those of attempts that no seal names, of
    a writer that stopped or was second, are not part of the log.
    """
    seals = read_seals(spark, path)
    if not commits.exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], ROWS), seals
    found = spark.read.schema(f"{ROWS}, attempt string").parquet(f"{path}/rows")
    named = found.join(seals.select("run_date", "attempt"), ["run_date", "attempt"], "left_semi")
    return named.select([c.split()[0] for c in ROWS.split(", ")]), seals


def append_dates(spark: SparkSession, path: str, rows: DataFrame, sources: list[str]) -> dict:
    """Append the rows that are still open at their ``issued_at`` and seal their run dates, in one commit.

    Refuses dates that are sealed or precede the last seal, a date with several issue times, and
    rows with problems; late rows are counted and left out. A date of which all rows are late is
    neither written nor sealed, and can still be issued in time.

    Rows go to a folder of this attempt, are hashed from there and counted against what was
    meant to be written. The file of seals, which names the attempt, is what makes them count: a
    writer that stops before it has changed nothing and is run again; of two writers the second
    gets a ``Conflict`` and leaves nothing. Columns of :data:`PROVENANCE` that ``rows`` lacks are
    null.
    """
    taken = commits.numbers(spark, f"{path}/seals")
    last = read_seals(spark, path).agg(F.max_by(F.struct("run_date", "chain"), "run_date").alias("s")).first().s
    bad = problems_of(rows, F.col("issued_at"), sources).collect()
    if bad:
        raise ValueError("; ".join(f"{r.n} {r.problem}" for r in bad))
    late = F.count_if(F.col("window_end") <= F.col("issued_at"))
    meant = rows.groupBy("run_date").agg(F.count("*").alias("n"), late.alias("late"), F.count_distinct("issued_at").alias("times"), F.max(F.date_format("issued_at", _TIME)).alias("issued_at"))
    meant = {str(r.run_date): r for r in meant.collect()}  # a row for each date
    early = min(meant, default=None)
    if last is not None and early is not None and str(last.run_date) >= early:
        raise ValueError(f"{early} does not follow the last sealed date {last.run_date}")
    if any(r.times > 1 for r in meant.values()):
        raise ValueError("a run date has several issue times")
    result = {"rows": sum(r.n - r.late for r in meant.values()), "late": sum(r.late for r in meant.values())}
    if not result["rows"]:
        return result
    fresh = rows.where(F.col("window_end") > F.col("issued_at"))
    fresh = fresh.select(*[(F.col(c) if c in fresh.columns else F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in ROWS.split(", "))])
    attempt = uuid.uuid4().hex
    folder = f"{path}/rows/attempt={attempt}"
    fresh.write.partitionBy("run_date").parquet(folder)
    try:
        found = {str(r.run_date): r for r in partition_hashes(spark.read.schema(ROWS).parquet(folder)).collect()}  # a row for each date
        seals, chained = [], last.chain if last is not None else GENESIS
        for day in sorted(d for d, r in meant.items() if r.n > r.late):
            want = meant[day].n - meant[day].late
            if day not in found or found[day].n_rows != want:
                raise ValueError(f"{want} rows of {day} were to be written, {found[day].n_rows if day in found else 0} are there")
            before, chained = chained, hashlib.sha256(f"{chained}:{day}:{found[day].hash}".encode()).hexdigest()
            seals.append({"run_date": day, "version": ENCODING, "n_rows": want, "n_late": meant[day].late, "issued_at": meant[day].issued_at, "hash": found[day].hash, "previous": before, "chain": chained, "attempt": attempt})
        commits.publish(spark, commits.numbered(f"{path}/seals", max(taken, default=0) + 1), commits.as_lines(seals))
    except ValueError:
        commits.delete(spark, folder)
        raise
    return result


def append_partition(spark: SparkSession, path: str, run_date: str, rows: DataFrame, now: str, sources: list[str]) -> dict:
    """:func:`append_dates` for the rows of one run date, issued at ``now``; rows of another date are refused."""
    if not rows.where(~F.col("run_date").eqNullSafe(F.lit(run_date).cast("date"))).isEmpty():
        raise ValueError("rows of another run date")
    return append_dates(spark, path, rows.withColumn("issued_at", F.to_timestamp_ntz(F.lit(now))), sources)


def unsealed_attempts(spark: SparkSession, path: str) -> DataFrame:
    """``run_date, attempt`` of rows that no seal names: what a writer that stopped has left."""
    if not commits.exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], "run_date date, attempt string")
    found = spark.read.schema(f"{ROWS}, attempt string").parquet(f"{path}/rows").select("run_date", "attempt").distinct()
    return found.join(read_seals(spark, path), ["run_date", "attempt"], "left_anti")


def chain(previous: str, date: str, digest: str):
    """SHA-256 of the previous chain value, the date and the partition's hash."""
    return F.sha2(F.concat_ws(":", previous, F.col(date).cast("string"), digest), 256)


def seal_rows(rows: DataFrame, issued_at: str | None = None) -> DataFrame:
    """The seals that ``rows`` would have had, one per run date, chained in date order.

    A chain is followed from its start: one pass over one row for each run date.
    """
    hashes = partition_hashes(rows).withColumn("version", F.lit(ENCODING))

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = GENESIS
        for pdf in batches:
            links = []
            for day, digest in zip(pdf["run_date"], pdf["hash"], strict=True):
                before, at = at, hashlib.sha256(f"{at}:{day}:{digest}".encode()).hexdigest()
                links.append((at, before))
            yield pdf.assign(chain=[c for c, _ in links], previous=[p for _, p in links])

    ordered = hashes.select("run_date", "n_rows", "hash", "version").repartition(1).sortWithinPartitions("run_date")
    out = ordered.mapInPandas(follow, "run_date date, n_rows long, hash string, version int, chain string, previous string")
    return out if issued_at is None else out.withColumn("issued_at", F.to_timestamp_ntz(F.lit(issued_at)))


def verify_rows(rows: DataFrame, seals: DataFrame) -> DataFrame:
    """``run_date, problem`` for every way in which rows and seals disagree.

    All partitions are hashed in one job and met with the seals by an outer join; each seal's
    predecessor comes from a window over the dates.
    """
    hashed = partition_hashes(rows).select("run_date", F.col("n_rows").alias("found_rows"), F.col("hash").alias("found_hash"))
    ordered = W.partitionBy(F.lit(0)).orderBy("run_date")  # one row per run date
    s = seals.withColumn("due", F.coalesce(F.lag("chain").over(ordered), F.lit(GENESIS)))
    times = rows.groupBy("run_date").agg(F.count_distinct("issued_at").alias("n_times"), F.max("issued_at").alias("row_issued"), F.count_if(F.col("issued_at") >= F.col("window_end")).alias("n_after"))
    both = s.withColumn("sealed", F.lit(True)).join(hashed, "run_date", "full").join(times, "run_date", "left")
    sealed = F.col("sealed").isNotNull()
    rules = {
        "unsealed rows": ~sealed,
        "unknown version": sealed & (F.col("version") != ENCODING),
        "row count": sealed & (F.coalesce("found_rows", F.lit(0)) != F.col("n_rows")),
        "hash": sealed & (F.coalesce("found_hash", F.sha2(F.lit(""), 256)) != F.col("hash")),
        "chain": sealed & ((F.col("previous") != F.col("due")) | (chain("previous", "run_date", "hash") != F.col("chain"))),
        "issued after close": F.coalesce(F.col("n_after") > 0, F.lit(False)),
    }
    if "issued_at" in seals.columns:
        rules["issue time"] = sealed & F.coalesce((F.col("n_times") > 1) | (F.col("row_issued") != F.col("issued_at")), F.lit(False))
    each = F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])
    return both.select("run_date", F.explode(each).alias("problem")).where("problem is not null")


def verify_log(spark: SparkSession, path: str) -> DataFrame:
    """:func:`verify_rows` of a stored log."""
    return verify_rows(*read_log(spark, path))


def head_hash(spark: SparkSession, path: str) -> str:
    """The last chain value; published elsewhere, it shows a log that was cut off cleanly."""
    got = read_seals(spark, path).agg(F.max_by("chain", "run_date")).first()[0]
    return got or GENESIS


def assert_immutable(spark: SparkSession, path: str) -> None:
    bad = verify_log(spark, path).orderBy("run_date", "problem").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r.run_date}: {r.problem}" for r in bad))


def log_summary(rows: DataFrame, seals: DataFrame) -> DataFrame:
    """First and last run date, late rows, rows and partitions of a log."""
    a = seals.agg(F.min("run_date").alias("first_run"), F.max("run_date").alias("last_run"), F.coalesce(F.sum("n_late"), F.lit(0)).alias("n_late"), F.count("*").alias("n_partitions"))
    return a.crossJoin(rows.agg(F.count("*").alias("n_rows")))
