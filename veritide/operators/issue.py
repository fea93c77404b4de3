"""Issuing one night's predictions from a bounded slice of history, and keeping fitted models."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .artifacts import month_artifacts, read_artifacts, register, verify_artifact
from .asof import trim_history
from .fact import KEY
from .log import append_partition, read_seals
from .models import GROUP, GbtCorrector, RollingBias, walk_forward


def with_provenance(predictions: DataFrame, generated_at: str, **params) -> DataFrame:
    """``predictions`` with ``params`` (JSON of a model's constants, in key order) and ``generated_at``."""
    text = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(params.items())]))
    return predictions.withColumns({"params": text, "generated_at": F.to_timestamp_ntz(F.lit(generated_at))})


def history_for(pairs: DataFrame, run_date: str, days: int = 60) -> DataFrame:
    """The rows that a night's predictions can depend on: its own, and closed pairs of the last
    ``days`` or among the seven latest of their group.

    The last ``days`` (and ten more, since a run is some days older than its close) are read by
    date, which prunes partitions. Older pairs are read only for groups with fewer than seven there."""
    day = F.lit(run_date).cast("date")
    own = pairs.where(F.col("run_date") == day)
    since = F.date_sub(day, days + 10)
    closed = pairs.where((F.col("run_date") < day) & F.col("scorable"))
    recent = closed.where(F.col("run_date") >= since)
    counts = recent.groupBy(*GROUP).agg(F.count("*").alias("n"))
    lacking = own.select(*GROUP).distinct().join(counts, GROUP, "left").where(F.coalesce("n", F.lit(0)) < 7).drop("n")
    if not lacking.isEmpty():
        same = [closed[g].eqNullSafe(lacking[g]) for g in GROUP]
        recent = recent.unionByName(trim_history(closed.where(F.col("run_date") < since).join(lacking, same, "left_semi"), GROUP, 0))
    return own.unionByName(recent)


def params_text(**params) -> str:
    """A model's constants as JSON, in key order."""
    return json.dumps(params, sort_keys=True, separators=(",", ":"))


def issue(spark: SparkSession, path: str, pairs: DataFrame, run_date: str, now: str, days: int = 30, min_pairs: int = 15, source: str = "baseline", challenger: GbtCorrector | None = None) -> dict:
    """Predict ``run_date`` with the rolling bias of what had closed, append to the log and seal.

    Equals the walk-forward evaluation with daily refits restricted to that date. With
    ``challenger`` a boosted model's rows go into the same partition: that of the month's
    artifact (:func:`month_artifacts`), or of a refit on all that had closed by this run, which is
    saved and registered first; as the walk over the issued dates would have it. Every row says
    what it was made with. Rows whose window has closed by ``now`` are counted as late and left out.
    """
    night = pairs.where(F.col("run_date") == F.lit(run_date).cast("date"))
    if night.isEmpty():
        raise ValueError(f"no run on {run_date}")
    history = history_for(pairs, run_date, max(60, 2 * days))
    walk = walk_forward(history, RollingBias(days, min_pairs), run_date, run_date, "daily")
    made = [(source, walk, params_text(model=source, days=days, min_pairs=min_pairs))]
    if challenger is not None:
        model, facts = governing(spark, path, challenger, pairs, run_date)
        closed = history.where(F.col("scorable") & (F.col("run_date") < F.lit(run_date).cast("date")))
        own = challenger.predict(model, night.drop("error_f", "observed_f", "scorable"), closed).withColumn("raw", F.col("forecast_f"))
        own = own.withColumns({"retrained_on": F.lit(str(facts["retrained_on"])).cast("date"), "trained_through": F.lit(facts["trained_through"]).cast("timestamp_ntz")})
        made.append(("challenger", own, facts["params"]))
    rows = None
    for name, got, params in made:
        part = got.select(*KEY, "forecast", "raw", "retrained_on", "trained_through", "fallback").join(night.select(*KEY, "runtime", "target_date", "window_end"), KEY)
        part = part.select(
            *KEY, "runtime", "target_date", F.lit(name).alias("source"), "window_end", F.col("forecast").cast("double").alias("forecast_f"), F.col("raw").cast("double").alias("raw_forecast_f"),
            "retrained_on", "trained_through", "fallback", F.lit(params).alias("params"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return append_partition(spark, path, run_date, rows, now, [n for n, _, _ in made])


def station_hash(stations: DataFrame) -> str:
    """SHA-256 of the names of the stations in order."""
    return stations.select("station").distinct().agg(F.sha2(F.array_join(F.array_sort(F.collect_list("station")), ","), 256)).first()[0]


def model_hash(spark: SparkSession, path: str | None) -> str:
    """SHA-256 over the sorted rows of a saved model's tree table; of a refit without a model, that of no rows."""
    if path is None:
        return spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
    rows = spark.read.parquet(f"{path}/data").select(F.to_json(F.struct("*")).alias("row"))
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row")), "\n"), 256)).first()[0]  # a row per tree node


def save_artifact(corrector: GbtCorrector, model, path: str, run_date: str, stations: DataFrame, cutoff: str | None = None, trained_through: str | None = None, n_train_rows: int | None = None) -> dict:
    """Save a refit (``model`` None: too few pairs, so it falls back) under ``path`` and register it; returns its facts.

    The trees go to a folder of their own first; the entry of the registry, which carries their
    hash, the stations, the region codes and all constants, makes them count.
    """
    spark = stations.sparkSession
    at = None
    if model is not None:
        at = f"{path}/models/{run_date}-{uuid.uuid4().hex}"
        corrector.save(model, at)
    facts = {
        "retrained_on": run_date, "cutoff": cutoff, "trained_through": trained_through, "n_train_rows": n_train_rows, "model_path": at, "model_hash": model_hash(spark, at),
        "stations": station_hash(stations), "region_codes": corrector.region_codes(), "params": corrector.params_text(),
    }
    register(spark, path, facts)
    return facts


def load_artifact(corrector: GbtCorrector, facts: dict, stations: DataFrame) -> object:
    """The model of a registered artifact (None: it falls back), once its trees, stations and region codes are verified."""
    spark = stations.sparkSession
    verify_artifact(facts, station_hash(stations), corrector.region_codes(), model_hash(spark, facts["model_path"]))
    return corrector.load(facts["model_path"]) if facts["model_path"] else None


def governing(spark: SparkSession, path: str, corrector: GbtCorrector, pairs: DataFrame, run_date: str) -> tuple:
    """(model, facts) of the artifact that governs ``run_date``; refits, saves and registers one if the month has none."""
    day = F.lit(run_date).cast("date")
    dates = spark.range(1).select(day.alias("run_date"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c)
    chosen = month_artifacts(read_artifacts(spark, path), read_seals(spark, path), dates)
    facts = chosen.withColumns({c: text(c) for c in ("cutoff", "trained_through")}).withColumn("retrained_on", F.col("retrained_on").cast("string")).first().asDict()
    if facts["retrained_on"] is not None:
        return load_artifact(corrector, facts, pairs), facts
    cutoff = pairs.where(F.col("run_date") == day).agg(F.min("runtime").alias("runtime"))
    known = pairs.where(F.col("scorable") & (F.col("run_date") < day)).crossJoin(F.broadcast(cutoff.select(F.col("runtime").alias("refit_at"))))  # one row
    known = known.where(F.col("window_end") < F.col("refit_at")).drop("refit_at")
    through = known.agg(F.max("window_end").alias("trained_through")).select(text("trained_through")).first()[0]
    train = corrector.training(known)
    n = train.count()
    model = corrector.fit_on(train, n) if n >= corrector.min_rows else None
    return model, save_artifact(corrector, model, path, run_date, pairs, cutoff.select(text("runtime")).first()[0], through, n)
