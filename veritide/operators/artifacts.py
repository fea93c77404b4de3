"""The registry of fitted models: one artifact for each refit date, chosen by what the log has sealed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.sources import commits

#: ``model_path`` is null for a refit that had too few pairs: its predictions fall back.
ARTIFACTS = "retrained_on date, cutoff timestamp_ntz, trained_through timestamp_ntz, n_train_rows long, model_path string, model_hash string, stations string, region_codes string, params string"


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Every registered artifact, one for each refit date."""
    if not commits.names(spark, f"{path}/artifacts"):
        return spark.createDataFrame([], ARTIFACTS)
    return spark.read.schema(ARTIFACTS).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(f"{path}/artifacts")


def register(spark: SparkSession, path: str, facts: dict) -> None:
    """Put an artifact into the registry, whole or not at all; a second one of the same refit date is a ``Conflict``."""
    commits.publish(spark, f"{path}/artifacts/{facts['retrained_on']}.json", json.dumps(facts, sort_keys=True) + "\n")


def month_artifacts(artifacts: DataFrame, seals: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_date`` of ``runs`` and the artifact that governs it; nulls where the run must refit.

    That is the earliest of its month that was fitted on a run date by then which the log has
    sealed, or on the run date itself (a run repeated after a crash). An artifact of a date that
    was never issued is skipped, as a walk over the issued dates would not have it.
    """
    sealed = artifacts.join(seals.select("run_date").distinct(), artifacts["retrained_on"] == seals["run_date"], "left_semi")
    of_month = sealed.groupBy(F.trunc("retrained_on", "month").alias("month")).agg(F.min_by(F.struct(*artifacts.columns), "retrained_on").alias("first"))
    own = artifacts.groupBy(F.col("retrained_on").alias("run_date")).agg(F.first(F.struct(*artifacts.columns)).alias("own"))
    dates = runs.select("run_date").distinct().withColumn("month", F.trunc("run_date", "month"))
    both = dates.join(of_month, "month", "left").join(own, "run_date", "left")
    due = F.when(F.col("first.retrained_on") <= F.col("run_date"), F.col("first"))
    chosen = F.coalesce(due, F.col("own")).alias("a")
    return both.select("run_date", chosen).select("run_date", "a.*")


def verify_artifact(facts: dict, stations: str, region_codes: str, found_hash: str) -> None:
    """Refuse an artifact whose trees have changed, or that was trained with other stations or region codes."""
    at = facts["retrained_on"]
    if facts["model_hash"] != found_hash:
        raise ValueError(f"the model of {at} has changed since it was saved")
    if facts["region_codes"] != region_codes:
        raise ValueError(f"the model of {at} was trained with region codes {facts['region_codes']}, which are now {region_codes}")
    if facts["stations"] != stations:
        raise ValueError(f"the model of {at} was trained with other stations")
