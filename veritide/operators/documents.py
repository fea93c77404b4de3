"""The published documents and their contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.sources.sinks import write_documents

from .contracts import require
from .log import assert_immutable, head_hash, log_summary, read_log
from .report import SEASONS, SOURCES, check_finite, city_summary, latest_gradable, place_in, round_interval, round_scores, scorecard, typical_miss
from .schema_check import contract_violations
from .score import score

SCHEMA_VERSION = "1.0.0"


def fields(required: dict, optional: dict | None = None) -> dict:
    """An object that has the ``required`` fields, may have the ``optional`` ones and no others."""
    return {"type": "object", "additionalProperties": False, "required": list(required), "properties": {**required, **(optional or {})}}


# The fields of the published documents, their types and the values they may take.
TEXT, FLAG, NUMBER, WHOLE = {"type": "string"}, {"type": "boolean"}, {"type": "number"}, {"type": "integer"}
MAYBE = {"type": ["number", "null"]}
COUNT, SOME = {"type": "integer", "minimum": 0}, {"type": "integer", "minimum": 1}
DAY = {"type": "string", "pattern": r"^\d{4}-\d{2}-\d{2}$"}
MAYBE_DAY = {"anyOf": [{"type": "null"}, DAY]}
VERSION = {"type": "string", "pattern": r"^\d+\.\d+\.\d+$"}
VARIABLE, LEAD, SEASON = {"type": "string", "enum": ["max", "min"]}, {"type": "integer", "enum": [1, 2, 3]}, {"type": "string", "enum": SEASONS}
CITY_STAT = fields({"variable": VARIABLE, "lead_day": LEAD, "season": SEASON, "n": COUNT, "n_dates": COUNT, "bias_f": MAYBE, "bias_lo_f": MAYBE, "bias_hi_f": MAYBE, "mae_f": MAYBE, "min_sample_flag": FLAG, "no_detectable_bias": FLAG})
CARD_STAT = fields(
    {
        "variable": VARIABLE, "lead_day": LEAD, "source": {"type": "string", "enum": SOURCES}, "n": SOME, "n_dates": SOME, "n_blocks": SOME, "mae_f": {"type": "number", "minimum": 0}, "mae_lo_f": MAYBE, "mae_hi_f": MAYBE,
        "bias_f": NUMBER, "bias_lo_f": MAYBE, "bias_hi_f": MAYBE, "skill": MAYBE, "skill_lo": MAYBE, "skill_hi": MAYBE, "min_sample_flag": FLAG, "no_detectable_bias": FLAG,
    }
)
WINDOW = {"anyOf": [{"type": "null"}, fields({"days": SOME, "basis": {"const": "target_date"}, "start": DAY, "end": DAY})]}
SUMMARY = fields({"text": TEXT, "significant": FLAG}, {"variable": VARIABLE, "lead_day": LEAD, "season": SEASON, "bias_f": NUMBER})
INTERVALS = fields({"method": {"const": "date-block bootstrap"}, "block_days": SOME, "n_boot": SOME, "level": {"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 1}, "min_sample_blocks": SOME, "note": TEXT})
LOG = fields({"partitions": COUNT, "rows": COUNT, "first_run_date": MAYBE_DAY, "last_run_date": MAYBE_DAY, "late_rejected_total": COUNT, "head_chain_sha256": {"type": "string", "pattern": "^[0-9a-f]{64}$"}, "verified": FLAG})
CONTRACTS = {
    "manifest": fields({"schema_version": VERSION, "generated_at": {"type": "string", "pattern": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"}, "data_through": {"type": ["string", "null"]}, "station_count": COUNT, "files": {"type": "array", "items": TEXT}}),
    "city_index": fields({"schema_version": VERSION, "cities": {"type": "array", "items": fields({"icao": TEXT, "label": TEXT, "lat": NUMBER, "lon": NUMBER, "climate_region": TEXT, "summary": SUMMARY})}}),
    "completeness": fields({"schema_version": VERSION, "stations": {"type": "array", "items": False, "maxItems": 0}}),
    "scorecard": fields({"schema_version": VERSION, "window": WINDOW, "intervals": INTERVALS, "log": LOG, "national": {"type": "array", "items": CARD_STAT}}),
    "cities": fields({"schema_version": VERSION, "icao": TEXT, "label": TEXT, "stats": {"type": "array", "items": CITY_STAT}, "typical_miss": fields({"max": MAYBE, "min": MAYBE})}),
    "scorecard_cities": fields({"schema_version": VERSION, "icao": TEXT, "label": TEXT, "window": WINDOW, "stats": {"type": "array", "items": CARD_STAT}}),
}


def json_of(**parts: Column) -> Column:
    """A JSON text of the parts, keys in order, nulls written out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(parts.items())]), {"ignoreNullFields": "false"})


def _version() -> Column:
    return F.lit(SCHEMA_VERSION)


def _stat(columns: dict[str, str]) -> Column:
    """A struct of a slice under its published names, in key order."""
    return F.struct(*[F.col(c).alias(k) for k, c in sorted(columns.items())])


_CITY = {"variable": "variable", "lead_day": "lead_day", "season": "season", "n": "n", "n_dates": "n_dates", "bias_f": "bias", "bias_lo_f": "bias_lo", "bias_hi_f": "bias_hi", "mae_f": "mae", "min_sample_flag": "min_sample_flag", "no_detectable_bias": "no_detectable_bias"}
_CARD = {k: v for k, v in _CITY.items() if k != "season"} | {"source": "source", "n_blocks": "n_blocks", "mae_lo_f": "mae_lo", "mae_hi_f": "mae_hi", "skill": "skill", "skill_lo": "skill_lo", "skill_hi": "skill_hi"}


def _listed(df: DataFrame, keys: list[str], order: list[Column], cell: Column, name: str) -> DataFrame:
    """``keys`` and the cells of each in order, as an array."""
    places = [o.alias(f"o{i}") for i, o in enumerate(order)]
    got = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*places, cell.alias("cell")))).alias("cells"))
    return got.select(*keys, F.transform("cells", lambda c: c["cell"]).alias(name))


def _empty(cells: str, like: DataFrame) -> Column:
    return F.coalesce(F.col(cells), F.array().cast(like.schema[cells].dataType))


def city_documents(stats: DataFrame, stations: DataFrame) -> DataFrame:
    """``station, document``: the slices of each station and its typical miss; stations without a slice have an empty list."""
    order = [place_in("variable", ["max", "min"]), F.col("lead_day"), place_in("season", SEASONS)]
    shown = round_interval(stats, "bias", "bias_lo", "bias_hi", ~F.col("no_detectable_bias")).withColumn("mae", F.round("mae", 2))
    lists = _listed(shown, ["station"], order, _stat(_CITY), "stats")
    miss = typical_miss(stats).groupBy("station").pivot("variable", ["max", "min"]).agg(F.round(F.first("mae"), 2))
    every = stations.select("station", "label").join(lists, "station", "left").join(miss, "station", "left")
    doc = json_of(schema_version=_version(), icao=F.col("station"), label=F.col("label"), stats=_empty("stats", lists), typical_miss=F.struct("max", "min"))
    return every.select("station", doc.alias("document"))


def city_index(stats: DataFrame, stations: DataFrame) -> DataFrame:
    """One document of all stations, a dimension, with the sentence on each."""
    told = city_summary(stats)
    parts = {"text": F.coalesce("text", F.lit("Not enough data yet.")), "significant": F.coalesce("significant", F.lit(False)), "variable": F.col("variable"), "season": F.col("season"), "bias_f": F.col("bias"), "lead_day": F.when(F.col("significant"), F.lit(1))}
    entry = F.struct("climate_region", F.col("station").alias("icao"), "label", "lat", "lon", F.struct(*[c.alias(k) for k, c in sorted(parts.items())]).alias("summary"))
    cities = _listed(stations.join(told, "station", "left").withColumn("one", F.lit(1)), ["one"], [F.col("station")], entry, "cities")
    return cities.select(F.to_json(F.struct("cities", _version().alias("schema_version"))).alias("document"))  # a summary without a slice lacks its fields


def window_of(rows: DataFrame, pairs: DataFrame, days: int) -> DataFrame:
    """``window``: the target dates that are scored (one row; null if nothing can be graded)."""
    end = F.col("target_date")
    struct = F.struct(F.lit("target_date").alias("basis"), F.lit(days).alias("days"), end.cast("string").alias("end"), F.date_sub(end, days - 1).cast("string").alias("start"))
    return latest_gradable(rows, pairs).select(F.when(end.isNotNull(), struct).alias("window"))


def log_block(rows: DataFrame, seals: DataFrame, head: str, verified: bool) -> DataFrame:
    """``log``: what the log holds, its last chain value and whether it verifies (one row)."""
    s = log_summary(rows, seals)
    parts = {"partitions": F.col("n_partitions"), "rows": F.col("n_rows"), "first_run_date": F.col("first_run").cast("string"), "last_run_date": F.col("last_run").cast("string"), "late_rejected_total": F.col("n_late"), "head_chain_sha256": F.lit(head), "verified": F.lit(verified)}
    return s.select(F.struct(*[c.alias(k) for k, c in sorted(parts.items())]).alias("log"))


def _files(folder: str) -> Column:
    return F.transform("s", lambda x: F.concat(F.lit(f"{folder}/"), x, F.lit(".json")))


_NOTE = "Intervals resample blocks of run dates; a flagged slice has too few of them for a call."


def publish(spark: SparkSession, out: str, facts: DataFrame, pairs: DataFrame, log_path: str, stations: DataFrame, generated_at: str, days: int = 30, n_boot: int = 2000, block_days: int = 14, level: float = 0.95, min_blocks: int = 21) -> DataFrame:
    """Write all six kinds of documents under ``out`` and return ``name, problem, n`` of those that break their contract.

    ``stations`` is the dimension (station, label, lat, lon, climate_region); every station has a
    document, also one without data. Refuses a log that does not verify, numbers that are not
    finite and, before anything is written, stations without a label or place.
    """
    require(stations, "station", "label", "lat", "lon", "climate_region")
    if not stations.where("label is null or lat is null or lon is null or climate_region is null").isEmpty():
        raise ValueError("a station lacks its label, place or region")
    assert_immutable(spark, log_path)
    options = {"n_boot": n_boot, "block_days": block_days, "ci_level": level, "min_blocks": min_blocks}
    stats = score(facts.where("source = 'raw_nbm'"), ["station", "variable", "lead_day", "season"], **options).drop("source").persist()
    rows, seals = read_log(spark, log_path)
    national = scorecard(rows, pairs, days, **options).persist()
    local = scorecard(rows, pairs, days, by_station=True, **options).persist()
    try:
        for df in (stats, national, local):
            check_finite(df, [f.name for f in df.schema if f.dataType.typeName() == "double"])
        window = window_of(rows, pairs, days)
        order = [place_in("variable", ["max", "min"]), F.col("lead_day"), place_in("source", SOURCES)]
        made = {"cities": city_documents(stats, stations), "city_index": city_index(stats, stations)}
        completeness = json_of(schema_version=_version(), stations=F.array().cast("array<string>"))
        made["completeness"] = spark.range(1).select(completeness.alias("document"))
        cards = _listed(round_scores(national).withColumn("one", F.lit(1)), ["one"], order, _stat(_CARD), "national")
        intervals = {"method": "date-block bootstrap", "block_days": block_days, "n_boot": n_boot, "level": level, "min_sample_blocks": min_blocks, "note": _NOTE}
        block = F.struct(*[F.lit(v).alias(k) for k, v in sorted(intervals.items())])
        both = window.crossJoin(log_block(rows, seals, head_hash(spark, log_path), True)).withColumn("one", F.lit(1)).join(cards, "one", "left")  # one row
        made["scorecard"] = both.select(json_of(schema_version=_version(), window=F.col("window"), intervals=block, log=F.col("log"), national=_empty("national", cards)).alias("document"))
        lists = _listed(round_scores(local), ["station"], order, _stat(_CARD), "stats")
        every = stations.select("station", "label").join(lists, "station", "left").crossJoin(F.broadcast(window))  # one row
        made["scorecard_cities"] = every.select("station", json_of(schema_version=_version(), icao=F.col("station"), label=F.col("label"), window=F.col("window"), stats=_empty("stats", lists)).alias("document"))
        names = F.array_sort(F.collect_set("station"))
        listed = stations.agg(names.alias("s"), F.count_distinct("station").alias("n")).crossJoin(pairs.where("scorable").agg(F.max("target_date").alias("last")))  # one row
        files = F.concat(F.array(*[F.lit(f"{k}.json") for k in ("manifest", "city_index", "completeness", "scorecard")]), *[_files(k) for k in ("cities", "scorecard_cities")])
        made["manifest"] = listed.select(json_of(schema_version=_version(), generated_at=F.lit(generated_at), data_through=F.col("last").cast("string"), station_count=F.col("n"), files=files).alias("document"))
        found = None
        for name, docs in made.items():
            at = f"{out}/{name}"
            if "station" in docs.columns:
                write_documents(docs, at)
            else:
                docs.coalesce(1).write.mode("overwrite").text(at)
            bad = contract_violations(spark.read.text(at).withColumnRenamed("value", "document"), CONTRACTS[name]).select(F.lit(name).alias("name"), "problem", "n")
            found = bad if found is None else found.unionByName(bad)
        return found
    finally:
        for df in (stats, national, local):
            df.unpersist()
