"""Scorecards, city summaries and export documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritide.functions.calendar import is_finite
from veritide.functions.text import SEASON_WORDS, VARIABLE_WORDS

from veritide.sources.sinks import write_documents, write_manifest

from .fact import KEY
from .log import assert_immutable, head_hash, read_log
from .score import score

SOURCES = ["raw_nbm", "baseline", "challenger"]
SEASONS = ["DJF", "MAM", "JJA", "SON"]


def place_in(name: str, order: list[str]):
    """The place of a value in a fixed order, for sorting; others come last."""
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(F.col(name) == v, i).otherwise(out)
    return out


def latest_gradable(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """The last target date of the log whose outcome is known: ``target_date`` (one row, null if none)."""
    known = pairs.where(F.col("scorable") & is_finite("observed_f")).select(KEY)
    return log.join(known, KEY, "left_semi").agg(F.max("target_date").alias("target_date"))


def raw_conflicts(log: DataFrame) -> DataFrame:
    """Keys whose sources disagree on the raw forecast they corrected."""
    return log.groupBy(*KEY).agg(F.countDistinct("raw_forecast_f").alias("n")).where("n > 1")


def scorecard_rows(log: DataFrame, pairs: DataFrame, days: int = 30) -> DataFrame:
    """Issued predictions, and the raw forecast they corrected as a source of its own, with outcomes.

    Covers the last ``days`` target dates up to the latest gradable one. Outcomes may be missing
    (not scorable then). Raw forecasts that disagree are an error.
    """
    if not raw_conflicts(log).isEmpty():
        raise ValueError("sources disagree on a raw forecast")
    last = latest_gradable(log, pairs)
    inside = log.crossJoin(F.broadcast(last.withColumnRenamed("target_date", "last_target")))
    inside = inside.where((F.col("target_date") <= F.col("last_target")) & (F.col("target_date") > F.date_sub("last_target", days))).drop("last_target")
    own = inside.select(*KEY, "target_date", "source", "forecast_f")
    raw = inside.select(*KEY, "target_date", F.lit("raw_nbm").alias("source"), F.col("raw_forecast_f").alias("forecast_f")).dropDuplicates(KEY)
    out = own.where("source <> 'raw_nbm'").unionByName(raw).join(pairs.select(*KEY, "observed_f", "scorable"), KEY, "left")
    good = F.coalesce(F.col("scorable"), F.lit(False)) & is_finite("observed_f") & is_finite("forecast_f")
    return out.withColumn("scorable", good).withColumn("error_f", F.when(good, F.col("forecast_f") - F.col("observed_f")))


def scorecard(log: DataFrame, pairs: DataFrame, days: int = 30, by_station: bool = False, **options) -> DataFrame:
    """Scores of the last ``days`` target dates by variable, lead and source (and station), in fixed order."""
    by = [*(["station"] if by_station else []), "variable", "lead_day"]
    out = score(scorecard_rows(log, pairs, days), by, **options)
    return out.orderBy(*(["station"] if by_station else []), "variable", "lead_day", place_in("source", SOURCES))


def rounded(value: str, digits: int, keep_sign):
    """``value`` rounded; where ``keep_sign`` holds it may not reach or cross zero."""
    v = F.col(value)
    r, least = F.round(v, digits) + 0.0, F.lit(10.0**-digits)  # no negative zero
    fixed = F.when((v > 0) & (r <= 0), least).when((v < 0) & (r >= 0), -least).otherwise(r)
    return F.when(keep_sign, fixed).otherwise(r)


def round_interval(df: DataFrame, point: str, lo: str, hi: str, keep_sign, digits: int = 2) -> DataFrame:
    """``df`` with a point and its interval rounded so that they say the same about zero; the
    point stays inside the rounded interval."""
    new = {c: rounded(c, digits, keep_sign) for c in (point, lo, hi)}
    new[point] = F.least(F.greatest(new[point], new[lo]), new[hi])
    return df.withColumns({**new, point: F.when(F.col(point).isNotNull(), new[point])})


def round_scores(df: DataFrame) -> DataFrame:
    """Scores rounded for publication: bias and errors to 2 places, skill to 3."""
    out = round_interval(df, "bias", "bias_lo", "bias_hi", ~F.col("no_detectable_bias"))
    apart = F.coalesce((F.col("skill_lo") > 0) | (F.col("skill_hi") < 0), F.lit(False))
    out = round_interval(out, "skill", "skill_lo", "skill_hi", apart, 3)
    return out.withColumns({c: F.round(c, 2) for c in ("mae", "mae_lo", "mae_hi")})


def city_summary(stats: DataFrame) -> DataFrame:
    """``station, text, significant`` and the slice behind it: the largest detectable day-ahead bias.

    Candidates are lead-1 slices with enough blocks and a detectable bias; ties go to maxima,
    then by season. Without one the text says that there is none, or too little data.
    """
    one = stats.where("lead_day = 1")
    ok = ~F.col("no_detectable_bias") & ~F.col("min_sample_flag")
    order = W.partitionBy("station").orderBy(ok.desc(), F.abs("bias").desc(), place_in("variable", ["max", "min"]), place_in("season", SEASONS))
    every = W.partitionBy("station")
    top = one.withColumns({"place": F.row_number().over(order), "enough": F.max(~F.col("min_sample_flag")).over(every), "significant": ok}).where("place = 1")
    words = lambda d, c: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col(c))
    side = F.when(F.col("bias") > 0, "warm").otherwise("cold")
    size = F.round(F.abs("bias"), 1)
    how = F.when(size == 0, F.concat(F.lit("slightly "), side)).otherwise(F.concat(F.format_string("%.1f°F ", size), side))
    found = F.concat(words(VARIABLE_WORDS, "variable"), F.lit(" run "), how, F.lit(" in "), words(SEASON_WORDS, "season"), F.lit(" (day-ahead forecasts)."))
    text = F.when(F.col("significant"), found).when(F.col("enough"), "No detectable bias in day-ahead forecasts.").otherwise("Not enough data yet.")
    keep = lambda c: F.when(F.col("significant"), c)
    return top.select("station", text.alias("text"), "significant", keep(F.col("variable")).alias("variable"), keep(F.col("season")).alias("season"), keep(F.round("bias", 2)).alias("bias"))


def typical_miss(stats: DataFrame) -> DataFrame:
    """``station, variable, mae``: lead-1 error pooled over seasons by size, null unless one has enough blocks."""
    got = stats.where("lead_day = 1").groupBy("station", "variable").agg((F.sum(F.col("n") * F.col("mae")) / F.sum("n")).alias("mae"), F.max(~F.col("min_sample_flag")).alias("enough"))
    return got.select("station", "variable", F.when(F.col("enough"), F.col("mae")).alias("mae"))


def check_finite(df: DataFrame, cols: list[str]) -> None:
    """Raise if a number that would be exported is NaN or infinite."""
    bad = df.where(F.greatest(*[F.col(c).isNotNull() & ~is_finite(c) for c in cols], F.lit(False)))
    if not bad.isEmpty():
        raise ValueError(f"a value of {', '.join(cols)} is not finite")


def station_documents(stats: DataFrame) -> DataFrame:
    """``station, document``: a JSON text for each station, its scores in a fixed order."""
    numbers = [f.name for f in stats.schema if f.dataType.typeName() in ("double", "float")]
    check_finite(stats, numbers)
    row = F.struct("variable", "lead_day", "season", *[c for c in sorted(stats.columns) if c not in ("station", "variable", "lead_day", "season")])
    doc = stats.groupBy("station").agg(F.array_sort(F.collect_list(row)).alias("stats"))
    return doc.select("station", F.to_json(F.struct("station", "stats"), {"ignoreNullFields": "false"}).alias("document"))


def claims_under_floors(stats: DataFrame, floors: tuple[int, int]) -> DataFrame:
    """How many slices may state a bias under each floor of blocks, over all leads and lead 1."""
    parts = []
    for name, rows in (("all", stats), ("lead 1", stats.where("lead_day = 1"))):
        for f in floors:
            claim = (F.col("n_blocks") >= f) & ~F.col("no_detectable_bias")
            parts.append(rows.agg(F.lit(name).alias("leads"), F.lit(f).alias("floor"), F.count("*").alias("slices"), F.count_if(claim).alias("claims")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def export(spark, out: str, facts: DataFrame, pairs: DataFrame, log_path: str, generated_at: str, days: int = 30, **options) -> None:
    """All published documents under ``out``: manifest, index, a document per station, scorecards.

    Refuses a log that does not verify and numbers that are not finite. Scores are rounded after
    their flags are set.
    """
    assert_immutable(spark, log_path)
    stats = score(facts.where("source = 'raw_nbm'"), ["station", "variable", "lead_day", "season"], **options)
    stats = stats.drop("source", "skill", "skill_lo", "skill_hi")
    stats = stats.persist()
    try:
        shown = round_interval(stats, "bias", "bias_lo", "bias_hi", ~F.col("no_detectable_bias"))
        shown = shown.withColumns({c: F.round(c, 2) for c in ("mae", "mae_lo", "mae_hi")})
        write_documents(station_documents(shown), f"{out}/stations")
        miss = typical_miss(stats).groupBy("station").pivot("variable", ["max", "min"]).agg(F.round(F.first("mae"), 2))
        index = city_summary(stats).join(miss, "station", "left").select("station", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))
        write_documents(index, f"{out}/index")
        rows, _ = read_log(spark, log_path)
        card = round_scores(scorecard(rows, pairs, days, **options))
        card.coalesce(1).write.mode("overwrite").json(f"{out}/scorecard")
        last = pairs.where("scorable").agg(F.max("target_date")).first()[0]
        write_manifest(spark, f"{out}/manifest", generated_at=generated_at, data_through=str(last), log_head=head_hash(spark, log_path), version=1)
    finally:
        stats.unpersist()
