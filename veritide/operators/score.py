"""Bias, absolute error and skill of slices, with date-block bootstrap intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritide.functions.calendar import block_id, season

from .contracts import require
from .fact import KEY

DIMENSIONS = ("station", "month", "season", "lead_day", "variable")


def prepare(rows: DataFrame, block_days: int = 14, extra: Sequence[str] = ()) -> DataFrame:
    """Scorable rows with month, season (of the target date) and block (of the run date)."""
    require(rows, "station", "run_date", "lead_day", "variable", "source", "target_date", "scorable", "error_f")
    out = rows.where(F.col("scorable") & F.col("error_f").isNotNull())
    out = out.withColumns({"month": F.month("target_date"), "season": season("target_date"), "block_id": block_id("run_date", block_days)})
    return out.select(*KEY, "source", "month", "season", "block_id", "error_f", *extra)


def with_reference(rows: DataFrame, reference: str) -> DataFrame:
    """``rows`` with ``ref``: the reference's error on the same key, null where it has none (one shuffle by the key)."""
    same = W.partitionBy(*KEY)
    return rows.withColumn("ref", F.max(F.when(F.col("source") == reference, F.col("error_f"))).over(same))


def _sums(reference: str) -> dict:
    own, ref = F.abs("error_f"), F.abs("ref")
    matched = F.col("ref").isNotNull() & (F.col("source") != reference)
    return {"own_abs": F.sum(F.when(matched, own)), "ref_abs": F.sum(F.when(matched, ref))}


def _skill(reference: str):
    ratio = F.col("own_abs") / F.when(F.col("ref_abs") != 0, F.col("ref_abs"))
    return F.when(F.col("source") == reference, F.lit(0.0)).otherwise(1.0 - ratio)


def slice_scores(rows: DataFrame, by: Sequence[str], reference: str = "raw_nbm") -> DataFrame:
    """``n, n_dates, n_blocks, bias, mae, skill`` of each slice of prepared rows; no intervals."""
    keys = list(dict.fromkeys([*by, "source"]))
    return _of_blocks(block_sums(rows, by, reference), keys, reference)


def _of_blocks(sums: DataFrame, keys: list[str], reference: str) -> DataFrame:
    total = sums.groupBy(keys).agg(
        F.sum("n").alias("n"),
        F.sum("n_dates").alias("n_dates"),
        F.count("*").alias("n_blocks"),
        (F.sum("error_sum") / F.sum("n")).alias("bias"),
        (F.sum("abs_sum") / F.sum("n")).alias("mae"),
        F.sum("own_abs").alias("own_abs"),
        F.sum("ref_abs").alias("ref_abs"),
    )
    return total.withColumn("skill", _skill(reference)).drop("own_abs", "ref_abs")


def score_sets(rows: DataFrame, sets: Sequence[Sequence[str]], reference: str = "raw_nbm") -> DataFrame:
    """The scores of several groupings in one pass; dimensions outside a grouping are null and
    ``grouping`` is the bit set of those (first dimension highest)."""
    dims = list(dict.fromkeys(d for s in sets for d in s))
    cols = [*dims, "source"]
    got = with_reference(rows, reference).groupingSets([[*s, "source"] for s in sets], *cols).agg(
        F.grouping_id().alias("grouping"),
        F.count("*").alias("n"),
        F.avg("error_f").alias("bias"),
        F.avg(F.abs("error_f")).alias("mae"),
        *[c.alias(k) for k, c in _sums(reference).items()],
    )
    return got.withColumn("skill", _skill(reference)).drop("own_abs", "ref_abs")


def block_sums(rows: DataFrame, by: Sequence[str], reference: str = "raw_nbm") -> DataFrame:
    """Per slice and block: number, dates, sum of errors, of absolute errors, and of matched pairs.

    Sums of each run date come first; a date lies in one block, so dates are counted by adding up.
    """
    keys = list(dict.fromkeys([*by, "source"]))
    days = with_reference(rows, reference).groupBy(*keys, "block_id", "run_date").agg(
        F.count("*").alias("n"),
        F.sum("error_f").alias("error_sum"),
        F.sum(F.abs("error_f")).alias("abs_sum"),
        *[c.alias(k) for k, c in _sums(reference).items()],
    )
    sums = [F.sum(c).alias(c) for c in ("n", "error_sum", "abs_sum", "own_abs", "ref_abs")]
    return days.groupBy(*keys, "block_id").agg(F.count("*").alias("n_dates"), *sums)


#: Sums of a block that the statistics of a slice are made of.
SUMS = ["n", "error_sum", "abs_sum", "own_abs", "ref_abs"]


def mixed(x):
    """A 32-bit hash of 32-bit numbers (numpy or plain), in arithmetic that 64-bit SQL has too."""
    for _ in range(2):
        x = ((x ^ (x >> 16)) * 0x45D9F3B) & 0xFFFFFFFF
    return x ^ (x >> 16)


def slice_seed(name: str, seed: int) -> int:
    """32 bits of the MD5 of a slice's key and the seed: what its draws depend on."""
    return int(hashlib.md5(f"{name}/{seed}".encode()).hexdigest()[:8], 16)


def resampled(blocks: np.ndarray, name: str, n_boot: int, seed: int) -> np.ndarray:
    """(n_boot, columns): column sums over as many blocks as there are, drawn with replacement.

    Draw j of replicate b takes the block hash(hash(slice, b), j) * m >> 32 of m: a multinomial
    resample that does not depend on what else is drawn, and that :func:`bootstrap_sql` repeats.
    Draws are counted to a weight for each replicate and block, and one product gives all sums.
    """
    m = len(blocks)
    out = np.empty((n_boot, blocks.shape[1]))
    turns = mixed(np.uint64(slice_seed(name, seed)) ^ np.arange(n_boot, dtype=np.uint64))
    step = max(1, 4_000_000 // m)
    for at in range(0, n_boot, step):
        part = turns[at : at + step]
        weights = np.zeros(len(part) * m)
        for low in range(0, m, 4_000_000):  # a slice of more blocks than that is drawn piece by piece
            j = np.arange(low, min(m, low + 4_000_000), dtype=np.uint64)
            place = (mixed(part[:, None] ^ j) * np.uint64(m)) >> np.uint64(32)
            weights += np.bincount((place.astype(np.int64) + np.arange(len(part))[:, None] * m).ravel(), minlength=len(weights))
        out[at : at + step] = weights.reshape(len(part), m) @ blocks
    return out


def block_intervals(blocks: np.ndarray, name: str, n_boot: int, seed: int, level: float) -> list[tuple]:
    """(low, high) of bias, mean absolute error and skill of a slice with block sums ``SUMS``; nulls below two blocks."""
    if len(blocks) < 2:
        return [(None, None)] * 3
    n, errors, sizes, own, ref = resampled(blocks, name, n_boot, seed).T
    found = []
    for values in (errors / n, sizes / n, 1 - own[ref != 0] / ref[ref != 0]):
        found.append(percentiles(values, level))
    return found


def score(rows: DataFrame, by: Sequence[str] = (), reference: str = "raw_nbm", n_boot: int = 2000, seed: int = 1, ci_level: float = 0.95, block_days: int = 14, min_blocks: int = 21) -> DataFrame:
    """Scores of every slice of ``by`` (and source) with intervals and flags.

    ``by`` may hold station, month, season, lead_day and variable. Rows that are not scorable
    drop out. Skill is 1 - sum|error| / sum|reference error| on keys that both sources have; the
    reference scores 0; no such key or a zero denominator gives null. Intervals resample blocks
    of ``block_days`` run days; the draws of a slice depend on ``seed`` and its key alone. Fewer
    than two blocks have no interval, and then no detectable bias. No rows give an empty table.
    """
    unknown = [d for d in by if d not in (*DIMENSIONS, "source")]
    if unknown:
        raise ValueError(f"unknown dimension(s): {', '.join(unknown)}")
    if n_boot < 1 or not 0 < ci_level < 1 or block_days < 1:
        raise ValueError("n_boot and block_days must be positive and ci_level between 0 and 1")
    ready = prepare(rows, block_days)
    if reference != "raw_nbm" and rows.where(F.col("source") == reference).isEmpty():
        raise ValueError(f"no rows of the reference source {reference}")
    keys = list(dict.fromkeys([*by, "source"]))
    sums = block_sums(ready, by, reference)
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}
    names = [f"{k}_{e}" for k in ("bias", "mae", "skill") for e in ("lo", "hi")]

    def intervals(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        plain = [k.item() if hasattr(k, "item") else k for k in key]
        blocks = pdf.sort_values("block_id")[SUMS].fillna(0).to_numpy(float)
        spans = block_intervals(blocks, "/".join(map(str, plain)), n_boot, seed, ci_level)
        if plain[keys.index("source")] == reference:
            spans[2] = (0.0, 0.0)
        return pd.DataFrame([[*plain, *(x for span in spans for x in span)]], columns=[*keys, *names]).astype({c: "float64" for c in names})

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} double" for c in names)])
    ci = sums.groupBy(*keys).applyInPandas(intervals, schema)
    ci = ci.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})
    out = _of_blocks(sums, keys, reference)
    same = [out[k].eqNullSafe(ci[k]) for k in keys]
    out = out.join(ci, same).drop(*[ci[k] for k in keys])
    spans = F.coalesce((F.col("bias_lo") <= 0) & (F.col("bias_hi") >= 0), F.lit(True))
    out = out.withColumns({"min_sample_flag": F.col("n_blocks") < min_blocks, "no_detectable_bias": spans})
    order = ["n", "n_dates", "n_blocks", "bias", "bias_lo", "bias_hi", "mae", "mae_lo", "mae_hi", "skill", "skill_lo", "skill_hi", "min_sample_flag", "no_detectable_bias"]
    return out.select(*keys, *order)


def bootstrap(sums: DataFrame, keys: Sequence[str], num: str, den: str, n_boot: int = 2000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """``keys, n_blocks, lo, hi``: the interval of sum(num) / sum(den) over resampled blocks.

    Blocks without ``den`` do not count; fewer than two, or replicates that are all zero in it,
    have no interval.
    """
    keys = list(keys)
    rows = sums.where(F.col(den).isNotNull()).select(*keys, "block_id", F.col(num).cast("double").alias("num"), F.col(den).cast("double").alias("den"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def of_slice(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        plain = [k.item() if hasattr(k, "item") else k for k in key]
        blocks = pdf.sort_values("block_id")[["num", "den"]].fillna(0).to_numpy(float)
        span = (None, None)
        if len(blocks) > 1:
            top, below = resampled(blocks, "/".join(map(str, plain)), n_boot, seed).T
            span = percentiles(top[below != 0] / below[below != 0], level)
        return pd.DataFrame([[*plain, len(blocks), *span]], columns=[*keys, "n_blocks", "lo", "hi"]).astype({"lo": "float64", "hi": "float64"})

    out = rows.groupBy(*keys).applyInPandas(of_slice, f"{kinds}, n_blocks long, lo double, hi double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("lo", "hi")})


def percentiles(values: np.ndarray, level: float) -> tuple:
    """The interval that holds ``level`` of the values, linearly interpolated; nulls if there are none."""
    tail = 50 * (1 - level)
    return tuple(map(float, np.percentile(values, [tail, 100 - tail]))) if len(values) else (None, None)


def bootstrap_sql(source: str, keys: Sequence[str], columns: Sequence[str], n_boot: int = 2000, seed: int = 1, prefix: str = "") -> str:
    """DuckDB CTEs that repeat :func:`resampled`: table ``ra`` has the column sums of every slice and replicate.

    ``source`` is a table with ``keys``, ``block_id`` and ``columns``; ``sz`` gets the number of blocks of each slice.
    """
    k, p = ", ".join(keys), prefix
    mix = lambda name, x: f"{name}0 as (select * replace (xor({x}, {x} >> 16) * 73244475 & 4294967295 as {x}) from {{}}), {name}1 as (select * replace (xor({x}, {x} >> 16) * 73244475 & 4294967295 as {x}) from {name}0), {name}2 as (select * replace (xor({x}, {x} >> 16) as {x}) from {name}1)"
    names = " || '/' || ".join(f"{c}::varchar" for c in keys)
    return f"""{p}nb as (select *, row_number() over (partition by {k} order by block_id) - 1 as i from {source}),
{p}sz as (select {k}, count(*) as m, ('0x' || substr(md5({names} || '/{seed}'), 1, 8))::bigint as s from {p}nb group by all having count(*) > 1),
{p}tb as (select {k}, m, b, xor(s, b) as x from {p}sz, (select unnest(range({n_boot})) as b)), {mix(p + 'ta', 'x').format(p + 'tb')},
{p}db as (select {k}, m, b, xor(x, j) as x from {p}ta2, lateral (select unnest(range(m)) as j)), {mix(p + 'da', 'x').format(p + 'db')},
{p}ra as (select {k}, b, {', '.join(f'sum({c}) as {c}' for c in columns)} from (select {k}, b, (x * m) >> 32 as i from {p}da2) join {p}nb using ({k}, i) group by all)"""


def as_blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every row as a block of its own (``block_id, n, error_sum``), for a bootstrap of rows beside that of blocks."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.select(*keys, place.alias("block_id"), F.lit(1).alias("n"), F.col("error_f").alias("error_sum"))


def flag_errors(stats: DataFrame) -> DataFrame:
    """Rows whose flag of no detectable bias disagrees with the published interval."""
    spans = F.coalesce((F.col("bias_lo") <= 0) & (F.col("bias_hi") >= 0), F.lit(True))
    return stats.where(~F.col("no_detectable_bias").eqNullSafe(spans))


def verdict(lo: str, hi: str, n_blocks: str, min_blocks: int = 21):
    """positive, negative, indistinguishable, or too few days."""
    few = (F.col(n_blocks) < min_blocks) | F.col(lo).isNull()
    return F.when(few, "too few days").when(F.col(lo) > 0, "positive").when(F.col(hi) < 0, "negative").otherwise("indistinguishable")


def score_splits(rows: DataFrame, split_date: str, reference: str = "raw_nbm") -> DataFrame:
    """Scores before and from ``split_date`` on, and by calendar year of the run date."""
    later = F.when(F.col("run_date") >= F.lit(split_date).cast("date"), "after").otherwise("before")
    ready = prepare(rows).withColumns({"split": later, "year": F.year("run_date")})
    return score_sets(ready, [["split"], ["year"]], reference)
