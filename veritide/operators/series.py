"""Daily series: autocorrelation, smoothing, autoregression and block lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pooled_series(df: DataFrame, min_entities: int = 6, by: Sequence[str] = ("variable", "lead_day"), date: str = "run_date", entity: str = "station", value: str = "error_f") -> DataFrame:
    """Mean value and number of entities per series and date, where there are enough entities."""
    got = df.where(F.col(value).isNotNull()).groupBy(*by, date).agg(F.avg(value).alias("value"), F.countDistinct(entity).alias("n_entities"))
    return got.where(F.col("n_entities") >= min_entities)


def autocovariance(df: DataFrame, group: Sequence[str], order: str, value: str, lags: int) -> DataFrame:
    """``group, n, mean, g0..g<lags>``: biased autocovariances of each series, one pass over its rows."""
    w = W.partitionBy(*group)
    d = df.withColumn("mean", F.avg(value).over(w)).withColumn("d", F.col(value) - F.col("mean"))
    steps = W.partitionBy(*group).orderBy(order)
    d = d.withColumns({f"d{k}": F.col("d") * F.lag("d", k).over(steps) for k in range(1, lags + 1)}).withColumn("d0", F.col("d") * F.col("d"))
    sums = [(F.coalesce(F.sum(f"d{k}"), F.lit(0.0)) / F.count("*")).alias(f"g{k}") for k in range(lags + 1)]
    return d.groupBy(*group).agg(F.count("*").alias("n"), F.first("mean").alias("mean"), *sums)


def acf(df: DataFrame, group: Sequence[str], order: str, value: str, lags: int = 14) -> DataFrame:
    """``group, lag, acf, band``: autocorrelations at 1..lags and the white-noise band 1.96 / sqrt(n)."""
    got = autocovariance(df, group, order, value, lags)
    each = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"g{k}") / F.when(F.col("g0") != 0, F.col("g0"))).alias("acf")) for k in range(1, lags + 1)])
    return got.select(*group, (1.96 / F.sqrt("n")).alias("band"), F.explode(each).alias("e")).select(*group, "e.lag", "e.acf", "band")


def deseasonalize(df: DataFrame, group: Sequence[str], order: str, value: str, window: int = 31) -> DataFrame:
    """``df`` with ``value`` less its centred rolling mean, in ``residual``; edges use what is there."""
    half = window // 2
    w = W.partitionBy(*group).orderBy(order).rowsBetween(-half, half)
    return df.withColumn("residual", F.col(value) - F.avg(value).over(w))


def upper_median(df: DataFrame, group: Sequence[str], value: str, tie: str) -> DataFrame:
    """The row of each group at sorted place n // 2."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(value, tie)) - 1
    n = F.count("*").over(W.partitionBy(*group))
    return df.withColumn("place", place).withColumn("n", n).where(F.col("place") == F.floor(F.col("n") / 2)).drop("place", "n")


def _less(factor):
    return lambda a, b: a - factor * b


def ar_fit(df: DataFrame, group: Sequence[str], order: str, value: str, max_p: int = 7) -> DataFrame:
    """``group, p, phi, sigma2, mean``: autoregressions by Yule-Walker, the order by AIC (ties: lower).

    Autocovariances are made in Spark; the Levinson-Durbin recursion runs on ``max_p + 1``
    numbers of each series as array expressions.
    """
    got = autocovariance(df, group, order, value, max_p).withColumn("phi0", F.array().cast("array<double>")).withColumn("s0", F.col("g0"))
    for k in range(1, max_p + 1):
        back = F.array(*[F.col(f"g{k - 1 - i}") for i in range(k - 1)]) if k > 1 else F.array().cast("array<double>")
        dot = F.aggregate(F.zip_with(f"phi{k - 1}", back, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        got = got.withColumn(f"r{k}", (F.col(f"g{k}") - dot) / F.when(F.col(f"s{k - 1}") != 0, F.col(f"s{k - 1}")))
        turned = F.zip_with(f"phi{k - 1}", F.reverse(f"phi{k - 1}"), _less(F.col(f"r{k}")))
        got = got.withColumn(f"phi{k}", F.concat(turned, F.array(f"r{k}"))).withColumn(f"s{k}", F.col(f"s{k - 1}") * (1 - F.col(f"r{k}") * F.col(f"r{k}")))
    each = [F.struct((F.col("n") * F.log(f"s{p}") + 2 * p).alias("aic"), F.lit(p).alias("p"), F.col(f"phi{p}").alias("phi"), F.col(f"s{p}").alias("sigma2")) for p in range(max_p + 1)]
    fits = F.filter(F.array(*each), lambda f: (f["p"] < F.col("n")) & f["aic"].isNotNull())
    best = F.array_min(F.transform(fits, lambda f: F.struct(f["aic"], f["p"], f["phi"], f["sigma2"])))
    return got.withColumn("best", best).select(*group, F.col("best")["p"].alias("p"), F.col("best")["phi"].alias("phi"), F.col("best")["sigma2"].alias("sigma2"), "mean")


def flat_top(g, n):
    """The circular-bootstrap block length of Politis and White (2004, corrected 2009), a column of
    autocovariances 0.. (``g``, an array) and the length of the series (``n``).

    The correlogram counts up to the lag from which a whole run of lags is quiet (within twice
    log10(n) / n to the root); without such a run, up to the last lag that is not. A flat-top
    kernel of twice that width weighs the sums. 1 for a series that is short, constant or has no
    level; at most the lesser of 3 sqrt(n) and n / 3, rounded up.
    """
    zero, real = F.lit(0.0), lambda c: c.cast("double")
    g = F.slice(g, F.lit(1), F.greatest(F.lit(2), F.least(F.size(g), (n - 1).cast("int"))))
    lags = F.size(g) - 1
    log_n = F.log10(real(n))
    band = 2 * F.sqrt(log_n / n)
    loud = F.transform(F.slice(g, F.lit(2), lags), lambda x: F.abs(x / F.get(g, F.lit(0))) >= band)
    run = F.greatest(F.lit(5), F.ceil(F.sqrt(log_n)).cast("int"))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(lags - run, F.lit(0))), lambda k: (k + run <= lags) & ~F.exists(F.slice(loud, k + 1, run), lambda x: x))
    last = F.array_max(F.filter(F.sequence(F.lit(1), lags), lambda k: F.get(loud, k - 1)))
    m = F.coalesce(F.get(starts, F.lit(0)), last, F.lit(0))
    width = F.least(2 * F.greatest(m, F.lit(1)), lags)
    weight = lambda k: F.when(2 * k <= width, F.lit(1.0)).otherwise(2 * (1 - k / width))
    ks = F.sequence(F.lit(1), width)
    total = lambda f: F.aggregate(F.transform(ks, f), zero, lambda x, y: x + y)
    spread = 2 * total(lambda k: weight(k) * k * F.get(g, k))
    level = F.get(g, F.lit(0)) + 2 * total(lambda k: weight(k) * F.get(g, k))
    best = F.pow(2 * spread * spread / (F.lit(4.0) / 3 * level * level) * n, F.lit(1.0) / 3)
    most = F.ceil(F.least(3 * F.sqrt(real(n)), n / 3)).cast("double")
    return F.when((n <= 3) | (F.get(g, F.lit(0)) <= 0) | (level == 0), F.lit(1.0)).otherwise(F.least(best, most))


def optimal_block(df: DataFrame, group: Sequence[str], order: str, value: str, lags: int = 40) -> DataFrame:
    """``group, b``: the automatic block length of each series (:func:`flat_top`), from its autocovariances up to ``lags``."""
    got = autocovariance(df, group, order, value, lags)
    return got.select(*group, flat_top(F.array(*[F.col(f"g{k}") for k in range(lags + 1)]), F.col("n")).alias("b"))


def choose_block_days(estimates: DataFrame, a: str = "b_pooled", b: str = "b_station", cap: int = 14) -> DataFrame:
    """``raw_ceiling, block_days, capped``: the largest estimate rounded up, at least 1; null beyond ``cap``."""
    top = estimates.agg(F.greatest(F.lit(1), F.ceil(F.max(F.greatest(a, b)))).alias("raw_ceiling"))
    capped = F.col("raw_ceiling") > cap
    return top.withColumns({"block_days": F.when(~capped, F.col("raw_ceiling")), "capped": capped})


def first_passing(coverage: DataFrame, start: int, cap: int = 14, t: float = 0.90) -> DataFrame:
    """The first block length in [start, cap] whose coverages all reach ``t`` (no row: none does)."""
    ok = coverage.where(F.col("block_days").between(start, cap)).groupBy("block_days").agg(F.min("coverage").alias("low")).where(F.col("low") >= t)
    return ok.agg(F.min("block_days").alias("block_days")).where("block_days is not null")


def choose_min_blocks(coverage: DataFrame, t: float = 0.90) -> DataFrame:
    """The smallest ``n_blocks`` from which on every shape's coverages reach ``t`` (no row: none)."""
    low = coverage.groupBy("n_blocks").agg(F.min("coverage").alias("low"))
    ahead = W.partitionBy(F.lit(0)).orderBy("n_blocks").rowsBetween(0, W.unboundedFollowing)  # one row per block count
    return low.withColumn("least", F.min("low").over(ahead)).where(F.col("least") >= t).agg(F.min("n_blocks").alias("n_blocks")).where("n_blocks is not null")


def needs_rerun(coverage: DataFrame, t: float = 0.90) -> DataFrame:
    """Shapes that fail although one with fewer blocks passes."""
    shapes = coverage.groupBy("shape", "n_blocks").agg((F.min("coverage") >= t).alias("passes"))
    first = shapes.where("passes").agg(F.min("n_blocks").alias("first"))
    return shapes.where("not passes").crossJoin(F.broadcast(first)).where("first < n_blocks").select("shape", "n_blocks")


def series_gaps(df: DataFrame, by: Sequence[str], lo: str, hi: str, date: str = "run_date", least: int = 300, flag: float = 0.10) -> DataFrame:
    """``n_dates, n_missing, missing_fraction, missing_flagged, band`` of series with enough dates."""
    got = df.where(F.col(date).between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))).groupBy(*by).agg(F.countDistinct(date).alias("n_dates")).where(F.col("n_dates") >= least)
    whole = F.datediff(F.lit(hi).cast("date"), F.lit(lo).cast("date")) + 1
    got = got.withColumn("n_missing", whole - F.col("n_dates")).withColumn("missing_fraction", F.col("n_missing") / whole)
    return got.withColumns({"missing_flagged": F.col("missing_fraction") > flag, "band": 1.96 / F.sqrt("n_dates")})
