"""The automatic block length against a plain form and series whose answer is known."""

import math

import numpy as np
import pytest

from veritide.operators import series


def plain(g, n):
    g = g[: max(2, min(len(g), n - 1))]
    if n <= 3 or g[0] <= 0:
        return 1.0
    rho = [x / g[0] for x in g[1:]]
    run, band = max(5, math.ceil(math.sqrt(math.log10(n)))), 2 * math.sqrt(math.log10(n) / n)
    m = next((k for k in range(len(rho) - run + 1) if all(abs(r) < band for r in rho[k : k + run])), None)
    if m is None:
        m = max((k + 1 for k, r in enumerate(rho) if abs(r) >= band), default=0)
    width = min(2 * max(m, 1), len(g) - 1)
    w = [1.0 if k / width <= 0.5 else 2 * (1 - k / width) for k in range(1, width + 1)]
    spread = 2 * sum(x * k * g[k] for k, x in enumerate(w, 1))
    level = g[0] + 2 * sum(x * g[k] for k, x in enumerate(w, 1))
    if level == 0:
        return 1.0
    return min((2 * spread**2 / (4 / 3 * level**2) * n) ** (1 / 3), math.ceil(min(3 * math.sqrt(n), n / 3)))


def test_block_lengths(spark):
    rng = np.random.default_rng(6)
    made = {}
    for name, phi, n in (("white", 0.0, 800), ("half", 0.5, 800), ("high", 0.9, 800), ("minus", -0.6, 500), ("short", 0.3, 9), ("four", 0.0, 4), ("three", 0.0, 3)):
        e, x = rng.normal(size=n), [0.0]
        for v in e:
            x.append(phi * x[-1] + v)
        made[name] = x[1:]
    made["constant"] = [2.0] * 50
    made["walk"] = list(np.cumsum(rng.normal(size=300)))
    rows = [(k, i, float(v)) for k, x in made.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = {r.k: r.b for r in series.optimal_block(df, ["k"], "i", "v").collect()}
    cov = series.autocovariance(df, ["k"], "i", "v", 40).collect()
    want = {r.k: plain([r[f"g{k}"] for k in range(41)], r.n) for r in cov}
    assert got == pytest.approx(want)
    # an AR(1) with coefficient p has the length (6 p^2 / (1 - p^2)^2 n)^(1/3): known for 0.5 and 0.9
    assert got["white"] < 4 and 8 < got["half"] < 20 and got["high"] > 25 and got["constant"] == got["three"] == 1.0
