"""Connected components of a graph whose links never leave the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage


def label_pairs(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For nodes 0..n-1 and links a-b: the smallest node of each node's component.

    ``label`` is what earlier links have given; it is changed in place.
    """
    label = np.arange(n) if label is None else label
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not np.array_equal(up := label[label], label):
            label[:] = up
    return label


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch's links as stars around the smallest node of its components."""
    for pdf in batches:
        nodes, at = np.unique(np.concatenate([pdf["u"], pdf["v"]]), return_inverse=True)
        label = label_pairs(len(nodes), at[: len(pdf)], at[len(pdf) :])
        child = label != np.arange(len(nodes))
        yield pd.DataFrame({"u": nodes[child], "v": nodes[label[child]]})


def _settled(links: DataFrame) -> bool:
    """Whether every node links to one other at most, and that one to none: stars around the smallest node."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    more = ends.groupBy("node").agg(F.sum("out").alias("n"), F.min("out").alias("least"))
    return more.where("n > 1 or n > 0 and least = 0").isEmpty()


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node but the smallest of a component.

    ``links`` has two long columns ``u, v``; order, repeats and self-links do not matter and
    null ends are ignored. Alternates the large-star and small-star steps of Kiveris et al.
    (2014), which need a logarithmic number of rounds. Minima are aggregated before they are
    joined, and both sides of each join are staged tables, so that a hub with many links is
    split by adaptive execution. An empty input gives an empty table.
    """
    links = links.where("u is not null and v is not null and u <> v")
    links = stage(links.mapInPandas(_forest, "u long, v long").distinct())
    for _ in range(max_rounds):
        if _settled(links):
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = stage(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        drop_staged(links)
        drop_staged(low)
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        links = stage(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        drop_staged(large)
        drop_staged(low)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
