"""SimHash near-duplicates found with BK-trees over shards of the fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, numbers_as_text, stage
from .components import connected, label_pairs

#: Shingle hashes that are held at a time.
BLOCK = 1 << 17


def _shingles(text: str | None, width: int) -> Iterator[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) <= width:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """The XXH64 of every shingle of a text, repeats included.

    Texts are lower-cased in A-Z and split at ASCII white space; a text with fewer words than
    ``width`` is one shingle, and one without any (null too) has none.
    """
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in _shingles(text, width)), np.uint64)


def fingerprints(texts, width: int = 4, seed: int = 42) -> np.ndarray:
    """The 64-bit SimHash of each text (see :func:`shingle_hashes`); a text without words has zero."""
    return prints_of((shingle_hashes(t, width, seed) for t in texts), len(texts))


def prints_of(hash_lists, n: int | None = None) -> np.ndarray:
    """The SimHash of each list of hashes: a bit is set if it is in over half of them."""
    n = len(hash_lists) if n is None else n
    ones = np.zeros((n, 64), np.int64)
    total = np.zeros(n, np.int64)
    held: list[np.ndarray] = []
    owner: list[int] = []
    size = 0

    def count() -> None:
        nonlocal size
        if held:
            bits = np.unpackbits(np.concatenate(held).view(np.uint8), bitorder="little").reshape(-1, 64)
            starts = np.concatenate([[0], np.cumsum([len(h) for h in held])[:-1]])
            np.add.at(ones, owner, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
            held.clear()
            owner.clear()
            size = 0

    for k, hashes in enumerate(hash_lists):
        total[k] = len(hashes)
        for at in range(0, len(hashes), BLOCK):
            held.append(hashes[at : at + BLOCK])
            owner.append(k)
            size += len(held[-1])
            if size >= BLOCK:
                count()
    count()
    packed = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).ravel() if n else np.zeros(0, np.uint64)


class BKForest:
    """A BK-tree for each shard, all in flat arrays.

    Children of a node are keyed by their Hamming distance to it. Nodes are numbered level by
    level and sorted by (parent, distance), so that the children of a node whose distance lies
    in an interval are consecutive and found by two binary searches.
    """

    def __init__(self, prints: np.ndarray, shard: np.ndarray):
        """``prints``: distinct within each shard; ``shard``: numbers from 0."""
        self.n_shards = int(shard.max()) + 1 if len(shard) else 0
        self.shard_of = shard
        order = np.argsort(shard, kind="stable")
        node, parent_key = order, shard[order].astype(np.int64)
        items, edge, base = [], [], 0
        self.levels: list[tuple[int, np.ndarray]] = []
        while len(node):
            first = np.ones(len(node), bool)
            first[1:] = parent_key[1:] != parent_key[:-1]
            heads = np.flatnonzero(first)
            items.append(node[heads])
            edge.append(parent_key[heads])
            mine = np.cumsum(first) - 1
            rest = ~first
            apart = np.bitwise_count(prints[node[rest]] ^ prints[node[heads]][mine[rest]]).astype(np.int64)
            key = (base + mine[rest]) * 65 + apart
            base += len(heads)
            sort = np.argsort(key, kind="stable")
            node, parent_key = node[rest][sort], key[sort]
        self.item = np.concatenate(items) if items else np.zeros(0, np.int64)
        self.value = prints[self.item]
        #: (parent, distance) of every node below the roots, ascending
        self.edge = np.concatenate(edge[1:]) if len(edge) > 1 else np.zeros(0, np.int64)

    def near(self, query: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``query``, item) of each query and the items of its shard within ``radius``."""
        at, node = np.arange(len(query)), shard.astype(np.int64)  # root k is node k
        got_q, got_i = [], []
        while len(at):
            apart = np.bitwise_count(query[at] ^ self.value[node]).astype(np.int64)
            hit = apart <= radius
            got_q.append(at[hit])
            got_i.append(self.item[node[hit]])
            low = np.searchsorted(self.edge, node * 65 + np.maximum(apart - radius, 0))
            high = np.searchsorted(self.edge, node * 65 + np.minimum(apart + radius, 64), side="right")
            many = high - low
            at = np.repeat(at, many)
            node = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum()) + self.n_shards
        return (np.concatenate(got_q), np.concatenate(got_i)) if got_q else (np.zeros(0, np.int64),) * 2

    def near_steps(self, query: np.ndarray, shard: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """:meth:`near` in steps that hold ``FRONTIER`` pairs of a query and a node at most."""
        size = np.bincount(self.shard_of, minlength=self.n_shards)
        cost = np.cumsum(size[shard]) if len(shard) else np.zeros(0, np.int64)
        at = 0
        while at < len(query):
            upto = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + FRONTIER, side="right")))
            q, i = self.near(query[at:upto], shard[at:upto], radius)
            yield q + at, i
            at = upto


#: Query-node pairs that one step of a search may hold.
FRONTIER = 500_000


def _shard_links(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Stars of the linked fingerprints of whole shards (columns band, key, lo, hi, role, fp)."""
    shard = pdf.groupby(["band", "key", "lo", "hi"], sort=False).ngroup().to_numpy()
    prints, role = pdf["fp"].to_numpy().view(np.uint64), pdf["role"].to_numpy()
    tree = np.flatnonzero(role != 2)  # 0: both, 1: tree, 2: query
    ask = np.flatnonzero(role != 1)
    has_tree = np.zeros(shard.max() + 1, bool)
    has_tree[shard[tree]] = True
    number = np.cumsum(has_tree) - 1
    ask = ask[has_tree[shard[ask]]]
    forest = BKForest(prints[tree], number[shard[tree]])
    nodes, where = np.unique(prints, return_inverse=True)
    label = np.arange(len(nodes))
    for q, i in forest.near_steps(prints[ask], number[shard[ask]], radius):  # pairs give way to labels step by step
        label_pairs(len(nodes), where[ask[q]], where[tree[i]], label)
    child = label != np.arange(len(nodes))
    return pd.DataFrame({"u": nodes[child].view(np.int64), "v": nodes[label[child]].view(np.int64)})


def in_shards(keys: list[str], work: Callable[[pd.DataFrame], Iterable[pd.DataFrame]], hold: int):
    """Reads rows in order of ``keys`` and works on whole shards, ``hold`` rows or so at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf.iloc[-1][keys]
            whole = (pdf[keys] != last).any(axis=1)
            held.append(pdf)
            rows += len(pdf)
            if rows >= hold and whole.any():
                every = pd.concat(held)
                ends = (every[keys] == last).all(axis=1)
                yield from work(every[~ends].reset_index(drop=True))
                held, rows = [every[ends]], int(ends.sum())
        if rows:
            yield from work(pd.concat(held).reset_index(drop=True))

    return run


def bands_for(n: int, radius: int, shard_rows: int = 2_000) -> int:
    """The fewest runs of bits with which shards of ``n`` random fingerprints have ``shard_rows`` rows or fewer.

    More runs make smaller shards but more of them for each fingerprint: 5 do up to 14 million
    fingerprints, 6 up to 5 billion, 7 up to 350 billion (radius 4).
    """
    bands = radius + 1
    while n > shard_rows * 2 ** (64 * (bands - radius) // bands) and bands < radius + 4:
        bands += 1
    return bands


def link_fingerprints(prints: DataFrame, radius: int = 4, bands: int | None = None, shard_rows: int = 20_000) -> DataFrame:
    """``u, v``: links that connect all fingerprints within ``radius`` of each other.

    ``prints`` has one long column ``fp``, distinct. The 64 bits are cut into ``bands`` runs of
    which two fingerprints within ``radius`` share ``bands - radius`` at least, so each
    fingerprint goes to one shard for every choice of that many runs. A BK-tree is built over
    each shard and searched with its members, following only edges within the radius. A shard
    of over ``shard_rows`` rows is cut into blocks; the bounded tree of each block is sent to
    the query blocks of its shard, never to the whole cluster, so what is sent has a fixed
    size. Without ``bands`` their number follows the number of fingerprints (:func:`bands_for`).
    """
    if bands is None:
        bands = bands_for(prints.count(), radius)
    if bands <= radius:
        raise ValueError("bands must exceed radius")
    cuts = [64 * k // bands for k in range(bands + 1)]
    runs = [((1 << cuts[k + 1]) - (1 << cuts[k])) for k in range(bands)]
    masks = [sum(runs[k] for k in c) for c in combinations(range(bands), bands - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    shards = prints.select("fp", F.explode(keys).alias("s")).select("s.band", "s.key", "fp")
    large = shards.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows)
    large = stage(large.select("band", "key", F.ceil(F.col("n") / shard_rows).cast("int").alias("blocks")))
    # At most rows * shards / shard_rows rows; sent whole only while they are few.
    split = shards.join(F.broadcast(large) if large.count() <= 100_000 else large, ["band", "key"], "left")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    split = split.select("band", "key", "fp", F.coalesce("blocks", F.lit(1)).alias("blocks"), F.coalesce(block, F.lit(0)).alias("mine"))
    split = split.select("band", "key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    role = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    split = split.select("band", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), role.alias("role"), "fp")
    split = split.repartition("band", "key", "lo", "hi").sortWithinPartitions("band", "key", "lo", "hi", "fp")
    search = in_shards(["band", "key", "lo", "hi"], lambda pdf: [_shard_links(pdf, radius)], 200_000)
    return split.mapInPandas(search, "u long, v long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int, radius: int, bands: int | None) -> DataFrame:
    """``id, text_hash, fingerprint, component`` of every row."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prints = fingerprints(pdf["text"].tolist(), width, seed).view(np.int64)
            yield pdf[["id", "text_hash"]].assign(fingerprint=prints)

    text = column(docs, text_col)
    picked = docs.select(column(docs, id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    picked, id_kind = numbers_as_text(picked, "id")
    id_type = picked.schema["id"].dataType.simpleString()
    rows = picked.mapInPandas(measure, f"id {id_type}, text_hash long, fingerprint long")
    rows = stage(rows.withColumn("id", F.col("id").cast(id_kind)))
    return groups_by_links(rows, lambda prints: link_fingerprints(prints, radius, bands))


def groups_by_links(rows: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (``id, text_hash, fingerprint``) with ``root`` and ``component``; ``link`` makes links of the distinct ``fp``."""
    prints = stage(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("id").alias("low")))
    of = connected(link(prints.select("fp")))
    # the group of a fingerprint: itself, or the smallest fingerprint that it reaches
    member = prints.join(of.withColumnRenamed("node", "fp"), "fp", "left")
    member = stage(member.select("fp", "low", F.coalesce("component", "fp").alias("root")))
    name = stage(member.groupBy("root").agg(F.min("low").alias("component")))
    named = stage(member.join(name, "root").select(F.col("fp").alias("fingerprint"), "root", "component"))
    return rows.join(named, "fingerprint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, radius: int = 4, bands: int | None = None) -> DataFrame:
    """``id, fingerprint, component``: near-duplicate groups of whole texts.

    One row for every row of ``docs``; ``fingerprint`` is a long whose bits are the SimHash,
    ``component`` the smallest id that links of at most ``radius`` differing bits reach. Copies
    share a fingerprint and are searched once. Texts without words (null, empty) have
    fingerprint zero and link like any other; a null id stays null and names no group (a group
    of null ids alone has component null). Other columns of ``docs`` are not read.
    """
    return _grouped(docs, id_col, text_col, width, seed, radius, bands).select("id", "fingerprint", "component")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, radius: int = 4, bands: int | None = None) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id.

    All columns stay. Among rows with that id the smallest text hash decides, and of rows that
    agree in both one stays. A null id comes after all others.
    """
    return keep_first(docs, stage(_grouped(docs, id_col, text_col, width, seed, radius, bands)), id_col, text_col)


def keep_first(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of ``docs`` that stays for each ``root`` of ``rows``, as :func:`simhash_dedup` says."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first")
    id_name, hash_name = fresh(docs, "kept_id", "kept_hash")
    keep = rows.groupBy("root").agg(first).select(F.col("first.id").alias(id_name), F.col("first.text_hash").alias(hash_name))
    mine, hashed = column(docs, id_col), F.xxhash64(column(docs, text_col))
    kept = docs.join(keep, mine.eqNullSafe(F.col(id_name)) & (hashed == F.col(hash_name)), "left_semi")
    if not rows.groupBy("id", "text_hash").count().where("count > 1").isEmpty():
        (own,) = fresh(docs, "own_hash")
        kept = kept.withColumn(own, hashed).dropDuplicates([id_col, own]).drop(own)
    return kept
