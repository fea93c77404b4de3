"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, keyed_rows, stage
from .components import connected, label_pairs

#: Leading principal dimensions of the grid and of the bounding boxes.
GRID_DIMS, BOX_DIMS = 4, 12

#: Least and most rows of a block, rows of the smallest interval that a task joins, children of a tree node.
BLOCK_ROWS, MOST_ROWS, LEAF_ROWS, FAN = 2048, 32_768, 512, 8

#: Bytes of a block's vectors in double precision at most, however long they are: a task holds two blocks and their copies.
MOST_BYTES = 32 << 20

#: Pairs that are summed in double precision at a time.
STEP = 65_536


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their length, in double precision."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _box_gap(lo_a, hi_a, lo_b, hi_b) -> float:
    """The squared distance of two boxes."""
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(gap @ gap)


def join_intervals(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, floor: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of unit ``x`` and ``y`` with cosine ``floor`` or more (``same``: i < j), ``STEP`` at a time at most.

    Both are in grid order; intervals are halved until they are small, and pairs of intervals
    whose boxes over the leading principal dimensions (``px``, ``py``) are further apart than
    linked vectors can be are skipped. In small intervals single precision proposes pairs, with
    more room than its rounding needs; sums in double precision decide.
    """
    reach = 2 * (1 - floor) + 1e-9
    room = 1e-6 + 2.4e-7 * x.shape[1] if x.ndim == 2 else 0.0
    x32, y32 = x.astype(np.float32), y.astype(np.float32)

    def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        cos = np.einsum("ij,ij->i", x[i], y[j])
        for k in np.flatnonzero(np.abs(cos - floor) < 1e-9):  # at the limit: the exact sum decides
            cos[k] = np.dot(x[i[k]], y[j[k]])
        return cos >= floor

    def join(a: int, b: int, c: int, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if same and c < a:
            return
        if not (same and (a, b) == (c, d)):
            if _box_gap(px[a:b].min(0), px[a:b].max(0), py[c:d].min(0), py[c:d].max(0)) > reach:
                return
        if b - a <= LEAF_ROWS and d - c <= LEAF_ROWS:
            i, j = np.nonzero(x32[a:b] @ y32[c:d].T >= np.float32(floor - room))
            i, j = i + a, j + c
            if same and a == c:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), STEP):
                keep = linked(i[at : at + STEP], j[at : at + STEP])
                if keep.any():
                    yield i[at : at + STEP][keep], j[at : at + STEP][keep]
            return
        halves = lambda s, e: [(s, e)] if e - s <= LEAF_ROWS else [(s, (s + e) // 2), ((s + e) // 2, e)]
        for s, e in halves(a, b):
            for u, v in halves(c, d):
                yield from join(s, e, u, v)

    yield from join(0, len(x), 0, len(y))


def folded(x: list[np.ndarray], ns: list[np.ndarray], p: list[np.ndarray], floor: float) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each row of one or two blocks is linked with (``ns``: those a row stands for), and the labels of
    the groups. Pairs are counted as they come and never kept, so a dense cluster takes no more room than its rows."""
    same, first = len(x) == 1, len(x[0])
    n = np.concatenate(ns)
    links, label = np.zeros(len(n), np.int64), np.arange(len(n))
    for i, j in join_intervals(x[0], x[-1], p[0], p[-1], floor, same):
        j = j if same else j + first
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        label_pairs(len(n), i, j, label)
    return links, label


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """(dim, k) leading principal axes of the unit vectors in column ``v``; sums are made in tasks."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(dim), np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                x = unit_rows(np.stack(pdf["v"].to_list()))
                n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tobytes()], "q": [q.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(dim), np.zeros((dim, dim))
        for pdf in batches:
            for k, a, b in pdf.itertuples(index=False):
                n, s, q = n + k, s + np.frombuffer(a), q + np.frombuffer(b).reshape(dim, dim)
        yield pd.DataFrame({"n": [n], "s": [s.tobytes()], "q": [q.tobytes()]})

    schema = "n long, s binary, q binary"
    parts = vectors.select("v").mapInPandas(sums, schema).repartition(8).mapInPandas(add, schema).collect()  # 8 rows
    n = max(1, sum(p.n for p in parts))
    mean = sum(np.frombuffer(p.s) for p in parts) / n
    cov = sum(np.frombuffer(p.q).reshape(dim, dim) for p in parts) / n - np.outer(mean, mean)
    return np.linalg.eigh((cov + cov.T) / 2)[1][:, ::-1][:, : min(dim, BOX_DIMS)]


def _link_classes(classes: DataFrame, dim: int, floor: float) -> DataFrame:
    """``cid, links, root``: linked vectors of each class and a star of links, per joined pair of blocks."""
    axes = principal_axes(classes, dim)
    k = axes.shape[1]
    grid = min(GRID_DIMS, k)
    side = float(np.sqrt(2 * (1 - floor)))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = unit_rows(np.stack(pdf["v"].to_list())) @ axes if len(pdf) else np.zeros((0, k))
            at = np.floor(p[:, :grid] / side).astype(np.int32)
            yield pd.DataFrame({"cell": list(at), "cid": pdf["cid"], "n": pdf["n"], "v": pdf["v"]})

    total = classes.count()
    size = max(1, min(MOST_BYTES // (8 * dim), max(BLOCK_ROWS, min(MOST_ROWS, -(-total // 8)))))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, number = [], 0, 0

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal number
            raw = np.stack(pdf["v"].to_list())
            p = unit_rows(raw) @ axes
            out = {"part": 0, "number": number, "cids": pdf["cid"].to_numpy(np.int64).tobytes(), "ns": pdf["n"].to_numpy(np.int64).tobytes(), "vs": raw.astype(np.float64).tobytes() if raw.dtype != np.float32 else raw.tobytes(), "single": raw.dtype == np.float32, "lo": p.min(axis=0), "hi": p.max(axis=0)}
            number += 1
            return pd.DataFrame([out])

        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            while rows >= size:
                every = pd.concat(held)
                yield pack(every[:size])
                held, rows = [every[size:]], rows - size
        if rows:
            yield pack(pd.concat(held))

    kind = classes.schema["v"].dataType.simpleString()
    celled = classes.mapInPandas(cells, f"cell array<int>, cid long, n long, v {kind}")
    parts = max(1, -(-total // (4 * size)))
    keys = [F.col("cell")[i].alias(f"g{i}") for i in range(grid)]
    order = [f"g{i}" for i in range(grid)]
    ordered = celled.select(*keys, "cid", "n", "v").repartitionByRange(parts, *order, "cid").sortWithinPartitions(*order, "cid")
    packed = ordered.select("cid", "n", "v").mapInPandas(blocks, "part int, number int, cids binary, ns binary, vs binary, single boolean, lo array<double>, hi array<double>")
    packed = stage(packed.withColumn("part", F.spark_partition_id()))
    wide = 1 + (packed.agg(F.max("number")).first()[0] or 0)
    packed = packed.withColumn("seq", F.col("part").cast("long") * wide + F.col("number")).drop("part", "number")

    boxes = packed.select("seq", "lo", "hi")
    levels, top = [stage(boxes)], parts * wide
    while top > 1:
        low = [F.min(F.col("lo")[i]).alias(f"l{i}") for i in range(k)]
        high = [F.max(F.col("hi")[i]).alias(f"h{i}") for i in range(k)]
        up = levels[-1].groupBy(F.floor(F.col("seq") / FAN).alias("seq")).agg(*low, *high)
        levels.append(stage(up.select("seq", F.array(*[f"l{i}" for i in range(k)]).alias("lo"), F.array(*[f"h{i}" for i in range(k)]).alias("hi"))))
        top = -(-top // FAN)
    gap = F.expr(f"aggregate(sequence(0, {k - 1}), 0D, (s, i) -> s + power(greatest(0D, a_lo[i] - b_hi[i], b_lo[i] - a_hi[i]), 2))")
    pairs = levels.pop().select(F.col("seq").alias("a"), F.col("seq").alias("b"))
    while levels:
        nodes = levels.pop()
        one = nodes.select(F.col("seq").alias("a_seq"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.floor(F.col("seq") / FAN).alias("a"))
        two = nodes.select(F.col("seq").alias("b_seq"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), F.floor(F.col("seq") / FAN).alias("b"))
        pairs = pairs.join(one, "a").join(two, "b").where((F.col("a_seq") == F.col("b_seq")) | ((F.col("a_seq") < F.col("b_seq")) & (gap <= 2 * (1 - floor) + 1e-9)))
        pairs = stage(pairs.select(F.col("a_seq").alias("a"), F.col("b_seq").alias("b")))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        x, cids, ns, p = [], [], [], []
        for row in pdf.sort_values("seq").itertuples(index=False):
            v = np.frombuffer(row.vs, np.float32 if row.single else np.float64).reshape(-1, dim)
            x.append(unit_rows(v))
            cids.append(np.frombuffer(row.cids, np.int64))
            ns.append(np.frombuffer(row.ns, np.int64))
            p.append(x[-1] @ axes)
        cid = np.concatenate(cids)
        links, label = folded(x, ns, p, floor)
        hit = links > 0
        return pd.DataFrame({"cid": cid[hit], "links": links[hit], "root": cid[label[hit]]})

    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("seq")).join(packed.drop("lo", "hi"), "seq")
    return sides.groupBy("a", "b").applyInPandas(join, "cid long, links long, root long")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", floor: float = 0.95) -> DataFrame:
    """``id, n_links, component, kept`` of every row: links are cosines of ``floor`` or more.

    Equal vectors are one class that is joined once. Classes are sorted by grid cells of the
    side of the largest distance of linked unit vectors, on the leading principal axes, and cut
    into blocks; a tree of bounding boxes over the sequence is joined with itself from the root
    down, and pairs of nodes that are provably too far apart are skipped. A block has an eighth
    of the classes, ``MOST_ROWS`` and ``MOST_BYTES`` at most, since each is sent once for each block that it meets:
    where boxes exclude little, as on nearly isotropic vectors, that is the square of the number
    of blocks. ``n_links`` counts
    the other rows that a row is linked with, ``component`` is the smallest id that links reach.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    and vectors of different lengths do not link. Null ids are kept and name no component;
    repeated rows are rows like any other; other columns are not read.
    """
    rows = keyed_rows(vectors, id_col, vector_col)
    finite = F.forall("c1", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.coalesce(finite & F.exists("c1", lambda x: x != 0), F.lit(False))
    rows = rows.select("uid", F.col("c0").alias("id"), F.when(valid, F.col("c1")).alias("v"))
    hashes = F.struct(F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.reverse("v")).alias("h2"))
    keyed = rows.select("id", "v", F.when(F.col("v").isNotNull(), hashes).alias("h"))
    members = stage(keyed.select("id", "h"))
    classes = keyed.where("h is not null").groupBy("h").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("cid"), "h", "low", "n", "v", F.size("v").alias("dim")))
    found = None
    for (dim,) in classes.select("dim").distinct().orderBy("dim").collect():
        part = _link_classes(classes.where(F.col("dim") == dim).select("cid", "n", "v"), dim, floor)
        found = part if found is None else found.unionByName(part)
    spark = vectors.sparkSession
    found = stage(found) if found is not None else spark.createDataFrame([], "cid long, links long, root long")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    of = connected(found.select(F.col("cid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "cid")
    known = classes.select("cid", "h", "low", "n").join(links, "cid", "left").join(of, "cid", "left")
    known = stage(known.select("h", "low", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("root")))
    name = stage(known.groupBy("root").agg(F.min("low").alias("component")))
    known = stage(known.join(name, "root").select("h", "component", (F.col("links") + F.col("n") - 1).alias("n_links")))
    out = members.join(known, "h", "left")
    component = F.when(F.col("h").isNull(), F.col("id")).otherwise(F.col("component"))
    out = out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
