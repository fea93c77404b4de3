"""Ranked lexical search over an index whose strata are documents of equal length normaliser.

Within a stratum the score of a posting depends on its tf alone, so postings lie by tf, the impact
of each tf is computed once, and the largest tf of a term bounds what the stratum can score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, keyed_rows, small_batches, stage
from .words import binaries, dictionary_words, numbers

#: Texts that are cut into terms at a time.
BATCH = 1000

#: Documents and postings of a block of the index at most (a document of more postings is a block of its own).
BLOCK_DOCS, BLOCK_POSTINGS = 1000, 500_000

#: Documents that an item's first strata hold together at least, times k, and how many strata those are at most.
FIRST_DOCS, FIRST_STRATA = 20, 16

#: Pairs of an item and a term that are searched for, and so sent to all tasks, at a time.
QUERY_TERMS = 200_000

#: Cells of items and documents that are scored at a time, postings that are expanded for them at a time (a single list may be longer).
CELLS, POSTINGS = 500_000, 250_000

#: Scores below this are exact as doubles.
EXACT = 1 << 53


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct terms, their tf, how many there are, and all terms with repeats."""
    words, codes, owner = dictionary_words(texts)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(len(words), 1)
    pairs, tf = np.unique(owner.astype(np.int64) * n + codes, return_counts=True)
    own = np.bincount(pairs // n, minlength=len(texts)) if len(pairs) else np.zeros(len(texts), np.int64)
    return hashes[pairs % n], tf.astype(np.uint32), own, np.bincount(owner, minlength=len(texts))


def _with_terms(rows: DataFrame) -> DataFrame:
    """``uid, id, n, terms, tfs`` of every row (``uid, id, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, tfs, each, n = term_counts(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("id"), pa.array(n, pa.int64()), binaries(terms, each), binaries(tfs, each)], ["uid", "id", "n", "terms", "tfs"])

    with small_batches(rows.sparkSession, BATCH):
        return stage(rows.mapInArrow(run, f"uid long, id {rows.schema['id'].dataType.simpleString()}, n long, terms binary, tfs binary"))


def _block(m: int, b: pa.RecordBatch) -> pa.RecordBatch:
    """A row of the index for documents of equal ``m``: postings by term, tf and place."""
    terms, each = numbers(b.column("terms"), np.uint64)
    tfs, place = numbers(b.column("tfs"), np.uint32)[0], np.repeat(np.arange(b.num_rows, dtype=np.uint32), each)
    values, code = np.unique(tfs, return_inverse=True)
    order = np.lexsort((place, code, terms))
    held, starts = np.unique(terms[order], return_index=True)
    small = np.uint8 if len(values) <= 256 else np.uint32
    where = np.uint16 if b.num_rows <= 1 << 16 else np.uint32
    packed = [held, starts.astype(np.uint32), place[order].astype(where), values.astype(np.uint32), code[order].astype(small)]
    ids = b.column("id")
    columns = [pa.array([m], pa.int64()), pa.array([b.num_rows], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
    columns += [pa.array([x.tobytes()], pa.binary()) for x in (b.column("uid").to_numpy(), *packed)]
    return pa.RecordBatch.from_arrays(columns, ["m", "n_docs", "ids", *PACKED])


PACKED = ["uids", "terms", "starts", "places", "tf_values", "tf_codes"]


class Block:
    """A row of the index, unpacked."""

    def __init__(self, row: dict, ids: pa.Array | None = None):
        self.m, self.n_docs, self.ids = row["m"], row["n_docs"], ids
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.tf_values = np.frombuffer(row["tf_values"], np.uint32).astype(np.int64)
        self.codes = np.frombuffer(row["tf_codes"], np.uint8 if len(self.tf_values) <= 256 else np.uint32)
        self.starts = np.append(np.frombuffer(row["starts"], np.uint32).astype(np.int64), len(self.codes))
        if ids is not None:
            self.uids = np.frombuffer(row["uids"], np.int64)
            self.places = np.frombuffer(row["places"], np.uint16 if self.n_docs <= 1 << 16 else np.uint32)

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``terms`` that the block holds (positions in ``terms`` and in the block)."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        (held,) = np.nonzero(self.terms[at] == terms) if len(self.terms) else (np.zeros(0, np.int64),)
        return held, at[held]

    def counts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many documents hold the block's terms ``at``, and their largest tf."""
        return self.starts[at + 1] - self.starts[at], self.tf_values[self.codes[self.starts[at + 1] - 1]]

    def impacts(self) -> np.ndarray:
        """The impact of each tf of the block."""
        return (1_000_000_000 * self.tf_values) // (1000 * self.tf_values + 20 * self.m)


@dataclass
class Queries:
    """Items and the terms they ask for: ``item`` and ``term`` number the ends of each pair, by term."""

    uids: np.ndarray
    terms: np.ndarray
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def __post_init__(self):
        self.first = np.searchsorted(self.term, np.arange(len(self.terms) + 1))


def score_block(block: Block, q: Queries, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items, places and scores of the block's ``k`` best documents for each item that can reach ``least``.

    ``least`` is the score an item asks for at least, negative if the block is not to be visited
    for it. Equal scores go by place.
    """
    none = np.zeros(0, np.int64)
    held, at = block.find(q.terms)
    if not len(held):
        return none, none, none
    df, most = block.counts(at)
    # the pairs of an item and a term that the block holds
    many = q.first[held + 1] - q.first[held]
    pair = np.repeat(q.first[held] - np.cumsum(many) + many, many) + np.arange(many.sum())
    own = np.repeat(np.arange(len(held)), many)
    item, weight = q.item[pair], q.weight[pair]
    bound = np.zeros(len(q.uids), np.int64)
    np.add.at(bound, item, weight * ((1_000_000_000 * most) // (1000 * most + 20 * block.m))[own])
    visit = (bound >= np.maximum(least, 1)) & (least >= 0)
    keep = visit[item]
    item, weight, own = item[keep], weight[keep], own[keep]
    if not len(item):
        return none, none, none
    items, item = np.unique(item, return_inverse=True)
    impact = block.impacts()[block.codes]
    # Dense scores of as many items at a time as fit a fixed size.
    out, step = [], max(1, CELLS // block.n_docs)
    order = np.argsort(item, kind="stable")
    item, weight, own = item[order], weight[order], own[order]
    for low in range(0, len(items), step):
        a, b = np.searchsorted(item, [low, low + step])
        some = min(step, len(items) - low)
        if bound[items[low : low + some]].max() < EXACT:
            dense = np.zeros(some * block.n_docs)
        else:
            dense = np.zeros(some * block.n_docs, np.int64)
        # Postings in slices, so that what is expanded has a fixed size but for a single list.
        size = df[own[a:b]]
        cuts = np.searchsorted(np.cumsum(size), np.arange(POSTINGS, size.sum() + POSTINGS, POSTINGS)) if len(size) else []
        begin = a
        for end in [*(a + np.asarray(cuts, np.int64) + 1), b]:
            end = min(int(end), b)
            if begin >= end:
                continue
            n = df[own[begin:end]]
            post = np.repeat(block.starts[at[own[begin:end]]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cell = np.repeat((item[begin:end] - low) * block.n_docs, n) + block.places[post]
            add = np.repeat(weight[begin:end], n) * impact[post]
            if dense.dtype == np.float64:
                dense += np.bincount(cell, add, len(dense))
            else:
                np.add.at(dense, cell, add)
            begin = end
        scores = dense.astype(np.int64).reshape(some, block.n_docs)
        asked = np.maximum(least[items[low : low + some]], 1)
        if block.n_docs > k:  # no more than the k best and their ties are sorted
            asked = np.maximum(asked, np.partition(scores, block.n_docs - k, axis=1)[:, block.n_docs - k])
        hit_item, hit_place = np.nonzero(scores >= asked[:, None])
        hit = scores[hit_item, hit_place]
        best = np.lexsort((hit_place, -hit, hit_item))
        hit_item, hit_place, hit = hit_item[best], hit_place[best], hit[best]
        rank = np.arange(len(hit)) - np.searchsorted(hit_item, hit_item)
        out.append((items[low + hit_item[rank < k]], hit_place[rank < k], hit[rank < k]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class LexicalIndex:
    """Blocks of postings of all documents by stratum, and the counts that scores rest on."""

    blocks: DataFrame
    n_docs: int
    n_terms: int

    def _group(self, items: DataFrame) -> tuple[Queries, DataFrame]:
        """The terms of some items with their weights, and the strata's bounds (``item, m, bound, n``)."""
        rows = items.select("uid", "terms").toPandas()  # QUERY_TERMS pairs or so, or a single item
        sets = [np.frombuffer(t, np.uint64) for t in rows["terms"]]
        terms, term = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
        item = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(term, kind="stable")
        item, term = item[order], term[order]

        def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    held, at = (block := Block(row)).find(terms)
                    df, most = block.counts(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), block.m)), pa.array(held), pa.array(df), pa.array(most)], ["m", "term", "df", "most"])

        with small_batches(items.sparkSession, 1):  # a block takes megabytes
            found = self.blocks.drop("ids", "uids", "places").mapInArrow(lookup, "m long, term long, df long, most long")
            found = stage(found.groupBy("m", "term").agg(F.sum("df").alias("df"), F.max("most").alias("most")))
        weight = np.zeros(len(terms), np.int64)
        for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each term asked for
            weight[r.term] = math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * r.df + 1)))
        spark = items.sparkSession
        pairs = pa.table({"term": term.astype(np.int64), "item": item.astype(np.int64), "weight": weight[term]})
        asked = spark.createDataFrame(pairs) if len(item) else spark.createDataFrame([], "term long, item long, weight long")
        impact = F.expr("(1000000000 * most) div (1000 * most + 20 * m)")
        bounds = found.join(F.broadcast(asked), "term").groupBy("item", "m").agg(F.sum(F.col("weight") * impact).alias("bound"))
        sizes = self.blocks.groupBy("m").agg(F.sum("n_docs").alias("n"))
        return Queries(rows["uid"].to_numpy(np.int64), terms, item, term, weight[term]), bounds.join(sizes, "m")

    def _visit(self, blocks: DataFrame, q: Queries, k: int, least: np.ndarray, first: dict[int, list[int]], again: bool) -> DataFrame:
        """``item, score, uid, id``: candidates of the first strata of each item, or of all others that can reach ``least``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row, ids in zip(b.select(["m", "n_docs", *PACKED]).to_pylist(), b.column("ids"), strict=True):
                    block = Block(row, ids.values)
                    own = first.get(block.m, [])
                    asked = least.copy() if again else np.full(len(least), -1)
                    asked[own] = -1 if again else least[own]
                    item, place, score = score_block(block, q, asked, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q.uids[item]), pa.array(score), pa.array(block.uids[place]), block.ids.take(pa.array(place))], ["item", "score", "uid", "id"])

        id_type = blocks.schema["ids"].dataType.elementType.simpleString()
        with small_batches(blocks.sparkSession, 1):
            return stage(blocks.mapInArrow(run, f"item long, score long, uid long, id {id_type}"))

    def search(self, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """``item_uid, item_id, rank, id, score``: the ``k`` best documents for each item, with scores above 0.

        Items are searched for in groups of bounded size. An item first visits the strata that
        can score highest; the score of its k-th document there is what any further block must
        be able to reach. Equal scores rank by id (null last), then by row. Null and empty items
        have no terms and no rows; repeated items are items of their own.
        """
        rows = keyed_rows(items, id_col, text_col).select("uid", F.col("c0").alias("id"), F.col("c1").cast("string").alias("text"))
        asked = _with_terms(rows)
        pairs = asked.agg(F.sum(F.length("terms") / 8)).first()[0] or 0
        groups = max(1, math.ceil(pairs / QUERY_TERMS))
        found = None
        for g in range(groups):
            part = self._search(asked.where(F.pmod(F.xxhash64("uid"), F.lit(groups)) == g), k)
            found = part if found is None else found.unionByName(part)
        names = asked.select(F.col("uid").alias("item"), F.col("id").alias("item_id"))
        return found.join(names, "item").select(F.col("item").alias("item_uid"), "item_id", "rank", "id", "score")

    def _search(self, items: DataFrame, k: int) -> DataFrame:
        q, bounds = self._group(items)
        best = Window.partitionBy("item").orderBy(F.col("bound").desc(), "m")
        before = F.coalesce(F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        leading = bounds.select("item", "m", F.row_number().over(best).alias("place"), before.alias("before"))
        first: dict[int, list[int]] = {}
        for r in leading.where((F.col("place") <= FIRST_STRATA) & (F.col("before") < FIRST_DOCS * k)).collect():  # FIRST_STRATA rows an item
            first.setdefault(r.m, []).append(r.item)
        least = np.zeros(len(q.uids), np.int64)
        one = self._visit(self.blocks.where(F.col("m").isin(list(first))), q, k, least, first, False)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "uid")
        numbered = {u: i for i, u in enumerate(q.uids.tolist())}
        for r in one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).collect():  # a row an item
            least[numbered[r["item"]]] = r.score
        two = self._visit(self.blocks, q, k, least, first, True)
        return one.unionByName(two).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
    """An index of all terms of all rows of ``docs``.

    Terms are runs of ASCII letters and digits and of other than ASCII characters, A-Z in lower
    case, told apart by a 64-bit hash. Documents of equal normaliser
    ``m = 100 - 50 + (50 * n * N) div L`` are a stratum; ranges of (m, id) deal them out, so
    that a stratum of many documents is many blocks in many tasks.

    Null and empty texts have no terms and are in no stratum; texts of any length are read
    whole; repeated rows and null ids are documents like any other; other columns are not read;
    an empty table gives an index without blocks. ``docs`` must give the same rows in the same
    partitions each time it is evaluated, as stored tables do.
    """
    rows = keyed_rows(docs, id_col, text_col).select("uid", F.col("c0").alias("id"), F.col("c1").cast("string").alias("text"))
    made = _with_terms(rows)
    n_docs, n_terms = made.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.expr(f"100 - 50 + ((50 * n * {n_docs}L) div {max(n_terms, 1)}L)")
    order = ["m", F.col("id").asc_nulls_last(), "uid"]
    dealt = made.where("n > 0").withColumn("m", m).repartitionByRange(*order).sortWithinPartitions(*order).select("uid", "id", "m", "terms", "tfs")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        m, n_rows, n_posts = None, 0, 0

        def block() -> pa.RecordBatch:
            return _block(m, pa.Table.from_batches(held).combine_chunks().to_batches()[0])

        for b in batches:
            sizes = numbers(b.column("terms"), np.uint64)[1].tolist()
            low = 0
            for k, (own, size) in enumerate(zip(b.column("m").to_pylist(), sizes, strict=True)):
                if n_rows and (own != m or n_rows == BLOCK_DOCS or n_posts + size > BLOCK_POSTINGS):
                    held += [b.slice(low, k - low)] if k > low else []
                    yield block()
                    held, low, n_rows, n_posts = [], k, 0, 0
                m, n_rows, n_posts = own, n_rows + 1, n_posts + size
            held += [b.slice(low)] if b.num_rows > low else []
        if n_rows:
            yield block()

    id_type = made.schema["id"].dataType.simpleString()
    with small_batches(docs.sparkSession, BATCH // 5):
        blocks = stage(dealt.mapInArrow(pack, f"m long, n_docs int, ids array<{id_type}>, " + ", ".join(f"{c} binary" for c in PACKED)))
    drop_staged(made)
    return LexicalIndex(blocks, n_docs, n_terms)


def search_sql() -> str:
    """DuckDB SQL for ``op11_stratified_search``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with d as (select row_number() over () as uid, doc_id, {terms} as w from documents),
s as (select count(*) as nn, sum(len(w)) as ll from d where len(w) > 0),
m as (select uid, doc_id, 50 + (50 * len(w) * nn) // ll as m from d, s where len(w) > 0),
b as (select row_number() over () as q, item_id, list_distinct({terms}) as w from benchmark),
a as (select q, unnest(w) as term from b),
p as (select uid, term, count(*) as tf from (select uid, unnest(w) as term from d) group by uid, term),
f as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from p, s group by term, nn),
x as (select q, uid, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score, any_value(doc_id) as doc_id
  from a join f using (term) join p using (term) join m using (uid) group by q, uid),
r as (select q, doc_id, score, row_number() over (partition by q order by score desc, doc_id nulls last, uid) as rank from x where score > 0)
select item_id, rank::int as rank, doc_id, score from r join b using (q) where rank <= 50
"""
