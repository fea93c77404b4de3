import math
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from veritide.llm import lexical, queries

SF = "/root/testdata/sf0.01"


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, items, k):
    """(item id, rank, doc id, score) over every document."""
    docs = [(d, terms(t), Counter(terms(t))) for d, t in rows]
    docs = [x for x in docs if x[1]]
    n_all, l_all = len(docs), sum(len(w) for _, w, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for place, (d, w, c) in enumerate(docs):
            m = 100 - 50 + (50 * len(w) * n_all) // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, place, d))
        out += [(item, r, x[4], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def collected(df):
    return sorted(((r.item_id, r["rank"], r.id, r.score) for r in df.collect()), key=str)


def test_matches_sql(spark):
    got = sorted(tuple(r) for r in queries.op11_stratified_search(spark, SF).collect())
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert got == sorted(con.execute(lexical.search_sql()).fetchall()) and len(got) > 1000


def test_brute_force_and_edges(spark, monkeypatch):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"W{x}" for x in rng.zipf(1.4, n) % 200)
    rows = [(int(k), text(int(n))) for k, n in enumerate(rng.integers(1, 60, 300))]
    rows += [(None, rows[0][1]), (None, None), (500, ""), (501, "-- !"), (7, rows[7][1]), (7, rows[7][1]), (2**60 + 1, text(9)), (2**60 + 3, "é w1"), (800, text(30_000))]
    rows += [(1000 + k, "w1 w2 w3 same length") for k in range(400)]  # ties; a stratum that holds over half of all
    items = [(1, "w1 w2 w3 W1"), (2, None), (3, ""), (4, "nowhere"), (5, text(80)), (5, "é"), (None, "w5 w6"), (6, text(400))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, M int").repartition(5, "doc_id").cache()
    asked = spark.createDataFrame(items, "item_id long, text string").coalesce(1).cache()
    order = [(r.doc_id, r.text) for r in docs.collect()]
    index = lexical.build_index(docs)
    assert collected(index.search(asked, 50)) == plain(order, items, 50)
    assert collected(index.search(asked, 3)) == plain(order, items, 3)
    monkeypatch.setattr(lexical, "QUERY_TERMS", 100)  # several groups of items
    monkeypatch.setattr(lexical, "FIRST_STRATA", 1)
    assert collected(index.search(asked, 10)) == plain(order, items, 10)
    assert index.search(asked.limit(0), 5).count() == 0
    assert lexical.build_index(docs.limit(0)).search(asked, 5).count() == 0


def test_blocks_are_skipped_only_below_what_is_asked():
    texts = pa.array(["a b", "a a", "b c", "c d"])
    hashes, tfs, each, n = lexical.term_counts(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(range(4), pa.int64()), lexical.binaries(hashes, each), lexical.binaries(tfs, each)], ["uid", "id", "terms", "tfs"])
    row = lexical._block(100, batch).to_pylist()[0]
    block = lexical.Block(row, pa.array(row["ids"]))
    asked = np.sort(lexical.term_counts(pa.array(["a b"]))[0])
    q = lexical.Queries(np.array([9]), asked, np.array([0, 0]), np.array([0, 1]), np.array([10, 10]))
    _, place, score = lexical.score_block(block, q, np.array([0]), 2)
    one, two = 10**9 // 3000, 2 * 10**9 // 4000
    assert place.tolist() == [0, 1] and score.tolist() == [20 * one, 10 * two]
    assert len(lexical.score_block(block, q, np.array([10 * (one + two) + 1]), 2)[0]) == 0
    assert lexical.score_block(block, q, np.array([10 * two]), 5)[1].tolist() == [0, 1]
    assert len(lexical.score_block(block, q, np.array([-1]), 5)[0]) == 0
    heavy = lexical.Queries(q.uids, q.terms, q.item, q.term, np.array([1 << 40, 1 << 40]))  # beyond exact doubles
    assert lexical.score_block(block, heavy, np.array([0]), 1)[2].tolist() == [2 * one << 40]


def test_scoring_a_block_takes_little_memory():
    # every item reaches every document of a full block: 4,000 x 1,000 scores above 0, with ties
    n_docs, n_items, k = 1000, 4000, 50
    texts = pa.array([" ".join(["a", "b"] * (1 + d % 7) + [f"own{d}"]) for d in range(n_docs)])
    hashes, tfs, each, _ = lexical.term_counts(texts)
    uids = pa.array(range(n_docs), pa.int64())
    batch = pa.RecordBatch.from_arrays([uids, uids, lexical.binaries(hashes, each), lexical.binaries(tfs, each)], ["uid", "id", "terms", "tfs"])
    row = lexical._block(100, batch).to_pylist()[0]
    block = lexical.Block(row, pa.array(row["ids"]))
    asked = np.sort(lexical.term_counts(pa.array(["a b"]))[0])
    q = lexical.Queries(np.arange(n_items), asked, np.tile(np.arange(n_items), 2), np.repeat([0, 1], n_items), np.full(2 * n_items, 10))
    tracemalloc.start()
    item, place, score = lexical.score_block(block, q, np.zeros(n_items, np.int64), k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    order = sorted(range(n_docs), key=lambda d: (-(d % 7), d))[:k]
    assert item.tolist() == [i for i in range(n_items) for _ in range(k)] and place.reshape(n_items, k).tolist() == [order] * n_items
    tf = 1 + np.array(order) % 7
    assert (score.reshape(n_items, k) == 20 * ((10**9 * tf) // (1000 * tf + 2000))).all()
