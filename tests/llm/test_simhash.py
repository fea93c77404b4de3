import random

import numpy as np
import xxhash

from veritide.llm import queries, simhash
from veritide.llm.components import connected, label_pairs

SF = "/root/testdata/sf0.01"


def plain_print(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_groups(rows, radius=4):
    prints = np.array([f for _, f in rows], np.uint64)
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= radius):
            label[find(int(j))] = find(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return {d: low[find(i)] for i, (d, _) in enumerate(rows)}


def test_matches_brute_force(spark):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.op1_simhash_bktree(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, plain_print(r.text)) for r in docs]
    assert {d: f for d, (f, _) in got.items()} == dict(want)
    assert {d: c for d, (_, c) in got.items()} == plain_groups(want)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "  ", None), (4, "a b c d e", "x"), (4, "a b c d e", "y"), (5, "A B c D e", "y"), (None, "q r s t u v", "z"), (7, "one", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, FINGERPRINT string")
    got = [tuple(r) for r in simhash.simhash_groups(docs).collect()]
    assert len(got) == len(rows)
    assert {(i, c) for i, f, c in got if f == 0} == {(1, 1), (2, 1), (None, 1)}
    assert sorted(c for i, f, c in got if i in (4, 5)) == [4, 4, 4]
    kept = simhash.simhash_dedup(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 4), (False, 7), (True, 0)]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_blocks_of_large_shards(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(12)]
    prints = {b ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(5))) for b in base for _ in range(25)}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = plain_groups([(p, p) for p in sorted(prints)])
    for shard_rows in (20_000, 3):
        got = {r.node: r.component for r in connected(simhash.link_fingerprints(df, 4, 5, shard_rows)).collect()}
        assert {p: got.get(p, p) for p in prints} == want


def test_components_of_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1000), (None, 3), (500, 501)], "u long, v long")
    got = {r.node: r.component for r in connected(links).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 501: 500}
    assert label_pairs(4, np.array([3]), np.array([1])).tolist() == [0, 1, 2, 1]


def test_bands_follow_the_number_of_fingerprints(spark):
    assert [simhash.bands_for(n, 4) for n in (0, 10**6, 10**8, 10**10)] == [5, 5, 6, 7]
    rng = random.Random(6)
    base = [rng.getrandbits(63) for _ in range(40)]
    prints = {b ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(5))) for b in base for _ in range(10)}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = plain_groups([(p, p) for p in sorted(prints)])
    for bands in (6, 7):
        got = {r.node: r.component for r in connected(simhash.link_fingerprints(df, 4, bands)).collect()}
        assert {p: got.get(p, p) for p in prints} == want


def test_dense_shard_keeps_no_pairs():
    import pandas as pd

    rng = np.random.default_rng(8)
    flips = rng.integers(0, 64, (3000, 2)).astype(np.uint64)
    prints = np.unique(np.uint64(0x123456789ABCDEF0) ^ (np.uint64(1) << flips[:, 0]) ^ (np.uint64(1) << flips[:, 1]))
    pdf = pd.DataFrame({"band": 0, "key": 0, "lo": 0, "hi": 0, "role": 0, "fp": prints.view(np.int64)})
    got = simhash._shard_links(pdf, 4)
    assert len(got) == len(prints) - 1 and got["v"].nunique() == 1
