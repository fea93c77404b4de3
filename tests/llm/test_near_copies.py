from collections import defaultdict

import corpus_pipeline
import numpy as np
import pandas as pd

from veritide.llm import near_copies, simhash

SF = "/root/testdata/sf0.01"


def plain_set(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_kept(rows, least=0.8):
    """Ids that stay and the links, over every pair of texts that share a shingle."""
    sets = {d: plain_set(t) for d, t in rows}
    holders, label = defaultdict(list), {d: d for d in sets}
    for d, s in sets.items():
        for x in s or {None}:
            holders[x].append(d)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    links = 0
    for pair in {(a, b) for own in holders.values() for a in own for b in own if a < b}:
        a, b = sets[pair[0]], sets[pair[1]]
        if a == b or len(a & b) >= least * len(a | b):
            links += a != b
            low, high = sorted(map(find, pair))
            label[high] = low
    return {d for d in sets if find(d) == d}, links


def test_stage_matches_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()]
    want, links = plain_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert links > 0 and sorted(got) == sorted(want)


def test_near_copies_beyond_four_bits_go(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 5000, 60)]
    other = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(60)]
    prints = simhash.fingerprints([" ".join(base), *other])
    far = [t for t, p in zip(other, prints[1:], strict=True) if np.bitwise_count(p ^ prints[0]) > 4 and near_copies.similarity(near_copies.shingle_set(t), near_copies.shingle_set(" ".join(base))) >= 0.8]
    half = " ".join(base[:40] + [f"x{k}" for k in range(20)])
    rows = [(9, " ".join(base), "a"), (3, far[0], "b"), (4, half, "c"), (5, None, "d"), (6, " ", "e"), (None, far[0], "f"), (7, "one", "g"), (7, "one", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, H string")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4, 5, 7]
    assert dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs.limit(0), SF).count() == 0


def test_large_bucket_is_linked(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base[:k], f"own{k}", *base[k + 1 :]]), "a") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r.doc_id for r in near_copies.near_copy_dedup(docs).collect()] == [0]


def test_groups_that_no_pivot_joins(spark):
    # a ring: each text is like its two neighbours only, so that pivots join few of them
    words = [f"w{k}" for k in range(900)]
    rows = [(k, " ".join(words[(10 * k + i) % 900] for i in range(200))) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain_kept(rows)[0] == {0}
    got = simhash.connected(near_copies.near_copy_links(docs, shard_rows=3))
    assert got.count() == 89 and got.select("component").distinct().count() == 1


def test_texts_of_one_template_propose_no_pairs(spark):
    # 155 of 200 words are the same in all, 45 are each text's own: a similarity of 0.63, so nothing is linked
    common = [f"w{k}" for k in range(155)]
    rows = [(k, " ".join([*common, *(f"own{k}x{i}" for i in range(45))])) for k in range(400)]
    rows += [(1000, rows[3][1] + " end"), (1001, rows[3][1] + " end here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in near_copies.near_copy_dedup(docs).collect())
    assert got == sorted(plain_kept(rows)[0]) == list(range(400))

    def sets(batches):
        for pdf in batches:
            yield pdf.assign(hashes=[near_copies.shingle_set(t).view(np.int64) for t in pdf.pop("text")])

    made = docs.selectExpr("doc_id as h", "doc_id as fp", "doc_id as root", "text").mapInPandas(sets, "h long, fp long, root long, hashes array<long>")
    assert near_copies._in_other_groups(near_copies.rare_shingles(made, 0.8), 64, 0.8, 20_000).count() <= 3


def test_links_come_from_the_trees_of_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 5000, 60)]
    texts = [" ".join(base), *(" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    named = {r.h: r.text for r in docs.selectExpr("xxhash64(text) as h", "text").collect()}
    sets = {h: near_copies.shingle_set(t) for h, t in named.items()}
    prints = dict(zip(sets, simhash.prints_of(list(sets.values())), strict=True))
    for radius in (4, 64):
        links = [(r.u, r.v) for r in near_copies.near_copy_links(docs, radius=radius).collect()]
        assert links and all(np.bitwise_count(prints[u] ^ prints[v]) <= radius and near_copies.similarity(sets[u], sets[v]) >= 0.8 for u, v in links)


def test_repeats_do_not_set_near_copies_apart(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(1, " ".join([one] * 9 + [two])), (2, " ".join([one] + [two] * 9)), (3, two)]
    assert plain_kept(rows)[0] == {1, 3}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.near_copy_dedup(docs).collect()) == [1, 3]


def test_near_copies_share_a_leading_shingle():
    rng = np.random.default_rng(5)
    for n in [0, 1, 2, 4, 5, 9, 10, 100, 333]:
        for _ in range(50):
            every = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            common = np.sort(rng.permutation(every)[: n // 2])
            held = rng.integers(1, 9, len(common))
            a, b = (every[np.sort(rng.permutation(n)[: n - rng.integers(0, n // 9 + 1)])] for _ in range(2))
            if near_copies.similarity(a, b) >= 0.8:
                assert np.intersect1d(near_copies.prefix_of(a, common, held, 0.8), near_copies.prefix_of(b, common, held, 0.8)).size


def proposed(monkeypatch, docs, **options):
    """The links of ``docs``, and how many pairs the whole trees propose after the edges at the roots."""
    found, whole = [], near_copies._in_other_groups
    with monkeypatch.context() as m:
        m.setattr(near_copies, "_in_other_groups", lambda *a: found.append(whole(*a).localCheckpoint()) or found[0])
        return near_copies.near_copy_links(docs, **options), found[0].count()


def test_passages_that_few_texts_hold_propose_no_pairs(spark, monkeypatch):
    # four passages that a hundred texts each hold, of which a handful of texts tells nothing
    monkeypatch.setattr(near_copies, "ORDER_TEXTS", 5)
    texts = [" ".join([*(f"own{k}x{i}" for i in range(45)), *(f"p{k % 4}x{i}" for i in range(15))]) for k in range(400)]
    links, pairs = proposed(monkeypatch, spark.createDataFrame([(t,) for t in texts], "text string"), radius=64)
    assert links.count() == 0 and pairs <= 400


def test_large_groups_are_joined_before_all_their_pairs_are_asked(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(200):
        words = [f"w{i}" for i in range(400)]
        for i in rng.permutation(400)[: rng.integers(2, 7)]:
            words[i] = f"own{k}x{i}"
        rows.append((k, " ".join(words)))
    want, links = plain_kept(rows)
    got, pairs = proposed(monkeypatch, spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(want) == 200 - simhash.connected(got).count() and links > 10_000 and pairs <= 1000


def test_a_pair_that_meets_in_many_shards_comes_once(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 1)
    one = pd.DataFrame({"h": [1, 2, 3], "fp": [0, 1, 3], "root": [1, 2, 3], "size": 9, "place": 1, "tree": True, "ask": [False, True, True], "block": 0})
    pdf = pd.concat([one.assign(key=k) for k in range(20)], ignore_index=True)
    got = pd.concat(near_copies._shard_pairs(pdf, 26, 0.8))
    assert sorted(got.itertuples(index=False, name=None)) == [(1, 2), (1, 3), (2, 3)]
