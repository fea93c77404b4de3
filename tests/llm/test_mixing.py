import duckdb
import pytest
from pyspark.sql import functions as F

from veritide.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by handing out the excess again and again."""
    w = {s: weights[k % len(weights)] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    full, left, out = set(), float(sum(sizes.values())), {}
    while True:
        free = {s: w[s] for s in sizes if s not in full}
        out = {s: left * w[s] / sum(free.values()) for s in free} if free else {}
        over = {s for s in out if out[s] > cap * sizes[s] + 1e-9}
        if not over:
            return out | {s: cap * sizes[s] for s in full}
        full |= over
        left -= sum(cap * sizes[s] for s in over)


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).select("id", F.lit(n).cast("long").alias("n"), F.lit(9).cast("long").alias("k"))
        got = sorted(r.place for r in mixing.permuted(df, "id", "n", "k", "place").collect())
        assert got == list(range(n))


def test_matches_sql_and_targets(spark):
    got = sorted(tuple(r) for r in queries.op2_mix_sources(spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    names = "doc_id, size, source_size, target, taken, shards"
    want = sorted(con.execute(f"select {names} from ({mixing.mix_sql()})").fetchall())
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert all(r[4] <= 3 * r[1] and r[5] <= r[4] for r in got)
    # many shards: the counts of each are drawn
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = "doc_id, taken, shards"
    want = sorted(con.execute(f"select {names} from ({mixing.mix_sql(block=32, shard_slots=200)})").fetchall())
    got = sorted(tuple(r) for r in mixing.mix_sizes(docs, block=32, shard_slots=200).selectExpr("id", "taken", "shards").collect())
    assert got == want and max(r[2] for r in got) > 3


def test_edge_rows_and_mixed_texts(spark):
    rows = [(i, f"w{i} " * 40, s, 0) for i, s in enumerate(["a"] * 8 + ["b", None, "c"])]
    rows += [(100, None, "a", 0), (100, "", "z", 0), (None, "x y z", "a", 0), (3, "w3 " * 40, "a", 0), (3, "w3 " * 40, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, SIZE int")
    got = mixing.mix_sizes(docs, block=16).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and sizes[r.source] <= r.source_size
    assert target == pytest.approx(fill(sizes))
    assert all(abs(taken[s] - target[s]) <= 32 for s in sizes)
    mixed = mixing.mix_documents(docs, block=16).collect()
    words = {}
    for r in mixed:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    want = {}
    for r in got:
        want[r.id] = want.get(r.id, 0) + r.taken
    assert words == {k: v for k, v in want.items() if v}
    assert mixed[0].__fields__ == docs.columns
    assert mixing.mix_sizes(docs.limit(0)).count() == 0
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_shard_counts_are_multinomial_draws(spark):
    docs = spark.createDataFrame([(i, "a b c " * 50, f"s{i % 5}") for i in range(400)] + [(1000, "x y", "t")], "doc_id long, text string, source string")
    m = mixing.mix(docs, block=8, shard_slots=100)
    rows = m.shards.collect()
    draws = {r.key: r.draws for r in m.sources.collect() if r.draws}
    total = sum(draws.values())
    by_key, by_shard = {}, {}
    for r in rows:
        by_key[r.key] = by_key.get(r.key, 0) + r.slots
        by_shard[r.shard] = by_shard.get(r.shard, 0) + r.slots
    assert by_key == draws and len(by_shard) == -(-total // 100)
    # the draws of every slot, again in plain Python
    spans, at = [], 0
    for r in sorted(m.sources.collect(), key=lambda r: r.number):
        spans.append((at, at + r.draws, r.key))
        at += r.draws

    def mixed(v, key, r):
        h = ((v % mixing.P) * mixing.A1 + key % mixing.P + r * 7919) % mixing.P
        return ((h * h % mixing.P) * mixing.A2 + r * 104729 + 12345) % mixing.P

    want = {}
    for slot in range(total):
        v = (mixed(slot, 42, 31) * mixing.P + mixed(slot, 42, 32)) % total
        key = next(k for a, b, k in spans if a <= v < b)
        want[slot // 100, key] = want.get((slot // 100, key), 0) + 1
    assert {(r.shard, r.key): r.drawn for r in rows if r.drawn} == want
    # chi-square of the draws against the shares of the sources: near its degrees of freedom
    main = [k for k in draws if draws[k] * 100 / total >= 5]
    chi = sum((want.get((s, k), 0) - draws[k] * 100 / total) ** 2 / (draws[k] * 100 / total) for s in range(total // 100) for k in main)
    free = (total // 100) * (len(main) - 1)
    assert 0.7 * free < chi < 1.3 * free
    assert max(abs(r.slots - r.drawn) for r in rows if r.drawn) <= 6


def test_equal_ids_and_other_columns(spark):
    rows = [(None, "w " * 60, "a", "en")] * 300 + [(None, "w " * 60, "a", "fr")] * 20 + [(7, "v " * 60, "a", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.mix_sizes(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    mixed = mixing.mix_documents(docs, block=16).collect()
    words = {}
    for r in mixed:
        words[r.lang] = words.get(r.lang, 0) + len(r.text.split())
    assert set(words) == {"en", "fr", "de"} and abs(sum(words.values()) - 321 * 60) <= 16
