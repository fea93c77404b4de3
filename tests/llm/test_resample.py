import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from veritide.llm import queries, resample

SF = "/root/testdata/sf0.01"


def grams(text, width=2):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(1, width + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, percent=25, min_words=20, seed=7):
    """doc_id, n_features, weight, score and rank of (doc_id, text) rows."""
    made = [grams(t) for _, t in rows]
    s, t = Counter(x for _, g in made for x in g), Counter(x for text in target for x in grams(text)[1])
    s_all, t_all = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out = []
    for k, ((d, _), (n, g)) in enumerate(zip(rows, made, strict=True)):
        weight = sum(math.floor(1000 * math.log((t[x] + 1) * s_all / ((s[x] + 1) * t_all))) for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n >= min_words, k])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for rank, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_matches_sql(spark):
    got = sorted((tuple(r) for r in queries.op12_importance_resample(spark, SF).collect()), key=str)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert got == sorted(con.execute(resample.resample_sql()).fetchall(), key=str)
    assert sum(r[4] is not None for r in got) > 200


def test_kernels():
    texts = [None, "", "--", "A b", " Éa É1 z\x00y", "a b a b a", "x" * 70_000, "é\x85z k\xa0b A"]
    for width in (1, 2, 3):
        got, each, n_words = resample.hashed_ngrams(pa.array(texts), width, 10_000)
        cut = np.split(got, np.cumsum(each)[:-1])
        assert [sorted(x.tolist()) for x in cut] == [sorted(grams(t, width)[1]) for t in texts] and n_words.tolist() == [grams(t)[0] for t in texts]
    assert resample.hashed_ngrams(pa.array([None, ""]), 2, 10)[1].tolist() == [0, 0]
    assert len(resample.hashed_ngrams(pa.array([], pa.string()), 2, 10)[0]) == 0


def test_edges(spark):
    some = [" ".join(f"w{(k * i) % 37}" for i in range(18 + k % 6)) for k in range(60)]
    rows = [(k, t) for k, t in enumerate(some)] + [(None, None), (None, ""), (7, some[7]), (7, some[7]), (2**60 + 1, some[3]), (2**60 + 3, some[3]), (90, "Long text " * 40_000)]
    rows += [(None, some[5])] * 40  # one score for all
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, SCORE int")
    target = spark.createDataFrame([(some[1],), (some[1],), (None,)], "text string")
    got = resample.importance_resample(docs, target)
    values = [(r.id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    assert sorted(values, key=str) == plain(rows, [some[1], some[1], None])
    assert resample.importance_resample(docs.limit(0), target).count() == 0
    assert resample.importance_resample(docs, target.limit(0)).count() == len(rows)
    drawn = resample.resampled(docs, target)
    assert drawn.columns == docs.columns and drawn.count() == sum(r["rank"] is not None for r in got.collect())
    other = resample.importance_resample(docs, target, percent=50, width=3, buckets=100_000, min_words=1, seed=9)
    assert other.where("rank is not null").count() == sum(grams(t)[0] >= 1 for _, t in rows) // 2
