import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from veritide.llm import lm, queries

SF = "/root/testdata/sf0.01"


def test_matches_sql(spark):
    got = {r.doc_id: (r.n_words, r.log_sum, r.mean_log10) for r in queries.op7_lm_backoff(spark, SF).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(f"select doc_id, n_words, log_sum, mean_log10 from ({queries.ORACLES['op7_lm_backoff']})").fetchall()
    assert {d: n for d, (n, _, _) in got.items()} == {r[0]: r[1] for r in want}
    assert all(got[d][1] == pytest.approx(s, abs=2e-6) and got[d][2] == pytest.approx(m, abs=2e-6) for d, _, s, m in want)


def plain_scores(split):
    """The score of every text, from counts in dictionaries."""
    n = [Counter(tuple(s[i : i + k]) for s in split for i in range(len(s) - k + 1)) for k in (1, 2, 3)]
    total = sum(n[0].values())

    def share(s, i):
        for k in range(min(i, 2), 0, -1):
            gram = tuple(s[i - k : i + 1])
            if n[k][gram] >= 2:
                return 0.4 ** (min(i, 2) - k) * n[k][gram] / n[k - 1][gram[:-1]]
        return 0.4 ** min(i, 2) * n[0][s[i],] / total

    return [sum(math.log(share(s, i)) for i in range(len(s))) for s in split]


def test_edge_rows_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART_WORDS", 7)
    monkeypatch.setattr(lm, "BUCKET_GRAMS", 5)
    texts = ["a b a b c", "b a b", None, "", "a", "z q z q", "once only here", "a b a b c", "é a\x85b\xa0k", "a b " * 20_000]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(None, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, PART string")
    split = [(t or "").encode().split() for _, t, _ in rows]
    want = plain_scores(split)
    got = lm.lm_scores(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        k = len(texts) if r.id is None else r.id
        assert r.n_words == len(split[k]) and r.log_sum == pytest.approx(want[k])
        assert (r.mean_log10 is None) == (not split[k])
    assert lm.lm_scores(docs.limit(0)).count() == 0


def test_a_pair_in_every_document_and_words_that_occur_once(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART_WORDS", 50)
    texts = [f"of the own{k} word{k % 7} of the end" for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = plain_scores([t.encode().split() for t in texts])
    got = {r.id: r.log_sum for r in lm.lm_scores(docs.orderBy("doc_id")).collect()}
    assert got == {k: pytest.approx(w) for k, w in enumerate(want)}


def test_packed_numbers():
    for x in ([], [0], [0, 0], [1, 255, 256], [2**64 - 1, 3]):
        assert lm.unpacked(lm.packed(np.array(x, np.uint64))).tolist() == x


def test_counts_do_not_depend_on_the_size_of_the_corpus(spark):
    # over 2 * 2**20 words
    docs = spark.range(0, 2200, 1, 4).selectExpr("id", "array_join(transform(sequence(1, 1000), x -> concat('w', x % 500)), ' ') as text")
    docs = docs.unionByName(spark.createDataFrame([(9001, "rare pair"), (9002, "rare pair"), (9003, "other rest"), (9004, "other rest")], "id long, text string"))
    total = 2_200_000 + 8
    got = {r.id: r.log_sum for r in lm.lm_scores(docs, "id").where("id > 9000").collect()}
    assert got == {k: pytest.approx(math.log(2 / total)) for k in (9001, 9002, 9003, 9004)}  # the second word is sure
