import numpy as np
import pytest

from veritide.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = queries.op9_langid_cnn(spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.93
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(" ".join(np.random.default_rng(k).choice(w, 12)), own) for k in range(60) for own, w in (("aa", ["the", "and", "ing"]), ("bb", ["ü", "sch", "keit"]))]
    return langid.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_tables_equal_plain_convolution(model):
    x = np.random.default_rng(1).integers(1, 256, (5, langid.WINDOW)).astype(np.uint8)
    pooled = []
    for w, f, b in zip(langid.WIDTHS, model.filters, model.biases, strict=True):
        r = [sum(model.embed[x[:, i + j]] @ f[j] for j in range(w)) + b for i in range(langid.WINDOW - w + 1)]
        pooled.append(np.maximum(np.max(r, axis=0), 0))
    z = np.concatenate(pooled, axis=1) @ model.dense + model.bias
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert model.log_probs(x, model.tables()) == pytest.approx(want, abs=1e-3)


def test_edge_rows(spark, model):
    texts = [None, "", " \n", "12 34 !!", "the and", "sch keit ü " * 5000, "the and", "the and ing the"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "the and", None)], "doc_id long, text string, LANG string")
    got = langid.identify(docs, model).collect()
    assert [r.lang_pred for r in got] == ["und"] * 4 + ["aa", "bb", "aa", "aa", "aa"]
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.fit(docs.limit(0).withColumnRenamed("LANG", "lang")) is None
    with pytest.raises(ValueError):
        langid.identify(docs.withColumnRenamed("LANG", "Score"), model)


def test_a_rare_language_is_learnt(spark):
    words = {"aa": ["the", "and", "ing"], "bb": ["ü", "sch", "keit"], "cc": ["ñandú", "qx", "wzw"]}
    text = lambda own, k: " ".join(np.random.default_rng(k).choice(words[own], 12))
    rows = [(text(own, k), own) for own, n in (("aa", 900), ("bb", 900), ("cc", 4)) for k in range(n)]
    got = langid.fit(spark.createDataFrame(rows, "text string, lang string"), max_rows=60)
    assert got.labels == ["aa", "bb", "cc"]
    assert [own for own, _ in langid.predict(got, ["qx wzw ñandú qx wzw qx ñandú"])] == ["cc"]


def test_copies_and_hot_texts_do_not_crowd_out_others(spark):
    words = {"aa": ["the", "and", "ing"], "bb": ["ü", "sch", "keit"], "cc": ["ñandú", "qx", "wzw"]}
    text = lambda own, k: " ".join(np.random.default_rng(k).choice(words[own], 12))
    hot = [(text("aa", 7), "aa")] * 3000 + [(text("cc", k % 5), "cc") for k in range(2000)]
    rows = hot + [(text(own, k), own) for own in ("aa", "bb") for k in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = langid.fit(docs, max_rows=60)
    assert got.labels == ["aa", "bb", "cc"]
    other = langid.fit(docs.orderBy("text").repartition(7), max_rows=60)
    assert all(np.array_equal(a, b) for a, b in zip(got.filters, other.filters, strict=True)) and np.array_equal(got.dense, other.dense)


def test_network_runs_once_below_a_filter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = langid.identify(docs, langid.fit(docs, max_rows=50)).where("lang_pred <> 'und' and score >= 0.5")
    plan = kept.selectExpr("doc_id", "coalesce(lang, lang_pred) as lang")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
