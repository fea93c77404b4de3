import hashlib

import corpus_pipeline
import pytest

from tests.llm.plain_pii import rewrite_with
from tests.llm.test_near_copies import plain_kept
from veritide.llm import bpe, langid, mixing, queries

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    named = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "pseudonyms", "source_mix", "tokens"]

    first = named["language"](spark, docs, SF).cache()
    rows = docs.collect()
    said = dict(zip([r.doc_id for r in rows], langid.predict(langid.fit(docs), [r.text for r in rows]), strict=True))
    assert {r.doc_id for r in first.collect()} == {d for d, (own, p) in said.items() if own != "und" and p >= 0.5}
    assert first.columns == docs.columns and first.count() > 0.95 * docs.count()

    second = named["near_duplicates"](spark, first, SF).cache()
    assert {r.doc_id for r in second.collect()} == plain_kept([(r.doc_id, r.text) for r in first.collect()])[0]

    third = named["pseudonyms"](spark, second, SF).cache()
    before = {r.doc_id: r.text for r in second.collect()}
    assert {r.doc_id: r.text for r in third.collect()} == {d: rewrite_with(corpus_pipeline.KEY, t) for d, t in before.items()}

    fourth = named["source_mix"](spark, third, SF).cache()
    taken = {r.id: r.taken for r in mixing.mix_sizes(third).collect() if r.taken}
    words = {}
    for r in fourth.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert words == taken and fourth.columns == docs.columns

    last = named["tokens"](spark, fourth, SF).collect()
    c = bpe.codec(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), len(c.encode(r.text))) for r in fourth.collect())
    assert sorted((r.doc_id, r.decoded_sha256, r.n_tokens) for r in last) == want

    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in whole) == sorted((r.doc_id, r.ids_sha256) for r in last)
    assert "op9_langid_cnn" in queries.QUERIES


def test_edge_rows(spark):
    named = dict(corpus_pipeline.STAGES)
    english = "the and ing that was for with this have from they which one you were"
    rows = [(1, english, "en", "a", 1, "x"), (2, None, None, None, None, None), (3, "", "en", "a", 0, "x"), (None, english + " more", None, None, None, None)]
    rows += [(1, english, "en", "a", 1, "y"), (5, "12 34 " * 9, "en", "b", 3, "x"), (6, (english + " call 743-555-3824 ") * 3000, "de", "b", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, PIPELINE_LANG string")
    out = docs
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), SF).count() == 0
        out = f(spark, out, SF)
        assert name == "tokens" or out.columns == docs.columns
        out = out.cache()
    kept = {r.doc_id for r in out.collect()}
    assert kept >= {1, 6} and not kept & {2, 3, 5}
    with pytest.raises(ValueError):
        named["language"](spark, docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars"), SF)
    assert named["pseudonyms"](spark, docs.drop("n_chars"), SF).columns == docs.drop("n_chars").columns
