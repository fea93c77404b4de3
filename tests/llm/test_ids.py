"""Ids come back as they were: long ones beside a null, decimals and strings."""

from decimal import Decimal

import public_tokenizers
import pytest

from veritide.llm import bpe, exact, lexical, lm, quality, resample, simhash, substrings

TEXTS = ["one two three four five six", "seven eight nine ten eleven twelve", "other words than these stand here"]
BIG = [2**60 + 1, None, 2**60 + 3]


@pytest.mark.parametrize(
    "run",
    [
        simhash.simhash_groups,
        lambda d: bpe.bpe_encode(d, public_tokenizers.path("byte_bpe_50k.json")),
        quality.quality,
        substrings.repeated_passages,
        lm.lm_scores,
        exact.exact_groups,
        lambda d: resample.importance_resample(d, d),
        lambda d: lexical.build_index(d).search(d.selectExpr("doc_id as item_id", "text"), 1),
    ],
    ids=["simhash", "bpe", "quality", "substrings", "lm", "exact", "resample", "lexical"],
)
def test_ids_survive(spark, run):
    for kind, ids in (("long", BIG), ("string", ["a", None, "9007199254740993.0"]), ("decimal(30,2)", [Decimal("1152921504606846977.25"), None, Decimal("3.10")])):
        docs = spark.createDataFrame(list(zip(ids, TEXTS, ["s"] * 3, strict=True)), f"doc_id {kind}, text string, source string").coalesce(1)
        got = run(docs)
        assert got.schema["id"].dataType == docs.schema["doc_id"].dataType
        assert sorted((r.id for r in got.collect()), key=str) == sorted(ids, key=str)
