"""A corpus pipeline over the operators in ``veritide.llm``.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read
again as the next stage's input. All stages but the last return the columns of their input. In
all of them null ids, sources and languages are values like any other, texts of any length are
read whole, an empty table gives an empty one, and extra columns go through untouched, whatever
their names.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.llm import bpe, langid, mixing, near_copies, pii
from veritide.llm.common import drop_staged, fresh, scratch, small_batches, stage
from veritide.shipping import ship

#: A language is accepted from this probability on.
LEAST_SCORE = 0.5

#: Example key; a deployment passes its own.
KEY = "example key of the pipeline"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter or a clear language go; a missing language is filled in.

    Null and empty texts have no letter and go; repeated rows have equal fates. Rows of which
    none has a text and a language cannot be told apart: that raises instead of dropping all.
    """
    model = langid.fit(docs)
    if model is None:
        if docs.isEmpty():
            return docs
        raise ValueError("no labelled text to learn languages from")
    lang, score = fresh(docs, "pipeline_lang", "pipeline_score")
    marked = langid.identify(docs, model, lang_out=lang, score_out=score)
    kept = marked.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE))
    with small_batches(spark):  # whole texts make large batches; how many rows one has is settled where it runs
        return stage(kept.withColumn("lang", F.coalesce("lang", lang)).select(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 0.8 of their 5-word shingles one stays: the one with the smallest id.

    Texts without words (null, empty) are one group. Of rows that agree in id and text one stays;
    of several texts with the smallest id the one with the smallest hash; null ids come last.
    """
    return near_copies.near_copy_dedup(docs, width=5, least=0.8)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to pseudonyms; lengths follow.

    Every row stays; null texts stay null, repeated rows stay equal.
    """
    out = pii.pseudonymise(docs, KEY)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that a mix of the sources at weights 5, 2, 1 takes, a row for each pass.

    Null and empty texts have no words to take and go; repeated rows are separate documents.
    """
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number and digests of the ids and of what they decode to.

    A row for each row; a null text counts as empty.
    """
    return bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def shipped(f):
    """The stage, once the executors have this package."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, docs, sf_dir)

    return run


STAGES = [(f.__name__, shipped(f)) for f in (language, near_duplicates, pseudonyms, source_mix, tokens)]

#: The first stage holds a trained network; SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, apply) in enumerate(STAGES[:-1]):
        with scratch() as made:
            out = apply(spark, docs, sf_dir)
            out = out if any(out is df for df in made) else stage(out)
            made[:] = [df for df in made if df is not out]
        if k:
            drop_staged(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
