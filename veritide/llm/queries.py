"""One query for each corpus operator, over the whole table it is meant for."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.shipping import ship

from . import bpe, embeddings, exact, langid, lexical, lm, mixing, pii, quality, resample, simhash, substrings, toxicity

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str, *args, **options) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir, *args, **options)

    QUERIES[f.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the group that links of at most 4 differing bits make."""
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix at weights 5, 2, 1 takes."""
    return mixing.mix_sizes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "shards")


ORACLES["op2_mix_sources"] = mixing.mix_sql()


@query
def op3_bpe_chunks(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token counts and digests of the ids and the decoded text of every document."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), path, keep_ids=False).withColumnRenamed("id", "doc_id")


def remainder(id_col: str, n: int):
    """crc32 of an id as text, modulo ``n``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


@query
def op9_langid_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; a fifth of the ids is held out of training."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(remainder("doc_id", 5) != 0))
    held_out = (remainder("doc_id", 5) == 0).alias("held_out")
    return langid.identify(docs.select("doc_id", "text", held_out), model).drop("text")


#: Key of the registered queries; a user passes a secret one.
PSEUDONYM_KEY = "example key of the registered queries"


@query
def op10_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with personal data replaced by pseudonyms, and the kinds found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PSEUDONYM_KEY, kinds_col="kinds")


@query
def op4_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document, and whether it is kept once its host's shared lines are gone."""
    return quality.quality(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLES["op4_quality_lines"] = quality.quality_sql()


@query
def op5_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document; a third of the ids is held out of training."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    third = remainder("doc_id", 3)
    model = toxicity.fit(docs.where(third != 1), labels.where(third != 1))
    rows = docs.select("doc_id", "text", (third == 1).alias("held_out"))
    scored = toxicity.score(rows, model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query
def op8_embedding_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 or more among all vectors, and the components they make."""
    groups = embeddings.embedding_groups(table(spark, sf_dir, "embeddings"))
    return groups.withColumnsRenamed({"id": "vec_id", "component": "component_id"})


ORACLES["op8_embedding_ego"] = """
with recursive e as (select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select vec_id, v, sqrt(list_dot_product(v, v)) as n from e where list_dot_product(v, v) > 0),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id
  and list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as low from r group by a),
k as (select a, count(*) as n from l group by a)
select vec_id, coalesce(k.n, 0)::bigint as n_links, least(vec_id, coalesce(low, vec_id)) as component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) as kept
from embeddings left join c on vec_id = c.a left join k on vec_id = k.a
"""


@query
def op6_substring_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one holds."""
    return substrings.repeated_passages(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op7_lm_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's stupid-backoff score under words, pairs and triples of the whole corpus."""
    scores = lm.lm_scores(table(spark, sf_dir, "documents"))
    # sums of logarithms depend on their order in the last digits
    return scores.select(F.col("id").alias("doc_id"), "n_words", F.round("log_sum", 6).alias("log_sum"), F.round("mean_log10", 6).alias("mean_log10"))


ORACLES["op7_lm_backoff"] = """
with d as (select row_number() over () as uid, doc_id,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
p as (select uid, unnest(range(1, len(w) + 1)) as i, w from d),
o as (select uid, i, w[i] as c, case when i > 1 then w[i - 1] end as b, case when i > 2 then w[i - 2] end as a from p),
n as (select count(*) as total from o),
n1 as (select c, count(*) as n from o group by c),
n2 as (select b, c, count(*) as n from o where b is not null group by b, c),
n3 as (select a, b, c, count(*) as n from o where a is not null group by a, b, c),
s as (select uid, ln(case when n3.n >= 2 then n3.n / p2.n
    when n2.n >= 2 then n2.n / p1.n * case when o.a is null then 1 else 0.4 end
    else n1.n / total * case when o.b is null then 1 when o.a is null then 0.4 else 0.4 * 0.4 end end) as x
  from o join n1 on o.c = n1.c
  left join n2 on o.b = n2.b and o.c = n2.c
  left join n1 p1 on o.b = p1.c
  left join n3 on o.a = n3.a and o.b = n3.b and o.c = n3.c
  left join n2 p2 on o.a = p2.b and o.b = p2.c, n)
select doc_id, len(w)::bigint as n_words, round(coalesce(sum(x), 0), 6) as log_sum, round(sum(x) / len(w) / ln(10), 6) as mean_log10
from d left join s using (uid) group by uid, doc_id, w
"""


@query
def op13_exact_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts; the row with the largest id stays."""
    groups = exact.exact_groups(table(spark, sf_dir, "documents"), keep="largest")
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


ORACLES["op13_exact_sort"] = exact.exact_sql()


@query
def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and scores of every document towards the benchmark's texts, and the rank of those drawn."""
    got = resample.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


ORACLES["op12_importance_resample"] = resample.resample_sql()


@query
def op11_stratified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each item of the benchmark."""
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    return index.search(table(spark, sf_dir, "benchmark"), 50).select("item_id", "rank", F.col("id").alias("doc_id"), "score")


ORACLES["op11_stratified_search"] = lexical.search_sql()
