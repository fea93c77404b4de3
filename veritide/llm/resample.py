"""Importance resampling towards a target text distribution, over hashed n-grams.

Arrow kernels cut the texts into words and number them; shifted numbers make n-grams, whose CRC is
taken once for each distinct one of a batch. Counts, scores and ranks are made on Spark.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, drop_staged, fresh, keyed_rows, small_batches, stage
from .words import binaries, dictionary_words, numbers

#: Texts that are cut into words at a time.
BATCH = 1000


def hashed_ngrams(texts: pa.Array, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``width`` words, text by text; how many each text has, and how many words."""
    words, codes, owner = dictionary_words(texts)
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    spaced = [b" " + w for w in words]
    at, gram = np.arange(len(codes)), codes.astype(np.int64)  # where a run begins, and its number in `crc`
    found, owners = [crc[gram]], [owner]
    for more in range(1, width):
        stays = at + more < len(codes)
        stays[stays] = owner[at[stays]] == owner[at[stays] + more]
        at, gram = at[stays], gram[stays]
        pairs, gram = np.unique(gram * max(len(words), 1) + codes[at + more], return_inverse=True)
        ahead, last = pairs // max(len(words), 1), pairs % max(len(words), 1)
        crc = np.fromiter((zlib.crc32(spaced[w], c) for w, c in zip(last.tolist(), crc[ahead].tolist(), strict=True)), np.uint32, len(pairs))
        found.append(crc[gram])
        owners.append(owner[at])
    owner_of = np.concatenate(owners)
    order = np.argsort(owner_of, kind="stable")
    each = np.bincount(owner_of, minlength=len(texts))
    return (np.concatenate(found) % np.uint32(buckets))[order], each, np.bincount(owner, minlength=len(texts))


def _hashed(docs: DataFrame, id_col: str, text_col: str, width: int, buckets: int) -> DataFrame:
    """``uid, id, n_words, grams`` of every row; ``grams`` packs the buckets of its n-grams."""
    rows = keyed_rows(docs, id_col, text_col).select("uid", F.col("c0").alias("id"), F.col("c1").cast("string").alias("text"))
    small = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, each, n_words = hashed_ngrams(b.column("text"), width, buckets)
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("id"), pa.array(n_words, pa.int64()), binaries(grams.astype(small), each)], ["uid", "id", "n_words", "grams"])

    with small_batches(docs.sparkSession, BATCH):
        return stage(rows.mapInArrow(run, f"uid long, id {rows.schema['id'].dataType.simpleString()}, n_words long, grams binary"))


def bucket_counts(hashed: DataFrame, buckets: int) -> np.ndarray:
    """How many n-grams each bucket has; a task sums up its own, so that ``buckets`` rows of it at most are shuffled."""
    small = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            n += np.bincount(numbers(b.column("grams"), small)[0], minlength=buckets)
        (some,) = n.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in hashed.select("grams").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of the ratio of a bucket's smoothed shares, as floored integers."""
    more = len(source)
    t_all, s_all = float(target.sum() + more), float(source.sum() + more)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def importance_resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = 25, width: int = 2, buckets: int = 10_000, min_words: int = 20, seed: int = 7
) -> DataFrame:
    """``uid, id, n_features, weight, score, rank`` of every row; ``rank`` is null if it is not drawn.

    A row's weight is the floored mean gain of its n-grams, its score the weight and Gumbel noise
    (times 1000) that ``seed`` and the id fix, so that the highest scores are a draw without
    replacement in proportion to the weights' exponentials. Of the rows with ``min_words`` words
    or more ``percent`` per cent are drawn; equal scores rank by id (null last), then by row.

    A null or empty text has no n-grams and weight 0; texts of any length are read whole; a null
    id is the empty text in the noise; repeated rows share a score and rank one after another;
    other columns are not read; an empty table gives an empty one; an empty target has no counts.
    """
    hashed = _hashed(docs, id_col, text_col, width, buckets)
    wanted = _hashed(target.select(column(target, target_col).alias("text"), F.lit(0).alias("id")), "id", "text", width, buckets)
    table = pa.array(gains(bucket_counts(wanted, buckets), bucket_counts(hashed, buckets)))
    drop_staged(wanted)
    small = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, each = numbers(b.column("grams"), small)
            worth = np.zeros(len(each), np.int64)
            if len(grams):
                some = each > 0
                starts = (np.cumsum(each) - each)[some]
                worth[some] = np.add.reduceat(pc.take(table, pa.array(grams)).to_numpy(), starts) // each[some]
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("id"), b.column("n_words"), pa.array(each, pa.int64()), pa.array(worth)], ["uid", "id", "n_words", "n_features", "weight"])

    id_type = hashed.schema["id"].dataType.simpleString()
    with small_batches(docs.sparkSession, BATCH):
        weighed = hashed.mapInArrow(run, f"uid long, id {id_type}, n_words long, n_features long, weight long")
        label = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
        h = F.conv(F.substring(F.sha2(label, 256), 1, 8), 16, 10).cast("double")
        noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
        fit = (F.col("n_words") >= min_words).alias("fit")
        scored = stage(weighed.select("uid", "id", "n_features", "weight", (F.col("weight") + noise).alias("score"), fit))
    drop_staged(hashed)
    # Ranges of one order over all rows: those that can be drawn come first.
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("uid")]
    ranged = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stage(ranged.withColumn("at", F.monotonically_increasing_id()))  # the range, then 33 bits of place in it
    part = F.shiftright("at", 33).alias("part")
    sizes = ranged.groupBy(part).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    starts = sizes.select(F.col("part").alias("range"), F.coalesce(before, F.lit(0)).alias("start"))
    quota = ranged.where("fit").count() * percent // 100
    ranked = ranged.join(F.broadcast(starts), part == F.col("range"))
    rank = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return ranked.select("uid", "id", "n_features", "weight", "score", F.when(F.col("fit") & (rank <= quota), rank).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`importance_resample` draws; all columns stay."""
    (uid,) = fresh(docs, "uid")
    drawn = importance_resample(docs, target, id_col, text_col, **options).where("rank is not null").select(F.col("uid").alias(uid))
    numbered = docs.select(F.monotonically_increasing_id().alias(uid), *[column(docs, c) for c in docs.columns])
    return numbered.join(drawn, uid, "left_semi").drop(uid)


def _crc_step(k: int) -> int:
    for _ in range(8):
        k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
    return k


def resample_sql() -> str:
    """DuckDB SQL for ``op12_importance_resample``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    steps = ", ".join(str(_crc_step(k)) for k in range(256))
    return f"""
with d as (select row_number() over () as uid, doc_id, {words} as w from documents),
b as (select {words} as w from benchmark),
df as (select uid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from d),
bf as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from b),
u as (select f, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::bigint) as bytes,
  [{steps}]::bigint[] as steps from (select f from df union select f from bf)),
c as (select f, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as k from u),
s as (select k, count(*) as n from df join c using (f) group by k),
t as (select k, count(*) as n from bf join c using (f) group by k),
g as (select k, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double
    / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double)))::bigint as gain
  from (select unnest(range(10000)) as k) left join s using (k) left join t using (k)),
m as (select uid, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from df join c using (f) join g using (k) group by uid),
r as (select doc_id, uid, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  ('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from d left join m using (uid)),
q as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from r),
o as (select *, case when n_words >= 20 then row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last, uid) end as place,
  count(*) filter (n_words >= 20) over () as fit from q)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score,
  case when place <= 25 * fit // 100 then place end as rank from o
"""
