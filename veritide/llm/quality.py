"""Quality rules: base measures of a text, and lines that too many documents of a host share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, keyed_rows, numbers_as_text, stage

WORDS = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
DIGITS = re.compile("[0-9]+")
#: A-Z in lower case, nothing else.
LOWER = {c: c + 32 for c in range(65, 91)}


def normalise(line: str) -> str:
    """A line in lower case (A-Z), runs of digits as 0, words joined by one space."""
    return DIGITS.sub("0", " ".join(WORDS.findall(line)).translate(LOWER))


def repeated_words(words: list[str], width: int = 3) -> int:
    """The words in windows of ``width`` words that occur twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, width):
        # numbers of the distinct windows so far, so that keys stay small for any text
        key = np.unique(key, return_inverse=True)[1] * len(number) + ids[k : n + k]
    _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[where] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + width, -1)
    return int((np.cumsum(covered) > 0).sum())


def measure(text: str | None) -> tuple:
    """(words, code points in words, symbols, repeated lines, repeated words, line hashes, words of each).

    A line is a ``\\n``-split part with a word. The hashes are of distinct normalised lines; the
    words of equal ones are added up.
    """
    if not isinstance(text, str) or not text:
        return 0, 0, 0, 0, 0, [], []
    words = WORDS.findall(text)
    seen: set[str] = set()
    again, lines = 0, {}
    for line in text.split("\n"):
        n = len(WORDS.findall(line))
        if n:
            again += line in seen
            seen.add(line)
            h = xxhash.xxh64_intdigest(normalise(line).encode("utf-8", "surrogatepass"))
            lines[h] = lines.get(h, 0) + n
    hashes = np.array(list(lines), np.uint64).view(np.int64).tolist()
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), again, repeated_words(words), hashes, list(lines.values())


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 10, min_words: int = 50, min_left: float = 0.3) -> DataFrame:
    """``id``, the base measures, ``base_failed``, ``left_words`` and ``kept`` of every row.

    A line is removed if, within its host, more than ``min_docs`` distinct texts hold it once
    normalised, however large the host is; copies of a text count once, so that being copied
    does not make a text boilerplate. A document is kept if the base rules
    pass and the lines that are left hold ``min_words`` words and ``min_left`` of all its words.

    A null or empty text has no words and fails; a null host is a host of its own; null ids and
    repeated rows are rows like any other; texts and lines of any length are read whole; other
    columns are not read; an empty table gives an empty one.
    """
    rows = keyed_rows(docs, id_col, text_col, host_col)
    rows, id_kind = numbers_as_text(rows, "c0")
    id_type = rows.schema["c0"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = pd.DataFrame([measure(t) for t in pdf["c1"]], columns=[*NAMES, "lines", "line_words"])
            yield pd.concat([pdf[["uid", "c0", "host", "text_hash"]].reset_index(drop=True), got], axis=1)

    host = F.coalesce(F.concat(F.lit("h"), F.col("c2").cast("string")), F.lit("n")).alias("host")
    picked = rows.select("uid", "c0", "c1", host, F.xxhash64("c1").alias("text_hash"))
    longs = ", ".join(f"{n} long" for n in NAMES)
    all_rows = stage(picked.mapInPandas(run, f"uid long, c0 {id_type}, host string, text_hash long, {longs}, lines array<long>, line_words array<long>"))

    texts = all_rows.where("n_words > 0").select("host", "text_hash", "lines").dropDuplicates(["host", "text_hash"])
    shared = texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    over = stage(shared.where(F.col("n") > min_docs).select("host", "line"))
    pairs = all_rows.select("uid", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    pairs = pairs.select("uid", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    # The table of removed lines grows with the corpus; sent whole only while it is small.
    hit = pairs.join(F.broadcast(over) if over.count() <= 50_000 else over, ["host", "line"])
    gone = hit.groupBy("uid").agg(F.sum("words").alias("gone"))
    out = all_rows.drop("lines", "line_words").join(gone, "uid", "left").withColumn("left_words", F.col("n_words") - F.coalesce("gone", F.lit(0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("left_words") >= min_words) & (F.col("left_words") >= min_left * F.col("n_words"))
    return out.select(F.col("c0").cast(id_kind).alias("id"), *NAMES, failed.alias("base_failed"), "left_words", kept.alias("kept"))


def quality_sql(min_docs: int = 10, min_words: int = 50, min_left: float = 0.3) -> str:
    """DuckDB SQL for the rows of :func:`quality` over ``documents``, hosts being sources."""
    word = "'[^\\x20\\x09-\\x0D]+'"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    normal = f"regexp_replace({lower.format(f'''array_to_string(regexp_extract_all(line, {word}), ' ')''')}, '[0-9]+', '0', 'g')"
    return f"""
with d as (select row_number() over () as uid, doc_id, coalesce('h' || source, 'n') as host, coalesce(text, '') as text,
  regexp_extract_all(coalesce(text, ''), {word}) as w from documents),
l0 as (select uid, host, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from d),
l as (select *, len(regexp_extract_all(line, {word})) as words, {normal} as normal from l0 where regexp_matches(line, {word})),
dup as (select uid, sum(n - 1) as n_dup_lines from (select uid, line, count(*) as n from l group by uid, line) group by uid),
t as (select uid, unnest(range(1, len(w) - 1)) as i, w from d where len(w) >= 3),
t2 as (select uid, i, count(*) over (partition by uid, w[i], w[i + 1], w[i + 2]) as n from t),
rep as (select uid, count(distinct i + o) as n_repeat_words from t2, (select unnest([0, 1, 2]) as o) where n > 1 group by uid),
over_ as (select host, normal from l group by host, normal having count(distinct text) > {min_docs}),
gone as (select uid, sum(words) as gone from l join over_ using (host, normal) group by uid),
m as (select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words, (len(w) - coalesce(gone, 0))::bigint as left_words
  from d left join dup using (uid) left join rep using (uid) left join gone using (uid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select *, not base_failed and left_words >= {min_words} and left_words >= {min_left} * n_words as kept from b
"""
