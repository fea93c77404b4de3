"""Stupid-backoff scores from n-gram counts of the whole corpus.

The n-grams of the corpus are exploded, counted in tables that are partitioned by hash, joined back
to where they occur and summed per document. A row of these tables holds n-grams of one part of the
corpus and one bucket of hashes, packed: a row for each n-gram and document would shuffle several
times the bytes (figures in the README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, column, numbers_as_text, stage

#: Words of a part of the corpus, whose n-grams are counted before they are shuffled, and n-grams of a bucket.
PART_WORDS, BUCKET_GRAMS = 1_250_000, 3_000_000

CELL = "part long, bucket int, width int, grams binary, times binary"
SUMMED = "part long, bucket int, width int, totals binary"


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each number."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def packed(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, as many as the largest one needs, compressed."""
    x = np.ascontiguousarray(x, dtype=np.uint64)
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + len(x).to_bytes(5, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(data: bytes) -> np.ndarray:
    """The numbers of :func:`packed`, unsigned."""
    width, n = data[0], int.from_bytes(data[1:6], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[6:], max_output_size=width * n), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.reshape(width, n).T
    return out.view(np.uint64).ravel()


def _cells(part: int, width: int, grams: np.ndarray, times: np.ndarray, n_buckets: int) -> pd.DataFrame:
    """A part's distinct n-grams (ascending) and how often it holds them, a row for each bucket of hashes."""
    bucket = ((grams >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    ends = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))
    rows = []
    for b in np.flatnonzero(np.diff(ends)):
        own = grams[ends[b] : ends[b + 1]]
        rows.append((part, int(b), width, own[:1].tobytes() + packed(np.diff(own)), packed(times[ends[b] : ends[b + 1]])))
    return pd.DataFrame(rows, columns=["part", "bucket", "width", "grams", "times"])


def _of_cell(data: bytes) -> np.ndarray:
    first = np.frombuffer(data[:8], np.uint64)
    return np.cumsum(np.concatenate([first, unpacked(data[8:])]), dtype=np.uint64)


def _sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: the corpus totals of each cell's n-grams."""
    cells = [_of_cell(a) for a in pdf["grams"]]
    distinct, where = np.unique(np.concatenate(cells), return_inverse=True)
    total = np.bincount(where, np.concatenate([unpacked(a) for a in pdf["times"]]), len(distinct)).astype(np.uint64)
    totals = [packed(t) for t in np.split(total[where], np.cumsum([len(c) for c in cells])[:-1])]
    return pd.DataFrame({"part": pdf["part"], "bucket": pdf["bucket"], "width": pdf["width"], "totals": totals})


def _returned(pieces: pd.DataFrame, width: int, n: int) -> np.ndarray:
    """The totals of a part's ``n`` distinct n-grams of ``width`` words, ascending by hash."""
    if not n:  # there may be no pieces, nor their columns
        return np.zeros(0, np.int64)
    own = pieces[pieces["width"] == width].sort_values("bucket")
    return np.concatenate([unpacked(a) for a in own["totals"]]).astype(np.int64)


class _Part:
    """The words of a part: places of pairs and of triples, and the hashes of all three orders."""

    def __init__(self, what):
        self.sizes = unpacked(what["sizes"]).astype(np.int64)
        self.words = unpacked(what["words"]).astype(np.int64)
        self.hashes = np.frombuffer(what["hashes"], np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        inside = np.arange(len(self.words)) - np.repeat(self.starts, self.sizes)
        self.second, self.third = np.flatnonzero(inside >= 1), np.flatnonzero(inside >= 2)
        h = self.hashes[self.words]
        self.pairs = np.zeros(len(h), np.uint64)  # the pair that ends at each word
        self.pairs[self.second] = _mixed(_mixed(h[self.second - 1]) + h[self.second])
        self.last = h

    def word_totals(self, pieces: pd.DataFrame) -> np.ndarray:
        """The total of the word at each place."""
        out = np.zeros(len(self.hashes), np.int64)
        out[np.argsort(self.hashes)] = _returned(pieces, 1, len(self.hashes))
        return out[self.words]

    def pair_totals(self, pieces: pd.DataFrame) -> np.ndarray:
        """The total of the pair that ends at each place, 0 at the start of a text."""
        out = np.zeros(len(self.words), np.int64)
        distinct, where = np.unique(self.pairs[self.second], return_inverse=True)
        out[self.second] = _returned(pieces, 2, len(distinct))[where]
        return out

    def triples(self, pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the triples that may occur ``least`` times, as both their pairs do; distinct hashes; each one's place there."""
        at = self.third
        at = at[(pairs[at] >= least) & (pairs[at - 1] >= least)]
        return at, *np.unique(_mixed(_mixed(self.pairs[at - 1]) + self.last[at]), return_inverse=True)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", discount: float = 0.4, min_count: int = 2) -> DataFrame:
    """``id, n_words, log_sum, mean_log10`` of every row: its stupid-backoff score under all of ``docs``.

    Words are what stands between ASCII white space; words, pairs and triples are counted over
    the whole corpus by their 64-bit hashes, none left out. A word after two others scores
    count(triple) / count(first pair) if the triple occurs ``min_count`` times; else ``discount``
    times what it scores after one: count(pair) / count(first) if the pair does, else ``discount``
    times its share of all words. (With a ``min_count`` of 1 nothing would back off, since the
    scored texts are counted too.) A text starts with the share of its first word.

    Each part of the corpus sums up its own n-grams, so that one has an entry for each part that
    holds it, however many documents do. Triples are counted where both their pairs occur
    ``min_count`` times, since no other can.

    ``log_sum`` is the sum of natural logarithms. Null and empty texts have no words, sum 0 and
    a null mean; very long texts may make a part longer and are read whole; null ids and
    repeated rows are rows like any other; other columns are not read; an empty table gives an
    empty one. ``docs`` must give the same rows in the same partitions each time it is
    evaluated, as stored tables do.
    """
    picked = docs.select(F.monotonically_increasing_id().alias("uid"), column(docs, id_col).alias("id"), column(docs, text_col).alias("text"))
    picked, id_kind = numbers_as_text(picked, "id")
    id_type = picked.schema["id"].dataType.simpleString()
    least = max(min_count, 1)

    def parts_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Documents of each part, their words as places in its distinct hashes, frequent words first."""
        digest = xxhash.xxh3_64_intdigest
        ids, sizes, held, number, part = [], [], [], {}, None

        def out() -> pd.DataFrame:
            words = np.concatenate(held)
            often = np.argsort(-np.bincount(words, minlength=len(number)), kind="stable")
            place = np.empty(len(often), np.int64)
            place[often] = np.arange(len(often))
            hashes = np.fromiter(map(digest, number), np.uint64, len(number))[often]
            row = (part, packed(np.array(sizes)), packed(place[words]), hashes.tobytes(), ids)
            return pd.DataFrame([row], columns=["part", "sizes", "words", "hashes", "ids"])

        total = 0
        for pdf in batches:
            for uid, own, text in pdf.itertuples(index=False):
                part = uid if part is None else part
                found = _words(text)
                ids.append(own if not pd.isna(own) else None)
                sizes.append(len(found))
                held.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
                total += len(found) + 1
                if total >= PART_WORDS:
                    yield out()
                    ids, sizes, held, number, part, total = [], [], [], {}, None, 0
        if ids:
            yield out()

    # Evaluated twice: for the counts of words and pairs, and for one exchange that both later steps share.
    parts = picked.mapInPandas(parts_of, f"part long, sizes binary, words binary, hashes binary, ids array<{id_type}>")
    n_words = picked.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD))), F.lit(0))).first()[0]
    n_buckets = max(1, -(-n_words // BUCKET_GRAMS))

    def short_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, what in pdf.iterrows():
                p = _Part(what)
                order = np.argsort(p.hashes)
                yield _cells(what["part"], 1, p.hashes[order], np.bincount(p.words, minlength=len(order))[order], n_buckets)
                yield _cells(what["part"], 2, *np.unique(p.pairs[p.second], return_counts=True), n_buckets)

    def long_grams(key, whats: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        p = _Part(whats.iloc[0])
        _, grams, where = p.triples(p.pair_totals(pieces), least)
        return _cells(key[0], 3, grams, np.bincount(where, minlength=len(grams)), n_buckets)

    def score(key, whats: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        p = _Part(whats.iloc[0])
        words, pairs, triples = p.word_totals(pieces), p.pair_totals(pieces), np.zeros(len(p.words), np.int64)
        at, grams, where = p.triples(pairs, least)
        triples[at] = _returned(pieces, 3, len(grams))[where]
        order = np.minimum(np.arange(len(words)) - np.repeat(p.starts, p.sizes), 2)  # words before, two at most
        share = words / n_words * discount**order
        before = np.roll(words, 1), np.roll(pairs, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where((order >= 1) & (pairs >= least), pairs / before[0] * discount ** (order - 1), share)
            share = np.where((order >= 2) & (triples >= least), triples / before[1], share)
        total = np.zeros(len(p.sizes))
        some = p.sizes > 0
        total[some] = np.add.reduceat(np.log(share), p.starts[some]) if some.any() else 0
        mean = [t / n / np.log(10) if n else None for t, n in zip(total, p.sizes, strict=True)]
        return pd.DataFrame({"id": whats.iloc[0]["ids"], "n_words": p.sizes, "log_sum": total, "mean_log10": pd.array(mean, "Float64")})

    short = stage(parts.select("part", "sizes", "words", "hashes").mapInPandas(short_grams, CELL).groupBy("bucket").applyInPandas(_sum_up, SUMMED))
    triples = parts.groupBy("part").cogroup(short.where("width = 2").groupBy("part")).applyInPandas(long_grams, CELL)
    totals = short.unionByName(triples.groupBy("bucket").applyInPandas(_sum_up, SUMMED))
    scored = parts.groupBy("part").cogroup(totals.groupBy("part"))
    scored = scored.applyInPandas(score, f"id {id_type}, n_words long, log_sum double, mean_log10 double")
    return scored.withColumn("id", F.col("id").cast(id_kind))
