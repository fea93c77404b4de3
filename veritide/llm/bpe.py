"""Byte-level BPE with chunks that are shared between documents encoded once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import cut_points
from .common import column, keyed_rows, numbers_as_text, small_batches, stage

#: Chunks: one boundary in 2**CHUNK_BITS bytes, at most CHUNK_MOST bytes.
CHUNK_BITS, CHUNK_LEAST, CHUNK_MOST = 10, 256, 8192

#: The filter of shared chunks: a fixed number of bits, whatever the corpus.
FILTER_BITS, FILTER_HASHES = 1 << 26, 4


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encodes and decodes as the vocabulary file's tokenizer does, special tokens included."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(chars[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self._tok = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.table: list[bytes] = [b""] * size
        for t, i in [*ranks.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.table[i] = t
        self.names = [str(i) for i in range(size)]
        self._allowed = set(self.special)

    def encode(self, text: str) -> list[int]:
        return self._tok.encode(text, allowed_special=self._allowed, disallowed_special=())

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        joined = ",".join(map(self.names.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def safe_cut(text: str, start: int = 0) -> int:
    """The first place at or after ``start`` where a token always ends: before a space that
    follows a visible character. -1 if there is none."""
    at = text.find(" ", max(start, 1))
    while at > 0 and text[at - 1].isspace():
        at = text.find(" ", at + 1)
    return at


def last_safe_cut(text: str) -> int:
    at = text.rfind(" ")
    while at > 0 and text[at - 1].isspace():
        at = text.rfind(" ", 0, at)
    return at if at > 0 else -1


def encode_part(c: Codec, text: str) -> tuple[str, bytes, str]:
    """A chunk as (text before its first safe cut, ids up to its last one, text after that).

    No token crosses a safe cut and the ids on either side do not depend on the other, so only
    head and tail can change when chunks are joined. Without a safe cut all text is head.
    """
    first = safe_cut(text)
    if first < 0:
        return text, b"", ""
    last = last_safe_cut(text)
    return text[:first], np.array(c.encode(text[first:last]), np.int32).tobytes(), text[last:]


class Joiner:
    """Joins encoded chunks of one text.

    Each seam is re-encoded from the last safe cut before it to the first one after it. Ids on
    either side of a safe cut do not depend on what is beyond it, so this agrees with the ids of
    the whole text. A text without a safe cut is one seam, which is gathered in pieces and
    encoded once, at its end.
    """

    def __init__(self, c: Codec):
        self.codec, self.ids, self.open = c, [], []

    def _close(self, text: str) -> None:
        self.open.append(text)
        self.ids += self.codec.encode("".join(self.open))

    def add(self, head: str, ids: bytes, tail: str) -> None:
        if not ids and not tail:  # no safe cut within the chunk: the seam goes on, unless there is one where it starts
            before = next((t[-1] for t in reversed(self.open) if t), "")
            cut = last_safe_cut(before + head) - len(before)
            if cut >= 0:
                self._close(head[:cut])
                self.open = [head[cut:]]
            else:
                self.open.append(head)
            return
        self._close(head)
        self.ids += np.frombuffer(ids, np.int32).tolist()
        self.open = [tail]

    def finish(self) -> list[int]:
        self._close("")
        self.open = []
        return self.ids


def chunk_texts(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    ends = cut_points(data, CHUNK_BITS, CHUNK_MOST, CHUNK_LEAST).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _places(digests: np.ndarray) -> np.ndarray:
    """(n, FILTER_HASHES) bit numbers of 64-bit digests in the filter."""
    odd = (digests >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(FILTER_HASHES, dtype=np.uint64)
    return ((digests[:, None] + odd[:, None] * steps) % np.uint64(FILTER_BITS)).astype(np.int64)


def shared_filter(shared: DataFrame) -> np.ndarray:
    """A Bloom filter of ``digest`` (long): FILTER_BITS bits, so its size does not follow the data."""

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.unique(_places(pdf["digest"].to_numpy().view(np.uint64)).ravel())
            yield pd.DataFrame({"word": at >> 5, "mask": np.int64(1) << (at & 31)})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"word": [pdf["word"].to_numpy(np.int32).tobytes()], "mask": [pdf["mask"].to_numpy(np.int64).astype(np.uint32).tobytes()]})

    words = shared.mapInPandas(bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in words.mapInPandas(pack, "word binary, mask binary").collect():  # FILTER_BITS / 4 bytes at most, in a few rows
        out[np.frombuffer(r.word, np.int32)] = np.frombuffer(r.mask, np.uint32)
    return out


def _in_filter(words: np.ndarray, digests: np.ndarray) -> np.ndarray:
    at = _places(digests)
    return ((words[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)).astype(bool).all(axis=1)


def _digest(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk)


#: Columns of a part of a text: (kind 0) encoded, or (kind 1) a chunk known by its key.
NOTHING = (None,) * 4
DONE = "tokens long, ids_sha string, text_sha string, all_ids array<int>"
PART = "uid long, n long, seq int, kind int, key binary, chunk binary, head string, ids binary, tail string"


def _row(c: Codec, ids: list[int], keep_ids: bool) -> tuple:
    return (*c.digests(ids), np.array(ids, np.int32) if keep_ids else None)


def encoded_parts(docs: DataFrame, id_col: str, text_col: str, path: str, keep_ids: bool) -> tuple[DataFrame, DataFrame, T.DataType]:
    """(ids and digests of the texts that share no chunk; parts of the others; the type of ids, which go as text)."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = [d for t in pdf["c1"] for d in {_digest(c) for c in chunk_texts(t)}]
            yield pd.DataFrame({"digest": np.array(seen, np.uint64).view(np.int64)})

    rows, id_kind = numbers_as_text(keyed_rows(docs, id_col, text_col), "c0")
    shared = rows.select("c1").mapInPandas(digests, "digest long").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    with small_batches(docs.sparkSession):
        known = docs.sparkSession.sparkContext.broadcast(shared_filter(shared.select("digest")))
    id_type = rows.schema["c0"].dataType.simpleString()
    schema = f"{PART}, c0 {id_type}, {DONE}"
    names = [f.split()[0] for f in schema.split(", ")]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for pdf in batches:
            out, held = [], 0
            for uid, own, text in zip(pdf["uid"], pdf["c0"], pdf["c1"], strict=True):
                text = text if isinstance(text, str) else ""
                chunks = chunk_texts(text)
                hit = _in_filter(known.value, np.array([_digest(k) for k in chunks], np.uint64)) if chunks else np.zeros(0, bool)
                if not hit.any():
                    out.append((uid, 0, -1, 2, None, None, None, None, None, own, *_row(c, c.encode(text), keep_ids)))
                else:
                    seq, at = 0, 0
                    while at < len(chunks):
                        upto = at + 1
                        while not hit[at] and upto < len(chunks) and not hit[upto]:
                            upto += 1
                        if hit[at]:
                            key = xxhash.xxh3_128_digest(chunks[at])
                            out.append((uid, 0, seq, 1, key, chunks[at], None, None, None, own, *NOTHING))
                        else:
                            head, ids, tail = encode_part(c, b"".join(chunks[at:upto]).decode("utf-8", "surrogatepass"))
                            out.append((uid, 0, seq, 0, None, None, head, ids, tail, own, *NOTHING))
                        seq, at = seq + 1, upto
                    out[-seq:] = [(r[0], seq, *r[2:]) for r in out[-seq:]]
                held += len(text)
                if held > 4_000_000:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    with small_batches(docs.sparkSession):
        parts = stage(rows.mapInPandas(encode, schema))
    known.unpersist()
    return parts.where("kind = 2"), parts.where("kind < 2"), id_kind


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` and the token ``ids`` of every row of ``docs``.

    ``path`` is a byte-level BPE vocabulary file; ``keep_ids`` false leaves the ids out.

    Texts are cut into content-defined chunks; those that several documents hold are encoded
    once and joined to each place by digest, the rest are encoded where they are. Seams are then
    re-encoded between the safe cuts around them, which gives the ids of the whole text. A null
    text counts as empty; null ids and repeated rows are rows like any other; other columns are
    not read. Which chunks are shared is told by a filter of fixed size whose false alarms only
    send a chunk the longer way.
    """

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for pdf in batches:
            got = [encode_part(c, k.decode("utf-8", "surrogatepass")) for k in pdf["chunk"]]
            yield pd.DataFrame({"key": pdf["key"], "head": [g[0] for g in got], "ids": [g[1] for g in got], "tail": [g[2] for g in got]})

    done, parts, id_kind = encoded_parts(docs, id_col, text_col, path, keep_ids)
    chunks = parts.where("kind = 1").groupBy("key").agg(F.first("chunk").alias("chunk"))
    encoded = stage(chunks.mapInPandas(once, "key binary, head string, ids binary, tail string"))
    kept = ["uid", "n", "seq", "c0", "head", "ids", "tail"]
    filled = parts.where("kind = 1").select("uid", "n", "seq", "c0", "key").join(encoded, "key").select(kept)
    every = filled.unionByName(parts.where("kind = 0").select(kept))
    id_type = done.schema["c0"].dataType.simpleString()

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, joiner, out = codec(path), None, []
        # few rows at a time, whatever the size of the batches: the ids of their texts are lists of numbers here
        for pdf in (pdf[at : at + 500] for pdf in batches for at in range(0, len(pdf), 500)):
            for uid, n, seq, own, head, ids, tail in pdf.itertuples(index=False):
                if seq == 0:
                    joiner = Joiner(c)
                joiner.add(head or "", ids or b"", tail or "")
                if seq == n - 1:
                    out.append((own, *_row(c, joiner.finish(), keep_ids)))
            yield pd.DataFrame(out, columns=["c0", "tokens", "ids_sha", "text_sha", "all_ids"])
            out = []

    result = f"c0 {id_type}, {DONE}"
    whole = every.repartition("uid").sortWithinPartitions("uid", "seq").mapInPandas(join, result)
    both = whole.unionByName(done.select("c0", "tokens", "ids_sha", "text_sha", "all_ids"))
    names = {"c0": "id", "tokens": "n_tokens", "ids_sha": "ids_sha256", "text_sha": "decoded_sha256", "all_ids": "ids"}
    out = both.withColumn("c0", F.col("c0").cast(id_kind)).withColumnsRenamed(names)
    return out if keep_ids else out.drop("ids")


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_out: str = "text") -> DataFrame:
    """``encoded`` with the text of its token ids in a new column; null ids give a null text."""
    if text_out.lower() in {c.lower() for c in encoded.columns}:
        raise ValueError(f"{text_out} is a column already")

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([None if i is None else c.decode(list(i)) for i in ids], dtype=object)

    return encoded.withColumn(text_out, text(column(encoded, ids_col)))
