"""Repeated passages by content-defined chunks that are deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import cut_points
from .common import keyed_rows, numbers_as_text, stage

#: Chunks end at one byte in 2**BITS and have LEAST to MOST bytes.
BITS, LEAST, MOST = 5, 8, 96

#: Bytes from which a run of shared chunks is a repeated passage. A passage of 50 words has some
#: 300 bytes, of which the chunks at its two ends, which also hold bytes of what surrounds it, are lost.
LEAST_RUN = 160


def chunk_digests(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ends (in bytes) and digests (signed) of the chunks of a whole text."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    ends = cut_points(data, BITS, MOST, LEAST)
    at = [0, *ends.tolist()]
    digest = xxhash.xxh3_64_intdigest
    got = np.fromiter((digest(data[a:b]) for a, b in zip(at, at[1:], strict=False)), np.uint64, len(ends))
    return ends, got.view(np.int64)


def _occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 500):
            part = pdf[at : at + 500]
            got = [chunk_digests(t) for t in part["c1"]]
            n = [len(e) for e, _ in got]
            ends = np.concatenate([e for e, _ in got]).astype(np.int32)
            starts = np.concatenate([np.concatenate([[0], e[:-1]]) if len(e) else e for e, _ in got]).astype(np.int32)
            seq = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
            frame = pd.DataFrame({"uid": np.repeat(part["uid"].to_numpy(), n), "seq": seq, "first": starts, "last": ends})
            frame["digest"] = np.concatenate([d for _, d in got])
            yield frame


def merge_spans(chunks: list[tuple], least: int) -> tuple[int, list[tuple[int, int]]]:
    """(repeated bytes, spans to remove) of the shared chunks (seq, first, last, owner) of a text.

    Runs of consecutive shared chunks count from ``least`` bytes on; in them, the chunks whose
    first place is elsewhere go.
    """
    chunks = sorted(chunks)
    repeated, spans, at = 0, [], 0
    while at < len(chunks):
        upto = at + 1
        while upto < len(chunks) and chunks[upto][0] == chunks[upto - 1][0] + 1:
            upto += 1
        if chunks[upto - 1][2] - chunks[at][1] >= least:
            repeated += chunks[upto - 1][2] - chunks[at][1]
            for _, first, last, owner in chunks[at:upto]:
                if not owner:
                    if spans and spans[-1][1] == first:
                        spans[-1] = (spans[-1][0], last)
                    else:
                        spans.append((first, last))
        at = upto
    return repeated, spans


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_RUN) -> DataFrame:
    """``id, n_bytes, repeated_bytes, removed_bytes, spans, text`` of every row.

    Chunks with equal digests in several texts are the same passage (what only one text repeats
    is no such passage); the place with the smallest (row, position) keeps it and the others lose
    it, if the run of shared chunks around it has ``least`` bytes. ``spans`` are byte intervals of the UTF-8 text that go,
    ``text`` is what stays; ``repeated_bytes`` also counts the passages that stay. A
    boundary depends on the 32 bytes before it and, through the least and greatest size of a
    chunk, on the boundary before; after an insertion boundaries meet again at the next bytes
    where both texts may cut.

    A null text stays null and has no bytes; null ids come first; repeated rows are texts like
    any other; other columns are not read. Ids, texts and row numbers are staged once, so that
    spans always belong to the text they are cut from, whatever ``docs`` is computed from.
    """
    rows, id_kind = numbers_as_text(keyed_rows(docs, id_col, text_col), "c0")
    rows = stage(rows)
    found = rows.mapInPandas(_occurrences, "uid long, seq int, first int, last int, digest long")
    place = F.min(F.struct("uid", "seq")).alias("owner")
    texts = (F.min("uid") != F.max("uid")).alias("several")
    shared = found.groupBy("digest").agg(texts, place).where("several").select("digest", "owner")
    shared = stage(shared)
    owner = (F.col("owner.uid") == F.col("uid")) & (F.col("owner.seq") == F.col("seq"))
    hits = found.join(shared, "digest").select("uid", F.struct("seq", "first", "last", owner.alias("owner")).alias("chunk"))
    hits = stage(hits.groupBy("uid").agg(F.collect_list("chunk").alias("chunks")))
    id_type = rows.schema["c0"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for own, text, chunks in zip(pdf["c0"], pdf["c1"], pdf["chunks"], strict=True):
                data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                chunks = [] if chunks is None else [(c["seq"], c["first"], c["last"], c["owner"]) for c in chunks]
                repeated, spans = merge_spans(chunks, least)
                if spans:
                    ends = [0, *(x for s in spans for x in s), len(data)]
                    text = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)).decode("utf-8", "surrogatepass")
                out.append((own, len(data), repeated, sum(b - a for a, b in spans), [{"first": a, "last": b} for a, b in spans], text))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "repeated_bytes", "removed_bytes", "spans", "text"])

    schema = f"id {id_type}, n_bytes long, repeated_bytes long, removed_bytes long, spans array<struct<first:int,last:int>>, text string"
    out = rows.join(hits, "uid", "left").select("c0", "c1", "chunks").mapInPandas(cut, schema)
    return out.withColumn("id", F.col("id").cast(id_kind))
