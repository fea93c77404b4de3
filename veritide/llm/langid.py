"""Language identification with a small byte convolutional network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, drop_staged, stage

#: Bytes of a window; filter widths; filters of each width; size of a byte's embedding.
WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 8, 8

#: Windows that are classified at a time.
BATCH = 1024


def windows(text: str) -> np.ndarray:
    """The whole text as (n, WINDOW) bytes, the last window filled up with zeros."""
    data = text.encode("utf-8", "replace")
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class ByteCnn:
    """Multi-width filters over embedded bytes, max pooling over the window, softmax."""

    labels: list
    embed: np.ndarray  # (256, EMBED); the zero byte stays zero
    filters: list[np.ndarray]  # (width, EMBED, FILTERS)
    biases: list[np.ndarray]
    dense: np.ndarray  # (widths * FILTERS, labels)
    bias: np.ndarray

    def tables(self) -> list:
        """A filter's response to a pair of bytes, tabulated: each width sums one or two look-ups."""
        out = []
        for w, f, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            by = [self.embed @ f[k] for k in range(w)]
            pair = lambda k, by=by: (by[k][:, None, :] + by[k + 1][None, :, :]).reshape(65536, FILTERS)
            parts = [(0, pair(0) + b)]
            if w == 3:
                parts.append((2, by[2]))
            elif w == 4:
                parts.append((2, pair(2)))
            out.append((w, [(k, t.astype(np.float32)) for k, t in parts]))
        return out

    def log_probs(self, x: np.ndarray, tables: list) -> np.ndarray:
        """(n, labels) log-probabilities of (n, WINDOW) bytes."""
        out = np.empty((len(x), len(self.labels)))
        for at in range(0, len(x), BATCH):
            part = x[at : at + BATCH]
            pairs = (part[:, :-1].astype(np.uint16) << 8) | part[:, 1:]
            pooled = []
            for w, parts in tables:
                n = WINDOW - w + 1
                total = None
                for k, table in parts:
                    keys = part if len(table) == 256 else pairs
                    got = table[keys[:, k : k + n]]
                    total = got if total is None else total + got
                pooled.append(np.maximum(total.max(axis=1), 0))
            z = np.concatenate(pooled, axis=1) @ self.dense + self.bias
            z = z - z.max(axis=1, keepdims=True)
            out[at : at + BATCH] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out


def train(x: np.ndarray, y: np.ndarray, labels: list, epochs: int = 6, rate: float = 0.01, seed: int = 7) -> ByteCnn:
    """Fit a network to windows ``x`` (n, WINDOW) with label numbers ``y`` by Adam."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.5, (256, EMBED))
    embed[0] = 0
    p = [embed, *(rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)) for w in WIDTHS), *(np.zeros(FILTERS) for _ in WIDTHS)]
    p += [rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(labels))), np.zeros(len(labels))]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    nw = len(WIDTHS)
    size = 64
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), size):
            rows = order[at : at + size]
            xb, yb = x[rows], y[rows]
            e = p[0][xb]
            pooled, best = [], []
            for k, w in enumerate(WIDTHS):
                n = WINDOW - w + 1
                cols = np.concatenate([e[:, j : j + n] for j in range(w)], axis=2)
                r = cols @ p[1 + k].reshape(w * EMBED, FILTERS) + p[1 + nw + k]
                top = r.argmax(axis=1)
                best.append(top)
                pooled.append(np.take_along_axis(r, top[:, None, :], 1)[:, 0])
            h = np.concatenate(pooled, axis=1)
            a = np.maximum(h, 0)
            z = a @ p[-2] + p[-1]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(yb)), yb] -= 1
            q /= len(yb)
            g = [np.zeros_like(t) for t in p]
            g[-2], g[-1] = a.T @ q, q.sum(axis=0)
            dh = (q @ p[-2].T) * (h > 0)
            for k, w in enumerate(WIDTHS):
                d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                g[1 + nw + k] = d.sum(axis=0)
                for j in range(w):
                    byte = np.take_along_axis(xb, best[k] + j, 1)  # (b, FILTERS): the bytes that each filter's maximum saw
                    ev = p[0][byte]
                    g[1 + k][j] = np.einsum("bf,bfe->ef", d, ev)
                    np.add.at(g[0], byte, d[:, :, None] * p[1 + k][j].T[None])
            g[0][0] = 0
            step += 1
            for i in range(len(p)):
                m[i] += 0.1 * (g[i] - m[i])
                v[i] += 0.001 * (g[i] ** 2 - v[i])
                p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return ByteCnn(labels, p[0], p[1 : 1 + nw], p[1 + nw : 1 + 2 * nw], p[-2], p[-1])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_rows: int = 4000, per_row: int = 4, seed: int = 7) -> ByteCnn | None:
    """Train on a sample of the labelled texts of ``docs``: ``max_rows`` of them at most, or one of each language.

    Every language has the same quota (``max_rows`` by the number of languages) and fills it with
    the distinct texts of smallest hash, so a rare language is learnt from all its texts and one
    of many copies as well. The draw depends neither on the order of the rows nor on how often a
    text is repeated. Of each text, up to ``per_row`` windows are taken from anywhere in it, some cut short so that
    short texts are learnt too. Rows without text or label are left out; without any row there
    is no model (None).
    """
    text, lang = column(docs, text_col), column(docs, lang_col)
    some = docs.where(text.isNotNull() & lang.isNotNull() & (F.length(F.trim(text)) > 0)).select(text.alias("text"), lang.alias("lang"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, own, h in pdf.itertuples(index=False):
                rng = np.random.default_rng(h & 0xFFFFFFFF)
                data = t.encode("utf-8", "replace")
                for k in range(per_row):
                    size = WINDOW if k < per_row - 1 else int(rng.integers(8, WINDOW))
                    at = int(rng.integers(0, max(1, len(data) - size + 1)))
                    out.append((data[at : at + size], own))
            yield pd.DataFrame(out, columns=["data", "lang"])

    hashed = some.withColumn("h", F.xxhash64("text"))
    distinct = stage(hashed.select("lang", "h").distinct())
    sizes = distinct.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = sizes.count()
    if not n_langs:
        return None
    quota = max(1, max_rows // n_langs)
    # Only hashes below a bound that leaves some four quotas of a language, 64 at least, are gathered and ranked.
    share = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    few = distinct.join(F.broadcast(sizes) if n_langs <= max_rows else sizes, "lang").where(share * F.col("n") <= 4 * quota + 64)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = few.withColumn("place", place).where(F.col("place") <= quota).select("lang", "h")
    chosen = hashed.join(F.broadcast(chosen) if n_langs <= max_rows else chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    got = chosen.select("text", "lang", "h").mapInPandas(cut, "data binary, lang string").toPandas()
    drop_staged(distinct)
    got = got.sort_values(["lang", "data"], kind="stable")
    labels = sorted(got["lang"].unique())
    x = np.zeros((len(got), WINDOW), np.uint8)
    for k, data in enumerate(got["data"]):
        x[k, : len(data)] = np.frombuffer(data, np.uint8)
    y = got["lang"].map({own: k for k, own in enumerate(labels)}).to_numpy()
    return train(x, y, labels, seed=seed)


def has_letter(text: str | None) -> bool:
    return isinstance(text, str) and any(map(str.isalpha, text))


def predict(model: ByteCnn | None, texts) -> list[tuple[str, float]]:
    """(language, probability) of each whole text; ``und`` with score 0 without a letter or model.

    The log-probabilities of a text's windows are averaged by the bytes they hold.
    """
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if model is None:
        return out
    tables = model.tables()
    held: list[np.ndarray] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            x = np.concatenate(held)
            starts = np.concatenate([[0], np.cumsum([len(h) for h in held])[:-1]])
            weight = (x != 0).sum(axis=1)[:, None]
            mean = np.add.reduceat(model.log_probs(x, tables) * weight, starts) / np.add.reduceat(weight, starts)
            q = np.exp(mean - mean.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            for k, row in zip(owner, q, strict=True):
                out[k] = (model.labels[int(row.argmax())], float(row.max()))
            held.clear()
            owner.clear()
            size = 0

    for k, text in enumerate(texts):
        if has_letter(text):
            held.append(windows(text))
            owner.append(k)
            size += len(held[-1])
            if size >= 16 * BATCH:
                flush()
    flush()
    return out


def identify(docs: DataFrame, model: ByteCnn | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability in two new columns.

    Every row stays, whatever nulls it holds. The output names must be new.
    """
    if {lang_out.lower(), score_out.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"{lang_out} or {score_out} is a column already")
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(predict(known.value, texts.tolist()), columns=["lang", "score"])

    # not deterministic for the planner, which would else run the network twice below a filter on its result
    marked = docs.withColumn(lang_out, guess.asNondeterministic()(column(docs, text_col)))
    return marked.withColumn(score_out, F.col(lang_out)["score"]).withColumn(lang_out, F.col(lang_out)["lang"])
