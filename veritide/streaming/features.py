"""Lag features of a stream of closed pairs and runs, from bounded state per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from veritide.functions.calendar import DAY_US, micros

#: Where Spark keeps state that has lists and a time to live; the session must name it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

FEATURES = "lag_error double, mean_3 double, mean_7 double, n30 long, age_days double"


def mean_of(errors: list) -> float | None:
    """The mean of those that are not null."""
    some = [e for e in errors if e is not None]
    return sum(some) / len(some) if some else None


def features_at(pairs: list[tuple], runtime: int, days: int = 30) -> tuple:
    """The five features of a run: ``pairs`` are (close, run, error) in order, in microseconds; one that closes at the run is not known."""
    known = [p for p in pairs if p[0] < runtime]
    if not known:
        return None, None, None, None, None
    end = known[-1][0]
    errors = [e for *_, e in known[-7:]]
    return errors[-1], mean_of(errors[-3:]), mean_of(errors), sum(p[0] > end - days * DAY_US for p in known), (runtime - end) / DAY_US


def still_needed(pairs: list[tuple], horizon: int, days: int = 30, last: int = 7) -> list[tuple]:
    """The pairs that a run at ``horizon`` or later can depend on."""
    closed = [p for p in pairs if p[0] < horizon]
    if not closed:
        return pairs
    old = closed[-1][0] - days * DAY_US
    return [p for k, p in enumerate(closed) if p[0] > old or k >= len(closed) - last] + pairs[len(closed) :]


class LagFeatures(StatefulProcessor):
    """Absorbs the pairs of a group and answers its runs; holds what runs to come can need."""

    def __init__(self, group: Sequence[str], ahead_days: int = 10, ttl_ms: int | None = None):
        self.group, self.ahead, self.ttl = list(group), ahead_days * DAY_US, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pairs = handle.getListState("pairs", "close long, run long, error double", self.ttl)
        self.horizon = handle.getValueState("horizon", "at long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(c, r, None if e is None or e != e else e) for c, r, e in self.pairs.get()]
        runs: list[tuple] = []
        for pdf in rows:
            for name, run, close, error, asks in zip(pdf["row_id"], pdf["run_us"], pdf["close_us"], pdf["error"], pdf["asks"], strict=True):
                if asks:
                    runs.append((name, int(run)))
                else:
                    held.append((int(close), int(run), None if pd.isna(error) else float(error)))
        held.sort(key=lambda p: p[:2])
        answers = [[*key, name, *features_at(held, run)] for name, run in runs]
        before = self.horizon.get()[0] if self.horizon.exists() else 0
        newest = held[-1][0] if held else 0
        at = max([before, newest - self.ahead, *(r for _, r in runs)])
        self.horizon.update((at,))
        held = still_needed(held, at)
        if held:
            self.pairs.put(held)
        out = pd.DataFrame(answers, columns=[*self.group, "row_id", "lag_error", "mean_3", "mean_7", "n30", "age_days"])
        yield out.astype({"lag_error": "float64", "mean_3": "float64", "mean_7": "float64", "n30": "Int64", "age_days": "float64"})

    def close(self) -> None:
        pass


def stream_lag_features(rows: DataFrame, group: Sequence[str], asks: str = "asks", row_id: str = "row_id", runtime: str = "runtime", end: str = "window_end", error: str = "error_f", ahead_days: int = 10, ttl_ms: int | None = None) -> DataFrame:
    """``group, row_id`` of the runs in a stream, with the features that :func:`lag_features` gives them.

    ``rows`` holds pairs, each once when its outcome is known, and runs (``asks`` true, with a
    ``row_id``); a run comes after the pairs that close before it, as runs are issued after them,
    and no more than ``ahead_days`` before the latest close of its group. However the rows are cut
    into batches, the answers are those of the batch form; a pair that closes at the run or
    later stays in state for later runs. State is the pairs of 30 days, the last seven and those
    ahead, per group; with ``ttl_ms`` that of a group without any row for so long goes (a silent
    group then starts anew, which the batch form does not do).
    """
    named = rows.select(*group, F.col(row_id).cast("string").alias("row_id"), micros(runtime).alias("run_us"), micros(end).alias("close_us"), F.col(error).cast("double").alias("error"), F.col(asks).alias("asks"))
    kinds = ", ".join(f"`{g}` {named.schema[g].dataType.simpleString()}" for g in group)
    return named.groupBy(*group).transformWithStateInPandas(LagFeatures(group, ahead_days, ttl_ms), f"{kinds}, row_id string, {FEATURES}", "Append", "None" if ttl_ms is None else "ProcessingTime")
