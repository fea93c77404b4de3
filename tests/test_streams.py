"""Streams against the batch forms, cut into batches in several ways."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from veritide.operators import asof
from veritide.sources import commits
from veritide.streaming import features, ingest

G = ["station", "variable"]


@pytest.fixture
def rocks(spark):
    spark.conf.set(*features.STATE_STORE)
    yield spark
    spark.conf.unset(features.STATE_STORE[0])


def files(spark, tmp_path, rows, schema, cuts):
    """A stream of ``rows`` in files of a batch each, cut at ``cuts``."""
    at = tmp_path / f"in{len(cuts)}"
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        part = str(at / f"part{k:03d}")
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(part)
        for f in os.listdir(part):
            os.utime(os.path.join(part, f), (1_700_000_000 + 10 * k,) * 2)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(at))


def run_to_end(df, tmp_path, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name).collect()


def panel():
    rng = random.Random(4)
    at = dt.datetime(2023, 1, 1, 13)
    pairs, runs = [], []
    for s in ("A", "B", None):
        for v in ("max", "min"):
            for k in range(70):
                if s == "B" and 10 < k < 60:
                    continue  # a silent group keeps its last pairs
                run = at + dt.timedelta(days=k)
                for lead in (1, 2):
                    pairs.append((s, v, run, run + dt.timedelta(days=lead - 1, hours=17 if lead == 1 else 0), rng.choice([None, *range(-5, 6)])))
                runs.append((s, v, run + dt.timedelta(hours=rng.choice([0, 4, 11]))))
    return pairs, sorted(runs, key=lambda r: (r[2], str(r[0]), r[1]))


def test_features_equal_the_batch_form(rocks, tmp_path):
    spark = rocks
    pairs, runs = panel()
    schema = "station string, variable string, runtime timestamp_ntz, window_end timestamp_ntz, error_f double"
    batch = spark.createDataFrame([(*p[:4], None if p[4] is None else float(p[4])) for p in pairs], schema)
    asked = spark.createDataFrame([(f"r{k}", *r) for k, r in enumerate(runs)], "row_id string, station string, variable string, runtime timestamp_ntz")
    # null keys never equal in a window's facts either: one group
    want = {r.row_id: r for r in asof.lag_features(asked, asof.pair_stats(batch, G), G).collect()}
    # a pair arrives at its close, a run at its time, runs after the pairs that close before them
    rows = [(p[3], 1, (*p[:4], None if p[4] is None else float(p[4]), False, None)) for p in pairs]
    rows += [(r[2], 0, (r[0], r[1], r[2], None, None, True, f"r{k}")) for k, r in enumerate(runs)]
    rows = [x for *_, x in sorted(rows, key=lambda x: x[:2])]
    for n, cuts in enumerate(([], [300], sorted(random.Random(1).sample(range(1, len(rows)), 9)))):
        stream = files(spark, tmp_path, rows, f"{schema}, asks boolean, row_id string", cuts)
        got = run_to_end(features.stream_lag_features(stream, G), tmp_path, f"features{n}")
        assert len(got) == len(runs)
        for r in got:
            w = want[r.row_id]
            assert (r.lag_error, r.mean_3, r.mean_7, r.n30, r.age_days) == pytest.approx((w.lag_error, w.mean_3, w.mean_7, w.n30, w.age_days)), r


def test_state_stays_bounded():
    day = features.DAY_US
    held = []
    for k in range(400):
        held.append((k * day, k * day - 5, float(k)))
        held = features.still_needed(held, k * day + 1)
        assert len(held) <= 30
    assert features.features_at(held, 400 * day) == (399.0, 398.0, 396.0, 30, 1.0)
    few = [(k * day, 0, 1.0) for k in range(9)]
    assert features.still_needed(few, 500 * day) == few[-9:] and len(features.still_needed(few[:1] + [(d + 300 * day, 0, 1.0) for d, *_ in few], 900 * day)) == 9
    assert features.features_at([], 5) == (None,) * 5 and features.features_at([(5, 0, 1.0)], 5) == (None,) * 5


def test_late_rows_are_counted_once(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2023, 5, d, h)
    rows = [("A", day(1).date(), day(1, 18), day(1, 12), 1.0), ("B", day(1).date(), day(1, 18), day(1, 18), 2.0), ("C", day(2).date(), day(2, 18), day(2, 20), 3.0), ("D", day(2).date(), day(2, 18), day(2, 1), 4.0)]
    schema = "station string, d date, window_end timestamp_ntz, arrived_at timestamp_ntz, v double"
    on, late = str(tmp_path / "on"), str(tmp_path / "late")
    write = ingest.late_aside(on, late, ["station"], "d")
    whole = spark.createDataFrame(rows, schema)
    for batch_id, part in ((0, rows[:2]), (1, rows[2:]), (0, rows[:2]), (1, rows[2:]), (2, [])):  # batches 0 and 1 are replayed
        write(spark.createDataFrame(part, schema), batch_id)
    assert sorted((r.batch, r.n, r.n_late) for r in ingest.late_counts(spark, late).collect()) == [(0, 2, 1), (1, 2, 1), (2, 0, 0)]
    assert sorted(r.station for r in spark.read.parquet(f"{late}/rows").collect()) == ["B", "C"]
    assert sorted(r.station for r in commits.read_dates(spark, on, schema, "d").collect()) == ["A", "D"]
    stream = files(spark, tmp_path, rows, schema, [1, 3])
    on, late = str(tmp_path / "on2"), str(tmp_path / "late2")
    q = stream.writeStream.foreachBatch(ingest.late_aside(on, late, ["station"], "d")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    total = ingest.late_counts(spark, late).agg(F.sum("n"), F.sum("n_late")).first()
    assert tuple(total) == (4, ingest.split_late(whole).where("late").count()) and ingest.late_counts(spark, str(tmp_path / "none")).count() == 0


def test_windows_wait_for_late_readings(spark, tmp_path):
    utc = dt.timezone.utc
    at = lambda d, h: dt.datetime(2023, 5, d, h, tzinfo=utc)
    windows = [("A", "max", at(d, 0), at(d, 18)) for d in range(1, 21)] + [("B", "max", at(3, 0), at(3, 18))]
    due = [(at(d, h), ("A", at(d, h), float(d * 100 + h))) for d in range(1, 21) for h in (0, 6, 17, 18) if d != 5]
    # a reading of day 7 comes three days late, one of day 8 nine days late; readings of day 5 never come
    arrive = sorted([(t + dt.timedelta(days=3) if r[2] == 706 else t + dt.timedelta(days=9) if r[2] == 806 else t, r) for t, r in due], key=lambda x: x[0])
    arrive = [r for _, r in arrive] + [("Z", at(30, 0), 0.0)]  # time goes on
    w_rows = [*windows, ("Z", "max", at(30, 0), at(30, 1))]
    want = {}
    for e, _, a, b in windows:
        if b + dt.timedelta(days=4) < at(30, 0) - dt.timedelta(days=0):
            own = [v for x, t, v in arrive if x == e and a <= t < b and v != 806]
            want[e, a.replace(tzinfo=None)] = (len(own), max(own, default=None), min(own, default=None))
    ws = files(spark, tmp_path / "w", w_rows, "entity string, variable string, window_start timestamp, window_end timestamp", [5, 12])
    rs = files(spark, tmp_path / "r", arrive, "entity string, valid timestamp, reading double", list(range(4, len(arrive), 4)))
    got = run_to_end(ingest.late_resolved(ws, rs), tmp_path, "late_windows")
    mine = {(r.entity, r.window_start): (r.n_obs, r.high, r.low) for r in got}
    assert len(mine) == len(got)
    assert mine == want
