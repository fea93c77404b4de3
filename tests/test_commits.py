"""Commits under crashes, second writers and readers that look on."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_files import issued
from veritide.operators import log
from veritide.sources import commits, sinks

TABLE = "station string, d date, v int"


class Crash(Exception):
    pass


def test_publish_is_whole_and_once(spark, tmp_path):
    at = str(tmp_path / "c" / "0000000001.json")
    commits.publish(spark, at, "é\n")
    with pytest.raises(commits.Conflict):
        commits.publish(spark, at, "other")
    assert open(at, encoding="utf-8").read() == "é\n"
    assert commits.numbers(spark, str(tmp_path / "c")) == [1] and commits.numbers(spark, str(tmp_path / "none")) == []
    assert not [n for n in commits.names(spark, str(tmp_path / "c")) if n.startswith("_")]


def put(spark, path, date, now=None):
    return log.append_partition(spark, path, date, issued(spark, date), now or f"{date} 15:00:00", ["baseline"])


def state(spark, path):
    rows, seals = log.read_log(spark, path)
    return sorted((r.station, str(r.run_date)) for r in rows.collect()), [str(r.run_date) for r in seals.orderBy("run_date").collect()]


@pytest.mark.parametrize("step", ["partition_hashes", "as_lines", "publish"])
def test_a_writer_that_stops_changes_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "log")
    put(spark, path, "2023-01-01")
    before = state(spark, path)

    def stop(*_):
        raise Crash

    with monkeypatch.context() as m:
        m.setattr(log if step == "partition_hashes" else commits, step, stop)
        with pytest.raises(Crash):
            put(spark, path, "2023-01-02")
    assert state(spark, path) == before and log.verify_log(spark, path).count() == 0
    assert [str(r.run_date) for r in log.unsealed_attempts(spark, path).collect()] == ["2023-01-02"]
    assert put(spark, path, "2023-01-02") == {"rows": 2, "late": 1}  # simply run again
    assert len(state(spark, path)[0]) == 4 and log.verify_log(spark, path).count() == 0


def test_the_second_of_two_writers_loses(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    put(spark, path, "2023-01-01")
    publish, seen = commits.publish, []

    def slow(session, at, text):
        monkeypatch.setattr(commits, "publish", publish)
        seen.append(state(spark, path))  # a reader between the rows and the seal sees neither
        put(spark, path, "2023-01-03")  # another date, but the same place in the chain
        publish(session, at, text)

    monkeypatch.setattr(commits, "publish", slow)
    with pytest.raises(commits.Conflict):
        put(spark, path, "2023-01-02")
    assert seen == [([("S1", "2023-01-01"), ("S2", "2023-01-01")], ["2023-01-01"])]
    assert state(spark, path)[1] == ["2023-01-01", "2023-01-03"] and log.verify_log(spark, path).count() == 0
    assert log.unsealed_attempts(spark, path).count() == 0


def test_rows_that_went_missing_are_not_sealed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    real = log.partition_hashes
    monkeypatch.setattr(log, "partition_hashes", lambda rows: real(rows.where("station <> 'S2'")))
    with pytest.raises(ValueError, match="2 rows of 2023-01-01 were to be written, 1 are there"):
        put(spark, path, "2023-01-01")
    assert state(spark, path) == ([], [])


def test_a_date_of_late_rows_is_not_sealed(spark, tmp_path):
    path = str(tmp_path / "log")
    assert put(spark, path, "2023-01-01", "2023-01-05 15:00:00") == {"rows": 0, "late": 3}
    assert state(spark, path) == ([], []) and log.head_hash(spark, path) == log.GENESIS
    assert put(spark, path, "2023-01-01") == {"rows": 2, "late": 1}
    with pytest.raises(ValueError, match="follow"):
        put(spark, path, "2023-01-01")


def test_many_dates_in_one_commit(spark, tmp_path):
    path = str(tmp_path / "log")
    days = ["2023-01-01", "2023-01-02", "2023-01-03"]
    rows = None
    for d in days:
        own = issued(spark, d).withColumn("issued_at", F.to_timestamp_ntz(F.lit(f"{d} 15:00:00" if d != "2023-01-02" else "2023-01-09 00:00:00")))
        rows = own if rows is None else rows.unionByName(own)
    assert log.append_dates(spark, path, rows, ["baseline"]) == {"rows": 4, "late": 5}
    assert state(spark, path)[1] == ["2023-01-01", "2023-01-03"] and log.verify_log(spark, path).count() == 0
    other = str(tmp_path / "one by one")
    put(spark, other, "2023-01-01"), put(spark, other, "2023-01-03")
    assert log.head_hash(spark, other) == log.head_hash(spark, path)
    mixed = rows.where("run_date = date'2023-01-03'").withColumn("issued_at", F.when(F.col("station") == "S2", F.col("runtime")).otherwise(F.col("issued_at")))
    with pytest.raises(ValueError, match="several issue times"):
        log.append_dates(spark, str(tmp_path / "new"), mixed, ["baseline"])
    assert log.append_dates(spark, path, rows.limit(0), ["baseline"]) == {"rows": 0, "late": 0}


def test_slices_change_at_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, TABLE)
    day = lambda k: dt.date(2023, 1, k)
    read = lambda n=None: sorted((r.station, r.d.day, r.v) for r in commits.read_dates(spark, path, TABLE, "d", n).collect())
    swap = lambda rows: sinks.replace_slice(make(rows), path, {"station": "A"}, "d", "2023-01-01", "2023-01-31")
    assert read() == []
    assert swap([("A", day(1), 1), ("A", day(2), 2)]) == 1
    publish = commits.publish

    def stop(*_):
        raise Crash

    monkeypatch.setattr(commits, "publish", stop)
    with pytest.raises(Crash):
        swap([("A", day(2), 20), ("A", day(3), 30)])
    monkeypatch.setattr(commits, "publish", publish)
    assert read() == [("A", 1, 1), ("A", 2, 2)] and len(commits.unused(spark, path, "d")) == 1
    assert swap([("A", day(2), 20), ("A", day(3), 30)]) == 2
    assert read() == [("A", 2, 20), ("A", 3, 30)] and read(1) == [("A", 1, 1), ("A", 2, 2)]

    def slow(session, at, text):
        monkeypatch.setattr(commits, "publish", publish)
        sinks.merge_rows(make([("B", day(5), 5)]), path, ["station"], "d")
        publish(session, at, text)

    monkeypatch.setattr(commits, "publish", slow)
    with pytest.raises(commits.Conflict):
        swap([("A", day(9), 9)])
    assert read() == [("A", 2, 20), ("A", 3, 30), ("B", 5, 5)]
    assert len(commits.sweep(spark, path, "d")) == 2 and read() == [("A", 2, 20), ("A", 3, 30), ("B", 5, 5)]
    assert swap([]) == 4 and read() == [("B", 5, 5)]  # an empty slice takes its rows away
    with pytest.raises(ValueError, match="without d"):
        sinks.merge_rows(make([("B", None, 5)]), path, ["station"], "d")
    assert read() == [("B", 5, 5)]
