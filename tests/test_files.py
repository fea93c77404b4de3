import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from veritide.functions import text
from veritide.operators import contracts, log
from veritide.sources import commits, readers, sinks
from veritide.streaming import ingest


@pytest.fixture
def regimes(spark):
    return spark.sql("select 13 as cycle_hour, date'2020-01-01' as valid_from, date'2026-04-30' as valid_to union all select 12, date'2026-05-01', null")


def test_guidance_by_header_name(spark, tmp_path, regimes):
    (tmp_path / "a.csv").write_text("runtime,ftime,model,tmp,station,txn,xnd\n2023-07-14 13:00:00,2023-07-15 12:00:00,N,91,KPHX,93,2\n2023-07-14 07:00:00,2023-07-15 12:00:00,N,90,KPHX,92,\n")
    (tmp_path / "b.csv").write_text("station,slv,runtime,ftime,tmp,xnd,txn\nKORD,9,2026-05-06 12:00:00,2026-05-07 00:00:00,70,,\nKORD,9,2026-05-06 13:00:00,2026-05-07 00:00:00,70,,71\n")
    got = sorted(tuple(r) for r in readers.read_guidance(spark, [str(tmp_path / "*.csv")], regimes).select("station", "txn", "xnd", "tmp", "cycle_hour").collect())
    assert got == [("KORD", None, None, 70.0, 12), ("KPHX", 93.0, 2.0, 91.0, 13)]
    (tmp_path / "c.csv").write_text("station,runtime\nKPHX,2023-07-14 13:00:00\n")
    with pytest.raises(ValueError, match="ftime"):
        readers.read_guidance(spark, [str(tmp_path / "c.csv")], regimes)


def test_hourly_and_remarks(spark, tmp_path):
    (tmp_path / "o.csv").write_text("station,valid,tmpf,metar\nPHX,2023-07-14 05:51,M,KPHX 1 RMK AO2 10472 20317\nPHX,2023-07-14 11:51,93.0,KPHX RMK 10472 10480 21005\nXXX,2023-07-14 05:51,1,M\nPHX,2023-07-14 12:51,,10472 RMK A\n")
    stations = spark.createDataFrame([("KPHX",)], "station string")
    rows, gaps = readers.read_hourly(spark, [str(tmp_path / "o.csv")], stations)
    got = sorted((r.valid.hour, r.tmpf, r.max_6h_f, r.min_6h_f) for r in rows.collect())
    assert got == [(5, None, pytest.approx(116.96), pytest.approx(89.06)), (11, 93.0, None, pytest.approx(31.1)), (12, None, None, None)]
    assert [r.reason for r in gaps.collect()] == ["ambiguous_six_hour_max@11:51"]
    with pytest.raises(Exception, match="ambiguous"):
        spark.createDataFrame([("RMK 10472 10480",)], "m string").select(text.strict_groups("m")["max_6h_f"]).collect()


def test_daily_seed_geo_headers(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"station": "KPHX", "results": [{"valid": "2023-07-14", "high": "110", "low": "M"}, {"valid": "2023-07-14", "high": "111", "low": "90"}, {"valid": "2023-07-15", "high": "M", "low": "M"}, {"valid": "2024-01-01", "high": "1", "low": "1"}]}))
    assert [tuple(r) for r in readers.read_daily(spark, [str(tmp_path / "d.json")], "2023-01-01", "2023-12-31").collect()] == [("KPHX", dt.date(2023, 7, 14), 111, 90)]
    (tmp_path / "s.csv").write_text("icao,lat\nKPHX,33.4\nKPHX,33.5\n")
    with pytest.raises(ValueError, match="KPHX"):
        readers.read_seed(spark, str(tmp_path / "s.csv"), "icao string, lat double", ["icao"])
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"id": "PHX", "geometry": {"coordinates": [-112.0, 33.4]}, "properties": {"sid": "PHX", "sname": "PHOENIX", "state": "AZ", "elevation": 337.4}}]}))
    r = readers.read_stations(spark, [str(tmp_path / "g.json")]).first()
    assert (r.station, r.label, r.lat, r.lon, r.elevation_m) == ("PHX", "PHOENIX, AZ", 33.4, -112.0, 337)
    (tmp_path / "l.json").write_text(json.dumps({"features": [{"geometry": {"coordinates": [[0, 0], [1, 1], [5, 5], [6, 6]]}}]}))
    assert readers.read_segments(spark, [str(tmp_path / "l.json")]).count() == 3
    assert readers.read_segments(spark, [str(tmp_path / "l.json")], (0, 0, 2, 2)).count() == 2
    (tmp_path / "h.txt").write_text("x\n KPHX   NBM V4.1 NBS\nNBM V4.2\n")
    assert readers.read_headers(spark, [str(tmp_path / "h.txt")], r"NBM (V[0-9.]+)").first().version == "V4.1"


def test_labels(spark):
    cases = {"LITTLE FORK-ALDER NV, NV": "Little Fork-Alder NV, NV", "OAK CO., GA": "Oak Co., GA", "MCALLEN ROAD/BRONSON, TX": "McAllen Road/Bronson, TX", "ELMTON(EAST), VT": "Elmton(East), VT", "O'DELL": "O'Dell", "X CO, CO": "fixed"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.t for r in df.select("s", text.label_case("s", {"X CO, CO": "fixed"}).alias("t")).collect()}
    assert got == cases


def test_replace_slice_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "station string, d date, v int")
    day = lambda k: dt.date(2023, 1, k)
    sinks.replace_slice(make([("A", day(k), k) for k in (1, 2, 3)]), path, {"station": "A"}, "d", "2023-01-01", "2023-01-31")
    sinks.replace_slice(make([("B", day(k), k) for k in (2, 3)]), path, {"station": "B"}, "d", "2023-01-01", "2023-01-31")
    for _ in range(2):
        sinks.replace_slice(make([("A", day(2), 20)]), path, {"station": "A"}, "d", "2023-01-01", "2023-01-02")
        got = sorted((r.station, r.d.day, r.v) for r in commits.read_dates(spark, path, "station string, d date, v int", "d").collect())
        assert got == [("A", 2, 20), ("A", 3, 3), ("B", 2, 2), ("B", 3, 3)]
    with pytest.raises(ValueError):
        sinks.replace_slice(make([("B", day(2), 1)]), path, {"station": "A"}, "d", "2023-01-01", "2023-01-02")


def issued(spark, date, n=3):
    at = dt.datetime.fromisoformat(date)
    rows = [(f"S{k}", at.date(), at + dt.timedelta(hours=13), 1, "max", at.date() + dt.timedelta(1), "baseline", at + dt.timedelta(hours=14 + 10 * k), 50.5 + k, 50.0) for k in range(n)]
    return spark.createDataFrame(rows, "station string, run_date date, runtime timestamp_ntz, lead_day int, variable string, target_date date, source string, window_end timestamp_ntz, forecast_f double, raw_forecast_f double")


def test_log_appends_seals_and_detects(spark, tmp_path):
    path = str(tmp_path / "log")
    put = lambda d, rows, now=None: log.append_partition(spark, path, d, rows, now or f"{d} 15:00:00", ["baseline"])
    assert put("2023-01-01", issued(spark, "2023-01-01")) == {"rows": 2, "late": 1}
    assert put("2023-01-02", issued(spark, "2023-01-02")) == {"rows": 2, "late": 1}
    assert log.verify_log(spark, path).count() == 0 and len(log.head_hash(spark, path)) == 64
    log.assert_immutable(spark, path)
    for d, rows, word in [("2023-01-02", issued(spark, "2023-01-02"), "follow"), ("2023-01-03", issued(spark, "2023-01-04"), "another"), ("2023-01-03", issued(spark, "2023-01-03").withColumn("forecast_f", F.lit(float("nan"))), "finite"), ("2023-01-03", issued(spark, "2023-01-03").withColumn("source", F.lit("q")), "source"), ("2023-01-03", issued(spark, "2023-01-03").unionByName(issued(spark, "2023-01-03")), "repeated")]:
        with pytest.raises(ValueError, match=word):
            put(d, rows)
    with pytest.raises(ValueError, match="after now"):
        put("2023-01-03", issued(spark, "2023-01-03"), "2023-01-03 12:00:00")
    rows, seals = log.read_log(spark, path)
    rows, seals = spark.createDataFrame(rows.collect(), rows.schema), spark.createDataFrame(seals.collect(), seals.schema)
    seen = lambda r, s: {(str(x.run_date), x.problem) for x in log.verify_rows(r, s).collect()}
    assert seen(rows, seals) == set()
    assert ("2023-01-01", "hash") in seen(rows.withColumn("forecast_f", F.when(F.col("station") == "S2", 1.0).otherwise(F.col("forecast_f"))), seals)
    assert ("2023-01-01", "row count") in seen(rows.where("not (station = 'S2' and run_date = date'2023-01-01')"), seals)
    assert ("2023-01-02", "unsealed rows") in seen(rows, seals.where("run_date = date'2023-01-01'"))
    assert ("2023-01-02", "chain") in seen(rows, seals.where("run_date = date'2023-01-02'"))
    assert ("2023-01-02", "issue time") in seen(rows, seals.withColumn("issued_at", F.lit("2023-01-01 15:00:00").cast("timestamp_ntz")))
    s = log.log_summary(rows, seals).first()
    assert (s.n_late, s.n_rows, s.n_partitions) == (2, 4, 2)


def test_constraints(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "z")], "k int, v string")
    got = {r.rule: r.n for r in contracts.violations(df, [contracts.not_null("k"), contracts.accepted("v", ["a", "b"])], [["k"]], [("v", df.where("v <> 'b'"), "v")]).collect()}
    assert got == {"k is null": 1, "v is not an accepted value": 1, "k repeats": 1, "v has no v": 1}


def test_streams(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(k % 2, at + dt.timedelta(hours=k), float(k)) for k in range(48)]
    spark.createDataFrame(rows, "entity int, valid timestamp, reading double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity int, valid timestamp, reading double").parquet(str(tmp_path / "in"))
    q = ingest.resolved_windows(stream).writeStream.outputMode("complete").format("memory").queryName("windows_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("windows_out").where("entity = 0").orderBy("window_start").collect()
    assert [(r.n_obs, r.high, r.low) for r in got[:2]] == [(3, 4.0, 0.0), (3, 10.0, 6.0)] and len(got) == 8
    out = str(tmp_path / "slices")
    part = stream.selectExpr("cast(entity as string) as station", "cast(valid as date) as d", "reading")
    q = part.writeStream.foreachBatch(ingest.slice_writer(out, ["station", "reading"], "d")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert commits.read_dates(spark, out, part.schema, "d").count() == 48
    pairs = stream.selectExpr("entity", "valid as window_end", "reading as error_f")
    q = ingest.running_means(pairs, ["entity"]).writeStream.outputMode("update").format("memory").queryName("means_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.entity, r.n, r.mean_3, r.mean_7) for r in spark.table("means_out").collect()} == {(0, 7, 44.0, 40.0), (1, 7, 45.0, 41.0)}


def test_a_later_batch_leaves_what_a_day_has(spark, tmp_path):
    out = str(tmp_path / "merged")
    day = lambda k: dt.date(2023, 5, k)
    write = ingest.slice_writer(out, ["station", "hour"], "d")
    batch = lambda rows: spark.createDataFrame(rows, "station string, hour int, d date, reading long")
    write(batch([("A", 0, day(1), 1), ("A", 0, day(5), 5), ("A", 0, day(10), 10), ("B", 0, day(1), 7)]), 0)
    second = batch([("A", 6, day(1), 2), ("A", 0, day(10), 11), (None, 0, day(10), 3)])
    for k in (1, 2):  # a replay changes nothing
        write(second, k)
        got = sorted((str(r.station), r.hour, r.d.day, r.reading) for r in commits.read_dates(spark, out, second.schema, "d").collect())
        assert got == [("A", 0, 1, 1), ("A", 0, 5, 5), ("A", 0, 10, 11), ("A", 6, 1, 2), ("B", 0, 1, 7), ("None", 0, 10, 3)]
    assert commits.unused(spark, out, "d") and commits.sweep(spark, out, "d") and not commits.unused(spark, out, "d")


def test_stream_means_equal_the_batch_form_on_nulls(spark, tmp_path):
    from veritide.operators import asof

    at = lambda k: dt.datetime(2023, 5, 1) + dt.timedelta(days=k)
    errors = [1.0, None, 3.0, 4.0, None, None, 7.0, 8.0, None]
    rows = [("A", at(k), at(k), e) for k, e in enumerate(errors)]
    df = spark.createDataFrame(rows, "entity string, window_end timestamp_ntz, runtime timestamp_ntz, error_f double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).drop("runtime")
    q = ingest.running_means(stream, ["entity"]).writeStream.outputMode("update").format("memory").queryName("null_means").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("null_means").first()
    want = asof.pair_stats(df, ["entity"]).orderBy(F.desc("window_end")).first()
    assert (got.mean_3, got.mean_7) == (pytest.approx(want.mean_3), pytest.approx(want.mean_7)) == (7.5, 5.5)


def test_extract_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(3, "c", None), (1, "a", 1.5), (2, None, 2.5)], "id int, name string, x double")
    got = sinks.write_extract(df, str(tmp_path / "e"), ["id"])
    assert got.schema == df.schema and [r.id for r in got.collect()] == [1, 2, 3]
    sinks.write_csv(df.orderBy("id"), str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True, schema="id int, name string, x double")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    wide = sinks.evolve(df, df.withColumn("extra", F.lit(1)))
    assert wide.count() == 6 and wide.where("extra is null").count() == 3
