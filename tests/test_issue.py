import datetime as dt

import pytest
from pyspark.sql import functions as F

from veritide.operators import artifacts, contracts, issue, log, models, report, score
from veritide.sources import commits


def panel(spark, days=80):
    at = dt.datetime(2023, 1, 1)
    day = lambda k, h=0: at + dt.timedelta(days=k, hours=h)
    rows = [(s, day(k).date(), day(k, 13), 1, v, day(k + 1).date(), 50.0 + k % 7, day(k + 1, 18), True, float((k * 7 + len(v) + i) % 11 - 5)) for k in range(days) for i, s in enumerate(["KAAA", "KBBB"]) for v in ("max", "min")]
    df = spark.createDataFrame(rows, "station string, run_date date, runtime timestamp_ntz, lead_day int, variable string, target_date date, forecast_f double, window_end timestamp_ntz, scorable boolean, error_f double")
    return df.withColumn("observed_f", F.col("forecast_f") - F.col("error_f"))


def test_issued_rows_equal_the_walk_and_export(spark, tmp_path):
    pairs, path = panel(spark).cache(), str(tmp_path / "log")
    for d in ("2023-03-01", "2023-03-02"):
        assert issue.issue(spark, path, pairs, d, f"{d} 14:00:00")["rows"] == 4
    walk = models.walk_forward(pairs, models.RollingBias(), "2023-03-01", "2023-03-02", "daily")
    want = sorted((r.station, r.run_date, r.variable, r.forecast) for r in walk.collect())
    rows, _ = log.read_log(spark, path)
    assert sorted((r.station, r.run_date, r.variable, r.forecast_f) for r in rows.collect()) == want
    with pytest.raises(ValueError, match="no run"):
        issue.issue(spark, path, pairs, "2024-01-01", "2024-01-01 14:00:00")
    out = str(tmp_path / "out")
    report.export(spark, out, pairs.withColumn("source", F.lit("raw_nbm")), pairs, path, "2023-03-03", n_boot=50, min_blocks=3)
    docs = spark.read.text(f"{out}/stations").withColumnRenamed("value", "document")
    schema = "station string, stats array<struct<variable:string,lead_day:int,season:string,bias:double,mae:double,n:long>>"
    assert contracts.check_contract(docs, schema).count() == 0 and docs.count() == 2
    whole = lambda name: spark.read.text(f"{out}/{name}").select(F.col("value").alias("document"))
    assert contracts.check_contract(whole("manifest"), "generated_at string, data_through string, log_head string, version int").count() == 0
    assert {r.rule for r in contracts.check_contract(whole("index"), "station string, text string, significant boolean, max double, min double, city string").collect()} == {"city is missing"}
    numbers = "variable string, lead_day int, source string, n long, bias double, mae double, no_detectable_bias boolean"
    known = [("source is unknown", ~F.col("doc.source").isin("raw_nbm", "baseline")), ("negative error", F.col("doc.mae") < 0)]
    assert contracts.check_contract(whole("scorecard"), numbers, rules=known).count() == 0
    assert score.flag_errors(spark.read.json(f"{out}/scorecard")).count() == 0
    card = {r.source for r in spark.read.json(f"{out}/scorecard").collect()}
    assert card == {"raw_nbm", "baseline"}
    assert spark.read.json(f"{out}/manifest").first().log_head == log.head_hash(spark, path)
    assert all("max" in r.value for r in spark.read.text(f"{out}/index").collect())
    pairs.unpersist()


def test_contract_reports_bad_documents(spark):
    docs = spark.createDataFrame([('{"station": "A", "n": 1}',), ('{"station": null, "n": 2}',), ("no json",), ('{"station": "B", "n": -3}',)], "document string")
    got = {r.rule: r.n for r in contracts.check_contract(docs, "station string, n int", rules=[("n is negative", F.col("doc.n") < 0)]).collect()}
    assert got == {"not a document": 1, "station is missing": 1, "n is negative": 1}


def test_artifact_is_verified(spark, tmp_path):
    pairs = panel(spark, 40)
    c = models.GbtCorrector(min_rows=10, trees=2, depth=2, regions=["north", "south"])
    model = c.fit(pairs.select("station", "run_date", "runtime", "lead_day", "variable", "target_date", "forecast_f", "window_end", "error_f"))
    path = str(tmp_path / "m")
    facts = issue.save_artifact(c, model, path, "2023-02-01", pairs)
    assert issue.load_artifact(c, facts, pairs).getNumTrees == 2
    with pytest.raises(ValueError, match="stations"):
        issue.load_artifact(c, facts, pairs.where("station = 'KAAA'"))
    with pytest.raises(ValueError, match="region codes"):  # another list silently renumbers a feature
        issue.load_artifact(models.GbtCorrector(regions=["south", "north"]), facts, pairs)
    with pytest.raises(ValueError, match="changed"):
        issue.load_artifact(c, {**facts, "model_hash": "0" * 64}, pairs)
    with pytest.raises(commits.Conflict):  # one artifact for a refit date
        issue.save_artifact(c, None, path, "2023-02-01", pairs)
    none = issue.save_artifact(c, None, path, "2023-03-01", pairs)
    assert none["model_path"] is None and issue.load_artifact(c, none, pairs) is None
    assert artifacts.read_artifacts(spark, path).count() == 2


def test_month_artifact_is_the_first_sealed_one(spark):
    day = lambda m, d: dt.date(2023, m, d)
    made = [(day(3, 1), "orphan"), (day(3, 2), "a"), (day(3, 5), "b"), (day(4, 3), "c"), (day(6, 9), "d")]
    known = spark.createDataFrame([(d, None, None, None, None, h, None, None, None) for d, h in made], artifacts.ARTIFACTS)
    seals = spark.createDataFrame([(d,) for d in (day(3, 2), day(3, 5), day(5, 1))], "run_date date")
    runs = spark.createDataFrame([(d,) for d in (day(3, 1), day(3, 2), day(3, 3), day(3, 9), day(4, 2), day(4, 3), day(4, 4), day(5, 2), day(6, 9), day(6, 9))], "run_date date")
    got = {r.run_date: r.model_hash for r in artifacts.month_artifacts(known, seals, runs).collect()}
    assert got == {day(3, 1): "orphan", day(3, 2): "a", day(3, 3): "a", day(3, 9): "a", day(4, 2): None, day(4, 3): "c", day(4, 4): None, day(5, 2): None, day(6, 9): "d"}
    assert artifacts.month_artifacts(known.limit(0), seals, runs).where("model_hash is not null").count() == 0


def test_challenger_is_issued_as_the_walk_has_it(spark, tmp_path):
    pairs, path = panel(spark).cache(), str(tmp_path / "log")
    c = models.GbtCorrector(min_rows=20, trees=3, depth=2)
    assert issue.issue(spark, path, pairs, "2023-03-01", "2023-03-01 14:00:00", challenger=c)["rows"] == 8
    assert issue.issue(spark, path, pairs, "2023-03-02", "2023-03-02 14:00:00", challenger=c)["rows"] == 8
    known = artifacts.read_artifacts(spark, path).collect()
    assert [(str(r.retrained_on), r.n_train_rows) for r in known] == [("2023-03-01", 4 * 58)]
    rows, seals = log.read_log(spark, path)
    assert log.verify_rows(rows, seals).count() == 0
    walk = models.walk_forward(pairs, c, "2023-03-01", "2023-03-02").collect()
    mine = {(r.station, r.run_date, r.variable): r for r in rows.where("source = 'challenger'").collect()}
    assert len(mine) == 8 and set(mine) == {(r.station, r.run_date, r.variable) for r in walk}
    for r in walk:
        own = mine[r.station, r.run_date, r.variable]
        assert own.forecast_f == pytest.approx(r.forecast) and (own.retrained_on, own.trained_through, own.fallback) == (r.retrained_on, r.trained_through, r.fallback)
        assert '"trees":3' in own.params
    assert {r.params for r in rows.where("source = 'baseline'").collect()} == {'{"days":30,"min_pairs":15,"model":"baseline"}'}
    # a night that was never issued leaves an orphan: the next one refits
    issue.governing(spark, path, c, pairs, "2023-03-20")
    late = issue.issue(spark, str(tmp_path / "other"), pairs, "2023-03-10", "2023-03-12 14:00:00", challenger=c)
    assert late == {"rows": 0, "late": 8} and log.read_seals(spark, str(tmp_path / "other")).count() == 0
    assert issue.issue(spark, str(tmp_path / "other"), pairs, "2023-03-11", "2023-03-11 14:00:00", challenger=c)["rows"] == 8
    assert artifacts.read_artifacts(spark, str(tmp_path / "other")).count() == 2
    # too few pairs: a fallback artifact governs the month
    few = models.GbtCorrector(min_rows=10_000)
    for d in ("2023-02-01", "2023-02-02"):
        issue.issue(spark, str(tmp_path / "few"), pairs, d, f"{d} 14:00:00", challenger=few)
    assert artifacts.read_artifacts(spark, str(tmp_path / "few")).collect()[0].model_path is None
    assert log.read_log(spark, str(tmp_path / "few"))[0].where("source = 'challenger' and fallback and forecast_f = raw_forecast_f and retrained_on = date'2023-02-01'").count() == 8
    pairs.unpersist()


def test_refits_match_a_fit_by_hand(spark):
    pairs = panel(spark).withColumns({"spread_f": F.lit(1.0), "tmp_f": F.col("forecast_f") - 3, "cycle_hour": F.lit(13)})
    dim = spark.createDataFrame([("KAAA", 40.0, -100.0, 300, True, "north"), ("KBBB", 41.0, None, 20, False, None)], "station string, lat double, lon double, elevation_m int, is_coastal boolean, climate_region string")
    c = models.GbtCorrector(min_rows=100, trees=3, depth=2, stations=dim, regions=["south", "north"])
    assert len(c.FEATURES) == 18
    walk = models.walk_forward(pairs, c, "2023-01-01", "2023-03-20")
    got = {(r.station, r.run_date, r.variable): r for r in walk.collect()}
    assert len(got) == 79 * 4 and all(r.fallback for r in got.values() if r.run_date < dt.date(2023, 2, 1))
    closed = pairs.select(*models.GROUP, "run_date", "runtime", "target_date", "window_end", "error_f", "forecast_f", "spread_f", "tmp_f", "cycle_hour")
    cut = dt.datetime(2023, 3, 1, 13)
    model = c.fit(closed.where(F.col("window_end") < F.lit(cut)))
    rows = pairs.where("run_date = date'2023-03-10'").select(*models.PREDICT_COLUMNS).withColumn("known_until", F.lit(cut))
    for r in c.predict(model, rows, closed).collect():
        assert got[r.station, r.run_date, r.variable].forecast == pytest.approx(r.forecast) and not r.fallback


def test_a_scorecard_refuses_conflicting_raw_forecasts(spark, tmp_path):
    pairs, path = panel(spark).cache(), str(tmp_path / "log")
    issue.issue(spark, path, pairs, "2023-03-01", "2023-03-01 14:00:00")
    rows, _ = log.read_log(spark, path)
    other = rows.where("station = 'KAAA'").withColumns({"source": F.lit("challenger"), "raw_forecast_f": F.col("raw_forecast_f") + 1})
    assert report.scorecard_rows(rows, pairs).count() == 8
    with pytest.raises(ValueError, match="disagree"):
        report.scorecard_rows(rows.unionByName(other), pairs)
    pairs.unpersist()


def test_refits_run_together_only_while_their_rows_fit(spark, monkeypatch):
    """Large refits go one by one; columns that never vary or repeat a flag are not fitted on (11 of 31 are left)."""
    pairs = panel(spark, 120).withColumns({"spread_f": F.col("forecast_f") % 3, "cycle_hour": F.lit(13)})
    busy, most, widths = [], [], []
    fit_on = models.GbtCorrector.fit_on

    def watched(self, train, n):
        busy.append(n)
        most.append(list(busy))
        try:
            widths.append(len(train.first().features))
            return fit_on(self, train, n)
        finally:
            busy.remove(n)

    monkeypatch.setattr(models.GbtCorrector, "fit_on", watched)
    monkeypatch.setattr(models, "ROWS_AT_A_TIME", 400, raising=False)
    got = models.walk_forward(pairs, models.GbtCorrector(min_rows=100, trees=1, depth=1), "2023-01-01", "2023-04-30")
    assert got.where("not fallback").count() == 4 * 89
    assert len(most) == 3 and all(sum(b) <= 400 or len(b) == 1 for b in most)
    assert set(widths) == {11}
