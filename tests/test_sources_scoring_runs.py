import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import checks, runs, scoring
from quarry.sources import preview, readers


def test_read_csv_tokens_and_inference(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "d.csv")
    with open(path, "w") as f:
        f.write("a,b,c,d,e\n1,1.5,x,true,NA\n2,,y,false,\n3,2.5,N/A,true,null\n")
    df = readers.read_csv(spark, path)
    types = dict(df.dtypes)
    assert types == {"a": "bigint", "b": "double", "c": "string", "d": "boolean", "e": "double"}
    rows = df.orderBy("a").collect()
    assert rows[1]["b"] is None and rows[2]["c"] is None and all(r["e"] is None for r in rows)
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, os.path.join(tmpdir_path, "missing.csv"))
    with pytest.raises(readers.EmptyDataError):
        readers.require_rows(df.limit(0))


def test_sinks_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    readers.write_table(df, os.path.join(tmpdir_path, "t.parquet"))
    readers.write_table(df, os.path.join(tmpdir_path, "t_csv"), fmt="csv")
    readers.write_report(df, os.path.join(tmpdir_path, "r"))
    assert readers.read_report(spark, os.path.join(tmpdir_path, "r")).count() == 1
    assert spark.read.parquet(os.path.join(tmpdir_path, "t.parquet")).collect()[0]["v"] == "a"


def test_previews(spark):
    df = spark.createDataFrame([(3, None), (1, "x"), (2, "y")], "k int, v string")
    rows = preview.preview_rows(df, "k", 2).collect()
    assert [(r["k"], r["v"]) for r in rows] == [("1", "x"), ("2", "y")]
    p = preview.data_preview(df, "k", 2).collect()
    assert p[0]["total_rows"] == 3
    s = preview.preview_summary(df)
    assert s["numeric_columns"] == ["k"] and s["categorical_columns"] == ["v"]


def test_checks(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None)], "x double, t string")
    with pytest.raises(checks.CheckError, match="null values"):
        checks.validate_target(df, "t")
    with pytest.raises(checks.CheckError, match="not found"):
        checks.validate_target(df, "nope")
    with pytest.raises(checks.CheckError, match="only null"):
        checks.validate_target(df.where("t IS NULL"), "t")
    assert checks.infer_task_type(df, "x") == "classification"
    assert checks.infer_task_type(df, "x", "Regression") == "regression"
    with pytest.raises(checks.CheckError):
        checks.feature_types(df, ["x"], ["x"])
    assert checks.feature_types(df, ["x"], []) == (["x"], ["t"])
    with pytest.raises(checks.CheckError):
        checks.project_features(df, df, ["x", "t"], target="t")
    rep = checks.required_features(df, ["x", "t"]).collect()
    assert len(rep) == 1 and rep[0]["missing_features"] == ["t"]


def test_log_append_recent_stats(spark, tmpdir_path):
    scored = spark.createDataFrame([(i, float(i), 0.5 + i / 10, i % 2) for i in range(5)],
                                   "id long, prediction double, confidence_score double, f1 int")
    at = F.to_timestamp(F.concat(F.lit("2024-01-0"), (F.col("id") % 2 + 1).cast("string"), F.lit(" 00:00:00")))
    rows = scoring.log_rows(scored, F.concat(F.lit("v"), F.col("f1").cast("string")), "m", "regression", ["f1"],
                            id_col="id", at=at)
    path = os.path.join(tmpdir_path, "log")
    scoring.append_log(rows, path)
    scoring.append_log(rows, path)
    log = scoring.read_log(spark, path)
    assert log.count() == 10 and log.select("dt").distinct().count() == 2
    recent = scoring.recent(log, 3).collect()
    assert recent[0]["created_at"] >= recent[-1]["created_at"] and recent[0]["features"]["f1"] in ("0", "1")
    st = scoring.log_statistics(log).collect()[0]
    assert st["total_predictions"] == 10 and st["unique_models"] == 2 and st["max_confidence"] == 0.9


def test_production_model_and_comparison(spark):
    models = spark.createDataFrame([(3, "c", "Production"), (1, "a", "Staging"), (2, "b", "Production")],
                                   "version int, name string, stage string")
    assert scoring.production_model(models).collect()[0]["version"] == 2
    df = spark.createDataFrame([(1, 10.0, 2.0), (2, 20.0, 3.0)], "k int, y double, x double")
    out = scoring.prediction_comparison(df, ["k"], "y", [("m", lambda f: F.col("x") * 1.23456)]).orderBy("k")
    assert [r["m_prediction"] for r in out.collect()] == [2.4691, 3.7037]


def test_runs_roundtrip(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "runs")
    runs.append_run(runs.summary_row(spark, "r1", task_type="regression", best_score=0.8, metric_label="R2",
                                     rows=100, cv=3), path)
    runs.append_run(runs.summary_row(spark, "r2", task_type="classification", best_score=0.6, cv=5), path)
    listed = runs.list_runs(spark, path)
    assert {r["run_id"] for r in listed.collect()} == {"r1", "r2"}
    assert listed.where("run_id = 'r2'").collect()[0]["metric_label"] == "Score"
    with pytest.raises(KeyError):
        runs.load_run(listed, "zzz")
    cmp = runs.compare_runs(listed, ["r1", "r2"]).orderBy("position").collect()
    assert cmp[0]["parameter"] == "task_type" and cmp[0]["r1"] == "regression" and cmp[0]["metric_label"] == "R2"
    assert cmp[-1]["parameter"] == "best_score" and cmp[-1]["r2"] == "0.6"
    rm = spark.createDataFrame([("r1", "lin", 0.8, 1), ("r1", "rf", 0.7, 2)],
                               "run_id string, display_name string, score double, rank int")
    flat = {(r["key"], r["value"]) for r in runs.flatten_metrics(rm).collect()}
    assert flat == {("lin_score", 0.8), ("rf_score", 0.7), ("best_score", 0.8)}


def test_alias_and_baseline_joins(spark):
    entries = spark.createDataFrame([("p1", "model_1"), ("p2", "model_2")], "model_path string, model_name string")
    aliases = spark.createDataFrame([("p1", "random_forest")], "model_path string, model_name string")
    out = {r["model_path"]: r["display_name"] for r in runs.alias_lookup(entries, aliases).collect()}
    assert out == {"p1": "random_forest", "p2": "model_2"}
    tuned = spark.createDataFrame([("lr",)], "model_name string")
    base = spark.createDataFrame([("lr", "f1", 0.7)], "model_name string, metric string, value double")
    assert runs.baseline_beside_tuned(tuned, base, "f1_weighted").collect()[0]["baseline_test_score"] == 0.7


def test_log_timestamp_text_is_utc_in_any_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(1, 1.0, 1.0)], "id long, prediction double, confidence_score double")
        at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))          # New York wall clock
        row = scoring.log_rows(df, "v", "m", "regression", [], id_col="id", at=at).collect()[0]
        assert row["timestamp"] == "2024-01-01T05:00:00+00:00"
        ntz = F.lit("2024-01-01 00:00:00.25").cast("timestamp_ntz")  # zone-less: read as UTC
        row = scoring.log_rows(df, "v", "m", "regression", [], id_col="id", at=ntz).collect()[0]
        assert row["timestamp"] == "2024-01-01T00:00:00.250000+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_csv_keeps_quotes_breaks_and_blanks(spark, tmpdir_path):
    rows = [(1, 'say "hi", ok'), (2, "two\nlines, \"q\""), (3, " blanks "), (4, 'ends with "')]
    path = readers.write_table(spark.createDataFrame(rows, "i long, t string"), f"{tmpdir_path}/t", fmt="csv")
    assert sorted(map(tuple, readers.read_csv(spark, path, schema={"i": "long", "t": "string"}).collect())) == rows


def test_csv_record_that_does_not_fit_fails(spark, tmpdir_path):
    with open(f"{tmpdir_path}/bad.csv", "w") as f:
        f.write("a,b\n1,2\n3\n4,5,6\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_csv(spark, f"{tmpdir_path}/bad.csv").collect()


def test_log_date_is_utc_and_ids_do_not_repeat(spark, tmpdir_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.sql("SELECT 1.0D AS x, 2.0D AS prediction, 1.0D AS confidence_score, "
                       "timestamp'2026-01-02T01:00:00Z' AS at FROM range(3)")
        for _ in range(2):
            scoring.append_log(scoring.log_rows(df, "v", "m", "regression", ["x"], at=F.col("at")), f"{tmpdir_path}/log")
        log = scoring.read_log(spark, f"{tmpdir_path}/log")
        assert [str(r.dt) for r in log.select("dt").distinct().collect()] == ["2026-01-02"]
        assert log.select("id").distinct().count() == 6
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
