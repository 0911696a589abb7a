import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from conftest import SF001
from quarry.operators import models as mdl
from quarry.plans import job
from quarry.plans.tables import table


def _data(spark):
    li = table(spark, SF001, "lineitem")
    va = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features")
    # a label with a known linear relation, so a fitted model must find it
    return va.transform(li).withColumn("label", F.col("l_quantity") * 3.0 - F.col("l_tax") * 10.0 + 1.0)


def test_registry_and_choice(spark):
    reg = mdl.build_models("regression")
    assert list(reg) == list(mdl.REGRESSORS)
    assert list(mdl.choose_models(reg, "manual", "linear_regression")) == ["linear_regression"]
    with pytest.raises(mdl.ModelError):
        mdl.choose_models(reg, "manual", "nope")
    with pytest.raises(mdl.ModelError):
        mdl.choose_models(reg, "auto", model_list=["xgb_regressor"])
    assert len(mdl.choose_models(reg, "auto")) == 3
    with pytest.raises(mdl.ModelError):
        mdl.build_models("ranking")


def test_candidates_deterministic():
    a = mdl.sample_candidates(mdl.SEARCH_SPACES["random_forest_regressor"], 5, 42)
    assert a == mdl.sample_candidates(mdl.SEARCH_SPACES["random_forest_regressor"], 5, 42)
    assert len(a) == 5 and len({tuple(sorted(x.items(), key=str)) for x in a}) == 5
    assert mdl.sample_candidates({}, 5) == []


def test_train_score_and_search(spark):
    d = _data(spark)
    train, test = d.where("l_orderkey % 5 <> 0"), d.where("l_orderkey % 5 = 0")
    res = mdl.train_and_score(train, test, mdl.choose_models(mdl.build_models("regression"), "manual",
                                                             "linear_regression"), "regression")
    assert res[0][3]["r2"] > 0.999
    binary = train.withColumn("label", (F.col("l_quantity") > 25).cast("double"))
    est = mdl.build_models("classification")["logistic_regression"]
    best, params, score = mdl.random_search(binary, "logistic_regression", est, "classification", "f1_weighted",
                                            n_iter=2, cv=2)
    assert set(params) == {"C", "max_iter"} and score > 0.9
    gbt = mdl.build_models("regression")["gradient_boosting_regressor"]
    pm = mdl._translate("gradient_boosting_regressor", {"n_estimators": 50, "learning_rate": 0.05,
                                                        "max_depth": None, "subsample": 0.8}, gbt, 100)
    assert {p.name: v for p, v in pm.items()} == {"maxIter": 50, "stepSize": 0.05, "maxDepth": 30,
                                                  "subsamplingRate": 0.8}
    rf = mdl.build_models("regression")["random_forest_regressor"]
    pm = mdl._translate("random_forest_regressor", {"n_estimators": 200, "min_samples_leaf": 4}, rf, 100)
    assert {p.name: v for p, v in pm.items()} == {"numTrees": 200, "minInstancesPerNode": 4}
    _, p2, s2 = mdl.random_search(train, "linear_regression", mdl.build_models("regression")["linear_regression"],
                                  "regression", "r2")
    assert p2 == {} and s2 is None


def test_full_job_regression_and_failure_marker(spark, tmpdir_path):
    li = table(spark, SF001, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag",
                                                "l_extendedprice")
    opts = job.RunOptions(model_list=("linear_regression",), top_k=1, n_iter=2, cv=2, drift_threshold=10.0,
                          n_features=3)
    res = job.run(spark, li, "l_extendedprice", opts, base_path=tmpdir_path)
    assert res.status == "completed" and res.task_type == "regression" and len(res.features) == 3
    assert res.best_model == "linear_regression" and len(res.model_paths) >= 1
    from quarry.operators import runs
    listed = runs.list_runs(spark, f"{tmpdir_path}/runs").collect()
    assert listed[0]["status"] == "completed"
    with pytest.raises(Exception):
        job.run(spark, li, "no_such_target", opts, base_path=tmpdir_path)
    statuses = {r["status"] for r in runs.list_runs(spark, f"{tmpdir_path}/runs").collect()}
    assert statuses == {"completed", "failed"}


def test_job_spreads_each_prepared_side_once(spark, tmpdir_path, monkeypatch):
    df = spark.range(200).select((F.col("id") % 50).cast("double").alias("a"), (F.col("id") * 1.5).alias("b"),
                                 (F.col("id") * 3.25 + 1).alias("y"))
    spreads, kept = [], mdl.spread
    monkeypatch.setattr(mdl, "spread", lambda *args: spreads.append(1) or kept(*args))
    res = job.run(spark, df, "y", job.RunOptions(model_list=("linear_regression",), top_k=1, drift_threshold=10.0),
                  base_path=tmpdir_path)
    assert res.status == "completed" and len(spreads) == 2


def test_full_job_classification(spark, tmpdir_path):
    li = table(spark, SF001, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_linestatus",
                                                "l_returnflag")
    opts = job.RunOptions(model_list=("logistic_regression",), top_k=1, n_iter=2, cv=2, drift_threshold=10.0)
    res = job.run(spark, li, "l_returnflag", opts, base_path=tmpdir_path)
    assert res.task_type == "classification" and res.best_model == "logistic_regression"
    cmp = res.frames["comparison"].collect()
    assert {r["stage"] for r in cmp} == {"baseline", "tuned"}


def test_one_vs_rest_search_params_reach_inner_learner(spark):
    ovr = mdl.build_models("classification", n_classes=3)["gradient_boosting_classifier"]
    pm = mdl._translate("gradient_boosting_classifier", {"n_estimators": 50, "max_depth": 5}, ovr, 100)
    inner = ovr.copy(pm).getClassifier()          # what CrossValidator's fit(df, paramMap) builds
    assert inner.getMaxIter() == 50 and inner.getMaxDepth() == 5


@pytest.mark.parametrize("low,high", [(1, 2), (-1, 1)])
def test_job_runs_on_numeric_classes(spark, tmpdir_path, low, high):
    rows = [(float(i % 50), float(i % 7), high if i % 50 > 24 else low) for i in range(200)]
    df = spark.createDataFrame([(a + i / 1000, b, y) for i, (a, b, y) in enumerate(rows)], "a double, b double, y int")
    result = job.run(spark, df, "y", job.RunOptions(model_list=("logistic_regression", "gradient_boosting_classifier"),
                                                    top_k=1, n_iter=1, cv=2, drift_threshold=10.0), base_path=tmpdir_path)
    assert result.status == "completed" and result.best_score > 0.9


def test_end_to_end_query_trains_and_tunes_every_model(spark, monkeypatch):
    from quarry.plans import catalog_models
    seen = []

    class Done(Exception):
        pass

    def run(spark, data, target, options=job.RunOptions(), **where):
        seen.append((target, options))
        if len(seen) == 2:
            raise Done
        return job.RunResult(run_id=where["run_id"], status="completed")

    monkeypatch.setattr(job, "run", run)
    with pytest.raises(Done):
        catalog_models.t7_run_and_compare(spark, SF001)
    assert [target for target, _ in seen] == ["l_extendedprice", "l_returnflag"]
    for _, options in seen:
        assert options == job.RunOptions() and not options.model_list
        assert options.top_k >= len(mdl.REGRESSORS) and options.n_iter == 5 and options.cv == 3
