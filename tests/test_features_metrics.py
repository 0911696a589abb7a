import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import features as fx
from quarry.operators import metrics as mx


def test_median_imputer_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "x double")
    assert fx.fit_numeric_imputer(df, ["x"], "median") == {"x": 3.0}
    assert fx.fit_numeric_imputer(df, ["x"], "mean")["x"] == 4.25
    filled = fx.apply_fill(df, {"x": 3.0})
    assert filled.where("x IS NULL").count() == 0
    with pytest.raises(fx.FeatureError):
        fx.fit_numeric_imputer(df, ["x"], "magic")


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "v string")
    assert fx.fit_mode(df, ["v"]) == {"v": "a"}


def test_scalers_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    p = fx.fit_scaler(df, ["x", "c"], "standard")
    assert p["x"] == (2.0, 1.0) and p["c"] == (5.0, 1.0)
    out = fx.apply_scaler(df, p).collect()
    assert [r["x"] for r in out] == [-1.0, 1.0] and [r["c"] for r in out] == [0.0, 0.0]
    mm = fx.fit_scaler(df, ["x", "c"], "minmax")
    assert fx.apply_scaler(df, mm).collect()[1]["x"] == 1.0
    assert fx.fit_scaler(df, ["x"], "none") == {}
    with pytest.raises(fx.FeatureError):
        fx.fit_scaler(df, ["x"], "robust")


def test_ordinal_and_one_hot_unseen(spark):
    train = spark.createDataFrame([("b",), ("a",)], "c string")
    test = spark.createDataFrame([("a",), ("z",)], "c string")
    cats = fx.fit_categories(train, ["c"])
    names = fx.category_names(cats, ["c"])
    assert names == {"c": ["a", "b"]}
    assert sorted(r[0] for r in fx.ordinal_encode(test, cats, ["c"]).collect()) == [-1.0, 0.0]
    oh = fx.one_hot_columns(test, names).collect()
    assert (oh[0]["c_a"], oh[0]["c_b"], oh[1]["c_a"], oh[1]["c_b"]) == (1.0, 0.0, 0.0, 0.0)
    from pyspark.ml.functions import vector_to_array
    pre = fx.Preprocessor.fit(train, [], ["c"])
    arr = {r[0]: r[1] for r in pre.assemble(test, keep=["c"]).select("c", vector_to_array("features")).collect()}
    assert arr == {"a": [1.0, 0.0], "z": [0.0, 0.0]}


def test_output_names_sanitised_and_clash():
    names = fx.output_names(["x"], {"c": ["a[1]", "a_1_", "<b>"]})
    assert names == ["num__x", "cat__c_a_1_", "cat__c_a_1__2", "cat__c__b_"]


def test_label_encode_decode(spark):
    tr = spark.createDataFrame([("y",), ("x",)], "t string")
    te = spark.createDataFrame([("z",)], "t string")
    labels = fx.label_table(tr, te, "t")
    assert [(r[0], r[1]) for r in labels.orderBy("index").collect()] == [(0, "x"), (1, "y"), (2, "z")]
    codes = spark.createDataFrame([("0",), ("2",), ("7",), ("abc",)], "p string")
    out = {r["p"]: r["decoded"] for r in fx.decode_labels(codes, "p", labels).collect()}
    assert out == {"0": "x", "2": "z", "7": "7", "abc": "abc"}


def test_scores_and_top(spark):
    rows = [(float(i), float(i % 2), 1.0, float(2 * i + 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, k double, y double")
    s = {r["feature"]: r["score"] for r in fx.correlation_scores(df, ["a", "b", "k"], "y").collect()}
    assert math.isclose(s["a"], 1.0) and s["k"] == 0.0
    mi = {r["feature"]: r["score"] for r in fx.mutual_information(df, ["a", "b", "k"], "y", False).collect()}
    assert mi["a"] > mi["b"] >= 0 and abs(mi["k"]) < 1e-12
    top = fx.top_features(fx.correlation_scores(df, ["a", "b", "k"], "y"), 5, n_columns=3).collect()
    assert [r["feature"] for r in top] == ["a", "b"]


def test_regression_metrics_match_numpy(spark):
    rng = np.random.default_rng(1)
    y, p = rng.normal(size=200), rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, prediction double")
    r = mx.regression_metrics(df).collect()[0]
    r2 = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert math.isclose(r["r2"], r2, rel_tol=1e-9)
    assert math.isclose(r["mae"], np.abs(y - p).mean(), rel_tol=1e-12)
    assert math.isclose(r["rmse"], math.sqrt(((y - p) ** 2).mean()), rel_tol=1e-12)


def test_classification_metrics_weighted_zero_division(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")]
    df = spark.createDataFrame(pairs, "y string, prediction string")
    r = mx.classification_metrics(df).collect()[0]
    assert r["accuracy"] == 0.5
    # per class: a P=1 R=.5 F=2/3 (w .5); b P=1/3 R=1 F=.5 (w .25); c P=0 R=0 F=0 (w .25)
    assert math.isclose(r["precision"], 0.5 * 1 + 0.25 / 3)
    assert math.isclose(r["recall"], 0.5 * 0.5 + 0.25 * 1)
    assert math.isclose(r["f1"], 0.5 * (2 / 3) + 0.25 * 0.5)


def test_ranking_aliases_ties_and_gate(spark):
    res = spark.createDataFrame([(0, "m0", 0.5, 2.0), (1, "m1", 0.9, 1.0), (2, "m2", 0.9, 3.0)],
                                "seq int, model_name string, f1 double, mae double")
    r = [x["model_name"] for x in mx.rank_models(res, "f1_weighted").orderBy("rank").collect()]
    assert r == ["m1", "m2", "m0"]
    r = [x["model_name"] for x in mx.rank_models(res, "neg_mean_absolute_error").orderBy("rank").collect()]
    assert r == ["m1", "m0", "m2"]
    ranked = mx.rank_models(res, "f1")
    assert mx.performance_gate(ranked, "f1", 0.8)
    with pytest.raises(mx.GateError):
        mx.performance_gate(ranked, "f1", 0.95)
    ref = spark.createDataFrame([("m1", 0.95), ("m2", 0.5)], "model_name string, score double")
    o = {x["model_name"]: x["overfitting_warning"] for x in mx.overfitting(ranked, ref).collect()}
    assert o == {"m0": False, "m1": False, "m2": True}


def test_threshold_sweep_first_best(spark):
    rows = [(1, 0.9), (1, 0.7), (0, 0.3), (0, 0.1), (1, 0.25)]
    df = spark.createDataFrame(rows, "label int, score double")
    sw = mx.threshold_sweep(df, df, "label", "score").orderBy("i").collect()
    assert len(sw) == 25 and sum(r["is_best"] for r in sw) == 1
    best = [r for r in sw if r["is_best"]][0]
    assert math.isclose(best["test_f1"], 6 / 7) and best["i"] == 0   # first of the tied best thresholds
    assert math.isclose(mx.SWEEP[0], 0.2) and math.isclose(mx.SWEEP[-1], 0.8)


@pytest.mark.parametrize("n", [9, 300])
def test_one_hot_has_one_layout_for_any_number_of_categories(spark, n):
    from datetime import datetime, timedelta
    from pyspark.ml.functions import vector_to_array
    at = datetime(2024, 1, 1)
    rows = [(float(i % 7), f"c{i % n:03d}", i % 2 == 0, at + timedelta(days=i % 3)) for i in range(900)]
    train = spark.createDataFrame(rows, "x double, c string, b boolean, t timestamp")
    test = spark.createDataFrame([(1.0, "c005", True, at), (2.0, "zzz", None, None), (3.0, "c005", False, at - timedelta(days=1))],
                                 "x double, c string, b boolean, t timestamp")
    pre = fx.Preprocessor.fit(train, ["x"], ["c", "b", "t"], scaling="none")
    assert len(pre.names) == 1 + n + 2 + 3 and pre.names[1 + n] == "cat__b_false"
    vecs = {r[0]: r[1] for r in pre.assemble(test, keep=["x"]).select("x", vector_to_array("features")).collect()}
    hot = {x: [i for i, v in enumerate(vec) if i and v] for x, vec in vecs.items()}
    assert all(len(v) == 1 + n + 2 + 3 and v[0] == x for x, v in vecs.items())
    # an unseen value is all zeros, a missing one is filled by the most frequent
    assert hot == {1.0: [6, n + 2, n + 3], 2.0: [n + 1, n + 3], 3.0: [6, n + 1]}
    named = {r["num__x"]: [i for i, v in enumerate(r) if i and v] for r in pre.transform(test).collect()}
    assert named == hot


def test_confusion_compares_numbers_of_any_type(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (2, 2.0)], "y int, prediction double")
    row = mx.classification_metrics(df).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (1.0, 1.0, 1.0, 1.0)
