import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import profile
from quarry.sources.readers import from_frame


@pytest.fixture()
def edge(spark):
    import pandas as pd
    pdf = pd.DataFrame({"num": [1.0, 2.0, float("nan"), 7.0, 3.0, None],
                        "const": [4.0] * 6,
                        "allnull": [None] * 6,
                        "cat": ["b", "a", "b", "a", None, "c"],
                        "flag": [True, False, True, True, False, True]})
    pdf["allnull"] = pdf["allnull"].astype(float)
    return from_frame(spark, pdf)


def test_nan_normalised_and_missing_values(spark, edge):
    m = {r["column_name"]: r for r in profile.missing_values(edge).collect()}
    assert m["num"]["missing_count"] == 2            # NaN and None are both missing
    assert m["allnull"]["missing_count"] == 6
    assert m["cat"]["missing_count"] == 1
    assert "const" not in m
    assert math.isclose(m["num"]["missing_pct"], 100 * 2 / 6)


def test_numeric_summary_excludes_bool_and_all_null(spark, edge):
    rows = {r["column_name"]: r for r in profile.numeric_summary(edge).collect()}
    assert set(rows) == {"num", "const"}
    r = rows["num"]
    assert r["count"] == 4 and r["median"] == 2.5 and r["min"] == 1.0 and r["max"] == 7.0
    assert math.isclose(r["skewness"], 0.8332, abs_tol=1e-4)   # population form on {1,2,3,7}
    assert math.isclose(r["kurtosis"], -0.9020, abs_tol=1e-4)
    assert rows["const"]["skewness"] is None and rows["const"]["kurtosis"] is None


def test_overview_duplicates_and_empty(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    r = profile.overview(df).collect()[0]
    assert (r["n_rows"], r["n_columns"], r["duplicates"]) == (3, 2, 1)
    e = profile.overview(df.limit(0)).collect()[0]
    assert e["n_rows"] == 0 and e["duplicate_pct"] is None


def test_categorical_summary_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), ("b",), (None,)], "v string")
    rows = profile.categorical_summary(df, top=2).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in rows] == [("a", 2), ("b", 2)]
    assert rows[0]["unique_count"] == 3
    assert math.isclose(rows[0]["pct"], 100 * 2 / 6)


def test_correlation_constant_is_null_and_pairwise(spark, edge):
    m = {(r["feature_1"], r["feature_2"]): r["correlation"] for r in profile.correlation_matrix(edge).collect()}
    assert m[("num", "const")] is None
    assert math.isclose(m[("num", "num")], 1.0)
    assert len(m) == 9 and m[("allnull", "num")] is None


def test_constant_columns_all_types(spark, edge):
    rows = {r["column_name"]: r for r in profile.constant_columns(edge).collect()}
    assert rows["const"]["type"] == "constant"
    assert rows["allnull"]["type"] == "constant" and rows["allnull"]["unique_values"] == 0


def test_outliers_and_skew(spark):
    vals = [(float(x),) for x in [1, 2, 2, 3, 3, 3, 4, 4, 5, 100]]
    df = spark.createDataFrame(vals, "x double")
    o = profile.outliers(df).collect()
    assert len(o) == 1 and o[0]["count"] == 1 and math.isclose(o[0]["percentage"], 10.0)
    s = profile.skewed_columns(df).collect()
    assert s[0]["direction"] == "right" and s[0]["severity"] == "high"


def test_recommendations_priority_order(spark):
    rows = [(float(i), 1.0, float(i) * 2 + 0.001 * (i % 3), float(i % 2)) for i in range(50)] + [(1000.0, 1.0, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, k double, b double, c double")
    recs = profile.recommendations(df).orderBy("rank").collect()
    prios = [r["priority"] for r in recs]
    assert prios == sorted(prios, key=["high", "medium", "low"].index)
    assert any(r["feature"] == "k" and r["recommendation"] == "Remove this feature" for r in recs)


def test_class_distribution_includes_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "t string")
    d = {r["class"]: r["share"] for r in profile.class_distribution(df, "t").collect()}
    assert d == {"a": 0.5, None: 0.25, "b": 0.25}
    assert profile.majority_share(df, "t") == 0.5


def test_plot_field_summary(spark):
    df = spark.createDataFrame([(1.0, "z"), (3.0, "y"), (None, "z")], "x double, c string")
    n = profile.plot_field_summary(df, "x").collect()[0]
    assert (n["min"], n["max"], n["mean"]) == (1.0, 3.0, 2.0)
    c = [r["value"] for r in profile.plot_field_summary(df, "c").orderBy("rank").collect()]
    assert c == ["y", "z"]


def test_heatmap_drops_unknown_and_raises(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a")], "x double, y double, s string")
    assert profile.heatmap(df, ["x", "nope", "s", "y"]).count() == 4
    with pytest.raises(ValueError):
        profile.heatmap(df, ["x", "s"])


def test_raw_frame_with_nan_is_handled_without_loader(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 4.0), (3.0, None), (5.0, 8.0)], "a double, b double")
    rows = {r["column_name"]: r for r in profile.numeric_summary(df).collect()}
    assert rows["a"]["count"] == 3 and rows["a"]["mean"] == 3.0 and rows["a"]["median"] == 3.0
    m = {(r["feature_1"], r["feature_2"]): r["correlation"] for r in profile.correlation_matrix(df).collect()}
    assert math.isclose(m[("a", "b")], 1.0)          # pairs (1,2) and (5,8) only


def test_wide_correlations_take_as_many_jobs_as_narrow_ones(spark):
    def jobs(k):
        df = spark.range(50).select(*[((F.col("id") * (i + 3)) % 17).cast("double").alias(f"c{i}") for i in range(k)])
        spark.sparkContext.setJobGroup(f"corr{k}", "")
        m = profile.correlation_matrix(df)
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"corr{k}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n, m.count()
    few, many = jobs(3), jobs(30)
    assert few[0] == many[0] and many[1] == 900
