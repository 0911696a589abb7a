import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import quantiles
from quarry.functions.exprs import nan_to_null
from quarry.functions.quantiles import group_quantiles, quantile_table

P = (.25, .5, .75)


@pytest.mark.parametrize("small", [0, 20_000])
def test_exact_quantiles_match_pandas_with_groups_nulls_and_ties(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL_GROUP", small)
    monkeypatch.setattr(quantiles, "BUCKETS", 16)
    monkeypatch.setattr(quantiles, "MARGIN", 0.05)
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 3000, p=[.6, .3, .1]),
                        "x": np.round(rng.lognormal(0, 2, 3000), 2), "y": rng.integers(0, 4, 3000).astype(float)})
    pdf.loc[::5, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", nan_to_null("x"))
    res = quantile_table(df, ["x", "y"], P, group_cols=["g"])
    assert len(res) == 4
    for r in res:
        s = pdf[pdf.g == r["g"]][r["column"]].dropna()
        assert r["n"] == len(s)
        np.testing.assert_allclose(r["q"], [s.quantile(p) for p in P], rtol=1e-12)


@pytest.mark.parametrize("kind", ["lognormal", "outlier", "two values", "infinite", "subnormal"])
def test_large_group_of_any_shape(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.lognormal(0, 4, 50_000)
    if kind == "outlier":
        x[0], x[1] = 1e300, -1e308
    elif kind == "two values":
        x = rng.choice([0.0, 1e-300], 50_000)
    elif kind == "infinite":
        x[:20_000], x[20_000:30_000] = -np.inf, np.inf
    elif kind == "subnormal":
        x = rng.integers(0, 50, 50_000) * 5e-324
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 1.0]
    (r,) = group_quantiles(df, [], "x", probs).collect()
    ordered = np.sort(x)
    want = []
    for p in probs:
        at = p * (len(x) - 1)
        a, b = ordered[int(at)], ordered[min(int(at) + 1, len(x) - 1)]
        want.append(a if a == b else a + (b - a) * (at - int(at)))
    assert r["n"] == len(x)
    np.testing.assert_allclose(r["q"], want, rtol=1e-12)


def test_nothing_is_collected_for_groups(spark, monkeypatch):
    from pyspark.sql import DataFrame
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.r_[np.zeros(30_000, int), rng.integers(1, 900, 9_000)], "x": rng.normal(size=39_000).round(3)})
    df = spark.createDataFrame(pdf)
    with monkeypatch.context() as m:
        m.setattr(type(df), "collect", lambda self: pytest.fail("collected"))
        out = group_quantiles(df, ["g"], "x", [0.1, 0.5, 0.9])
    assert isinstance(out, DataFrame)
    got = {r["g"]: r["q"] for r in out.collect()}
    want = pdf.groupby("g")["x"].quantile([0.1, 0.5, 0.9]).unstack()
    assert set(got) == set(want.index)
    for g, q in got.items():
        np.testing.assert_allclose(q, want.loc[g], rtol=1e-9, atol=1e-12)


def test_interpolation_example_from_survey(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    (r,) = quantile_table(df, ["x"], P)
    assert r["q"] == [1.75, 3.0, 5.5]


def test_constant_and_single_value_and_all_null(spark):
    df = spark.createDataFrame([(5.0, None, 1.0), (5.0, None, None)], "a double, b double, c double")
    res = {r["column"]: r for r in quantile_table(df, ["a", "b", "c"], [0.5])}
    assert res["a"]["q"] == [5.0] and res["c"]["q"] == [1.0] and "b" not in res
    assert quantile_table(df.limit(0), ["a"], [0.5]) == [] and group_quantiles(df, [], "b", [0.5]).count() == 0


def test_approx_method_runs(spark):
    df = spark.range(0, 1000).select(F.col("id").cast("double").alias("x"))
    (r,) = quantile_table(df, ["x"], [0.5], method="approx")
    assert abs(r["q"][0] - 499.5) < 5
