import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import split, validate


def _sides(spark):
    train = spark.createDataFrame([(float(i), i % 3, "a" if i % 4 else "b") for i in range(40)],
                                  "x double, k int, t string")
    test = spark.createDataFrame([(float(i) + 100, i % 3, "a" if i % 2 else "b") for i in range(10)],
                                 "x double, k int, t string")
    return train, test


def test_integrity_raises_on_empty_and_reports_mismatch(spark):
    train, test = _sides(spark)
    with pytest.raises(validate.ValidationError):
        validate.integrity(train.limit(0), test)
    ok, frame = validate.integrity(train, test.drop("k"))
    assert not ok and frame.collect()[0]["column_mismatch"] == "k"


def test_schema_states(spark):
    train, test = _sides(spark)
    ok, frame = validate.schema_check(train, test, {"x": "double", "k": "bigint", "z": "string"})
    states = {r["column_name"]: r["state"] for r in frame.collect()}
    assert states == {"x": "ok", "k": "type_mismatch", "z": "missing", "t": "unexpected"}
    assert not ok
    ok2, _ = validate.schema_check(train, test, None)
    assert ok2


def test_missing_rates_round_before_compare(spark):
    tr = spark.createDataFrame([(None,)] * 2 + [(1.0,)] * 8, "x double")
    te = spark.createDataFrame([(1.0,)] * 10, "x double")
    ok, frame = validate.missing_rates(tr, te, threshold=0.2)
    r = frame.collect()[0]
    assert r["train_missing"] == 0.2 and r["test_missing"] == 0.0 and ok


def test_target_check_raises_and_warns(spark):
    train, test = _sides(spark)
    with pytest.raises(validate.ValidationError):
        validate.target_check(train.where("t = 'a'"), test, "t")
    ok, frame, warn = validate.target_check(train, test, "t", threshold=0.7)
    assert ok and warn


def test_drift_formula(spark):
    train, test = _sides(spark)
    ok, frame = validate.drift(train, test, target="t", threshold=0.5)
    r = {x["column_name"]: x for x in frame.collect()}["x"]
    tm, ts = 19.5, math.sqrt(sum((i - 19.5) ** 2 for i in range(40)) / 39)
    em, es = 104.5, math.sqrt(sum((i - 4.5) ** 2 for i in range(10)) / 9)
    score = max(abs(tm - em) / max(abs(tm), abs(ts), 1), abs(ts - es) / max(abs(em), abs(es), 1))
    assert math.isclose(r["drift_score"], score, rel_tol=1e-12) and r["drift_detected"] and not ok


def test_validate_overall_and_gate(spark):
    train, test = _sides(spark)
    rep = validate.validate(train, test, "t", drift_threshold=100.0)
    assert rep.passed
    rep2 = validate.validate(train, test, "t", drift_threshold=0.1)
    assert not rep2.passed
    with pytest.raises(validate.ValidationError):
        validate.gate(rep2)
    assert rep2.status_frame(spark).where("check_name = 'overall'").collect()[0]["status"] is False


def test_dedup_keeps_one_of_each_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    assert split.deduplicate(df).count() == 2


def test_random_split_exact_disjoint_repeatable(spark):
    df = spark.range(0, 1003).select(F.col("id"), (F.col("id") % 7).alias("g"))
    train, test = split.random_split(df, 0.2, seed=3)
    assert test.count() == math.ceil(1003 * 0.2) and train.count() == 1003 - 200 - 1
    ids_tr = {r[0] for r in train.select("id").collect()}
    ids_te = {r[0] for r in test.select("id").collect()}
    assert not ids_tr & ids_te and len(ids_tr | ids_te) == 1003
    _, test2 = split.random_split(df, 0.2, seed=3)
    assert {r[0] for r in test2.select("id").collect()} == ids_te
    _, t_int = split.random_split(df, 10)
    assert t_int.count() == 10
    with pytest.raises(split.SplitError):
        split.random_split(df, 1.5)


def test_split_with_duplicate_rows_is_exact(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 50, "a int")
    train, test = split.random_split(df, 0.3)
    assert test.count() == 30 and train.count() == 70


def test_stratified_quotas(spark):
    rows = [(i, "a") for i in range(70)] + [(i, "b") for i in range(70, 95)] + [(i, "c") for i in range(95, 100)]
    df = spark.createDataFrame(rows, "id int, y string")
    train, test = split.stratified_split(df, "y", 0.2)
    counts = {r[0]: r[1] for r in test.groupBy("y").count().collect()}
    assert counts == split.class_quotas({"a": 70, "b": 25, "c": 5}, 20) == {"a": 14, "b": 5, "c": 1}
    assert train.count() == 80


def test_stratified_falls_back_when_class_has_one_row(spark):
    df = spark.createDataFrame([(i, "a") for i in range(20)] + [(99, "b")], "id int, y string")
    _, test = split.stratified_split(df, "y", 0.2)
    assert test.count() == math.ceil(21 * 0.2)


def test_folds_exact_sizes(spark):
    df = spark.range(0, 100)
    sizes = sorted(r[1] for r in split.assign_folds(df, 3).groupBy("fold").count().collect())
    assert sizes == [33, 33, 34]
    strat = split.assign_folds(df.select("id", (F.col("id") % 2).alias("y")), 3, strata=["y"])
    per = {(r[0], r[1]): r[2] for r in strat.groupBy("y", "fold").count().collect()}
    assert sorted(per.values()) == [16, 16, 17, 17, 17, 17]


def test_shared_scan_validate_matches_standalone_checks(spark):
    train, test = _sides(spark)
    train = train.withColumn("x", F.when(F.col("k") == 0, None).otherwise(F.col("x")))
    rep = validate.validate(train, test, "t", missing_threshold=0.2, drift_threshold=0.5)
    ok3, f3 = validate.missing_rates(train, test, 0.2)
    ok5, f5 = validate.drift(train, test, "t", 0.5)
    key = lambda r: r["column_name"]
    a = sorted(rep.frames["missing_values"].collect(), key=key)
    b = sorted(f3.select("position", "column_name", "train_missing", "test_missing", "flagged").collect(), key=key)
    assert [tuple(r) for r in a] == [tuple(r) for r in b] and rep.checks["missing_values"] == ok3
    a = sorted(rep.frames["data_drift"].collect(), key=key)
    b = sorted(f5.collect(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x["column_name"] == y["column_name"] and x["drift_detected"] == y["drift_detected"]
        assert math.isclose(x["drift_score"], y["drift_score"], rel_tol=1e-12)
    assert rep.checks["data_drift"] == ok5


def test_folds_and_splits_of_repeated_rows_and_null_strata(spark):
    rows = [(1, "a")] * 800 + [(i, "b") for i in range(100)] + [(None, None)] * 30
    df = spark.createDataFrame(rows, "x int, y string")
    assert sorted(r[1] for r in split.assign_folds(df, 3).groupBy("fold").count().collect()) == [310, 310, 310]
    per = {(r[0], r[1]): r[2] for r in split.assign_folds(df, 3, strata=["y"]).groupBy("y", "fold").count().collect()}
    assert per == {(y, f): n for y, sizes in (("a", [267, 267, 266]), ("b", [34, 33, 33]), (None, [10, 10, 10]))
                   for f, n in enumerate(sizes)}
    train, test = split.random_split(df, 0.2)
    assert (train.count(), test.count()) == (744, 186)
    train, test = split.stratified_split(df.where("y is not null"), "y", 0.2)
    assert {r[0]: r[1] for r in test.groupBy("y").count().collect()} == {"a": 160, "b": 20}


def test_a_split_places_only_the_buckets_of_its_border(spark, monkeypatch):
    rows = [(i, "abc"[i % 3], float(i % 11)) for i in range(3000)] * 2 + [(-1, "c", None)] * 700
    df = spark.createDataFrame(rows, "k int, y string, v double").repartition(5)
    want = {}
    for name, strata, quota in (("random", [], lambda n: math.ceil(n * 0.2)), ("stratified", ["y"], None)):
        places = split._copies(split._placed(df, strata, 42), [*df.columns, "__place"], F.lit(0), "x").drop("x")
        n_test = {"a": 400, "b": 400, "c": 540} if strata else {None: quota(6700)}
        limit = (F.create_map(*[F.lit(x) for p in n_test.items() for x in p])[F.col("y")] if strata
                 else F.lit(n_test[None]))
        want[name] = {tuple(r) for r in places.withColumn("t", F.col("__place") < limit).groupBy(
            "k", "y", "v", "t").count().collect()}
    assert split.class_quotas({"a": 2000, "b": 2000, "c": 2700}, 1340) == {"a": 400, "b": 400, "c": 540}
    placed, kept = [], split._placed

    def noted(rows, *args):
        placed.append(rows.count())
        return kept(rows, *args)

    monkeypatch.setattr(split, "_placed", noted)
    for name, sides in (("random", split.random_split(df, 0.2)), ("stratified", split.stratified_split(df, "y", 0.2))):
        train, test = (s.withColumn("t", F.lit(t)) for s, t in zip(sides, (False, True)))
        got = train.unionByName(test).groupBy("k", "y", "v", "t").count().collect()
        assert {tuple(r) for r in got} == want[name]
    assert len(placed) == 2 and all(n < 1000 for n in placed)
