"""Work and partitions that grow with the input: no pass too many, no class or bucket in one task."""
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from quarry.operators import features as fx, models as mdl, profile, split, trees


def _rows(spark, n=400):
    return spark.createDataFrame([(i, float(i % 13), float(i * 7 % 11), "ab"[i % 2]) for i in range(n)],
                                 "id long, a double, b double, c string")


def test_forests_keep_no_node_ids(spark):
    for task in ("regression", "classification"):
        forest = next(m for n, m in mdl.build_models(task).items() if "forest" in n)
        assert not forest.getCacheNodeIds()


def test_encoding_labels_does_not_shuffle_rows_by_class(spark):
    df = _rows(spark)
    coded = fx.encode_labels(df, "c", fx.label_table(df, df.limit(0), "c"), "label")
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert {(r["c"], r["label"]) for r in coded.collect()} == {("a", 0.0), ("b", 1.0)}


def test_training_input_has_partitions_by_rows(spark, monkeypatch):
    monkeypatch.setattr(mdl, "ROWS_PER_TASK", 10)
    assert mdl.spread(_rows(spark)).rdd.getNumPartitions() == 40
    assert mdl.spread(_rows(spark, 5)).rdd.getNumPartitions() == 8


def test_profile_computes_its_frame_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(x):
        calls.add(1)
        return x

    df = _rows(spark).select(F.udf(counted, "double")("a").alias("a"), "b")
    assert profile.insights(df).count() >= 0
    assert calls.value == 400
    assert profile.insights(spark.range(3).select()).count() == 0


def test_rows_go_down_several_levels_in_a_pass(spark, monkeypatch):
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(_rows(spark)).withColumn("label", F.col("id") % 97.0)
    model = RandomForestRegressor(numTrees=2, maxDepth=6, seed=1).fit(df)
    nodes, written = trees.node_table(model), []
    kept = trees.scratch_dir
    monkeypatch.setattr(trees, "scratch_dir", lambda spark, name: written.append(name) or kept(spark, name))
    found = trees.leaves(df, ["id"], nodes, 2)
    assert found.count() == 800 and len(written) == 2
    want = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    got = {r["id"]: r["p"] for r in found.groupBy("id").agg(F.avg("prediction").alias("p")).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_many_distinct_rows_are_dealt_over_partitions_by_rows(spark, monkeypatch):
    rows = [(i % 150, None if i % 5 == 0 else float(i % 3), "x") for i in range(300)] + [(-1, 0.0, "hot")] * 200 + [(-1, -0.0, "hot")] * 10
    df = spark.createDataFrame(rows, "k long, v double, c string").repartition(7)
    few = split.assign_folds(df, 3, strata=["v"]).groupBy("k", "v", "c", "fold").count().collect()
    monkeypatch.setattr(split, "ROWS_PER_TASK", 10)
    placed = split._placed(df, ["v"], 42)
    assert split._distinct(df, F.shiftright(split.row_hash(df), 52), 42).rdd.getNumPartitions() >= 14
    assert placed.agg(F.sum("__copies")).first()[0] == 510
    many = split.assign_folds(df, 3, strata=["v"]).groupBy("k", "v", "c", "fold").count().collect()
    assert sorted(map(str, few)) == sorted(map(str, many))
