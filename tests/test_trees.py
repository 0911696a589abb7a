"""Tree ensembles evaluated by joins on their node tables, against ``transform``."""
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

from quarry.operators import trees


@pytest.mark.parametrize("kind", [RandomForestRegressor, GBTRegressor, RandomForestClassifier, GBTClassifier])
def test_node_table_equals_transform(spark, kind):
    est = kind(maxIter=3, maxDepth=3, seed=1) if "GBT" in kind.__name__ else kind(numTrees=3, maxDepth=5, seed=1)
    task = "classification" if "Classifier" in kind.__name__ else "regression"
    boosted = "GBT" in kind.__name__
    rows = [(i, float(i % 13), float(i * 7 % 11), float((i * i) % (2 if task == "classification" else 97))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model = est.fit(df)
    nodes = trees.node_table(model)
    got = {r["id"]: r["prediction"] for r in trees.predict(df, ["id"], nodes, model.getNumTrees, task,
                                                           weights=list(model.treeWeights) if boosted else None).collect()}
    want = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    assert got == pytest.approx(want, rel=1e-12)
    leaf = nodes.where("left is null")
    assert leaf.where("right is not null").count() == 0 and leaf.count() + nodes.where("left is not null").count() == nodes.count()
    assert trees.predict(df.limit(0), ["id"], nodes, model.getNumTrees, task, weights=[1.0] * 3 if boosted else None).count() == 0
