"""Tree ensembles as a table of nodes (M3, M4): a saved model evaluated by joins.

A fitted ensemble saves its nodes as Parquet. Read as a table (tree, node, feature, threshold, children, prediction), it
gives predictions by relational steps: every row stands at the root of every tree and goes one level down with each
join, until all stand at leaves. It is how a forest is scored or inspected where only SQL runs, and a check of
``transform``, which walks the same nodes in memory.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_dir

#: Levels that rows go down in one pass.
LEVELS = 4


def node_table(model) -> DataFrame:
    """(tree, node, feature, threshold, left, right, prediction, stats) of a forest or a boosted model; leaves have no children.

    The nodes are those that the model's own writer saves. Features are continuous, as one-hot and scaled ones are."""
    spark = SparkSession.active()
    path = scratch_dir(spark, "forest")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    return nodes.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.when(F.col("leftChild") >= 0, F.col("leftChild")).alias("left"),
        F.when(F.col("rightChild") >= 0, F.col("rightChild")).alias("right"), "prediction", F.col("impurityStats").alias("stats"))


def leaves(rows: DataFrame, key: list[str], nodes: DataFrame, n_trees: int, features: str = "features") -> DataFrame:
    """(key, tree, prediction, stats): the leaf of every tree that each row comes to; one join a level, ``LEVELS``
    of them before what is reached is written."""
    at = rows.select(*key, vector_to_array(features).alias("__x"), F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
    at = at.withColumn("node", F.lit(0))
    splits = nodes.select("tree", "node", "feature", "threshold", "left", "right")
    goes_left = F.get("__x", F.col("feature")) <= F.col("threshold")
    below = F.when(F.col("left").isNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right"))
    done = None
    while True:
        path = scratch_dir(rows.sparkSession, "level")
        for _ in range(LEVELS):
            at = at.join(splits, ["tree", "node"]).select(*key, "__x", "tree", below.alias("node"))
        inner = F.col("left").isNotNull()
        at.join(nodes, ["tree", "node"]).select(
            *key, F.when(inner, F.col("__x")).alias("__x"), "tree", F.when(inner, F.col("node")).alias("node"),
            F.when(~inner, F.col("prediction")).alias("prediction"), F.when(~inner, F.col("stats")).alias("stats")).write.parquet(path)
        here = rows.sparkSession.read.parquet(path)
        end = here.where("node is null").select(*key, "tree", "prediction", "stats")
        done = end if done is None else done.unionByName(end)
        at = here.where("node is not null").select(*key, "__x", "tree", "node")
        if at.isEmpty():
            return done


def predict(rows: DataFrame, key: list[str], nodes: DataFrame, n_trees: int, task: str, features: str = "features",
            weights: list[float] | None = None) -> DataFrame:
    """The key and ``prediction``: the mean of the trees, or the class of the largest sum of their class shares.

    With ``weights`` the trees are boosted: their weighted sum, or for classes 0 and 1 whether it is above 0."""
    found = leaves(rows, key, nodes, n_trees, features)
    if weights is not None:
        weight = F.element_at(F.array(*map(F.lit, weights)), F.col("tree") + 1)
        total = found.groupBy(*key).agg(F.sum(F.col("prediction") * weight).alias("prediction"))
        return total if task == "regression" else total.withColumn("prediction", (F.col("prediction") > 0).cast("double"))
    if task == "regression":
        return found.groupBy(*key).agg(F.avg("prediction").alias("prediction"))
    total = F.aggregate("stats", F.lit(0.0), lambda a, x: a + x)
    share = found.select(*key, F.posexplode(F.transform("stats", lambda x: x / total)).alias("label", "share"))
    votes = share.groupBy(*key, "label").agg(F.sum("share").alias("votes"))
    return votes.groupBy(*key).agg(F.min_by("label", F.struct((-F.col("votes")).alias("v"), "label")).cast("double").alias("prediction"))
