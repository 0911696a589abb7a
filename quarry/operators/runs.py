"""Run tracking and the lookup joins.

Runs are rows of a ``runs`` table (parquet, append-only), models of a child
``run_models`` table; every operation is a DataFrame query on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.exprs import qcol
from quarry.operators.metrics import normalize_metric

RUNS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("task_type", T.StringType()),
    T.StructField("target_column", T.StringType()),
    T.StructField("selected_features", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("best_model", T.StringType()),
    T.StructField("best_score", T.DoubleType()),
    T.StructField("metric_label", T.StringType()),
    T.StructField("test_size", T.DoubleType()),
    T.StructField("scaling_method", T.StringType()),
    T.StructField("training_mode", T.StringType()),
    T.StructField("cv", T.IntegerType()),
    T.StructField("n_iter", T.IntegerType()),
    T.StructField("error", T.StringType()),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("feature_mode", T.StringType()),
    T.StructField("n_features", T.IntegerType()),
    T.StructField("top_k", T.IntegerType()),
    T.StructField("random_state", T.IntegerType()),
])
# The parameter rows of a run comparison and their defaults.
COMPARE_PARAMS = ("test_size", "feature_mode", "n_features", "top_k", "n_iter", "cv", "random_state")
# What tells runs apart stands before their parameters.
DESCRIBED_BY = ("task_type", "target_column", "rows")
DEFAULTS = {"status": "unknown", "task_type": "unknown", "target_column": "", "selected_features": "",
            "best_model": "", "metric_label": "Score", "dataset_name": "", "feature_mode": "auto", "scaling_method": "standard", "training_mode": "auto"}


def metric_label(task: str) -> str:
    return "R2" if task == "regression" else "F1"


def summary_row(spark, run_id: str, **fields) -> DataFrame:
    """One run row (missing fields NULL), created now."""
    values = {f.name: fields.get(f.name) for f in RUNS_SCHEMA.fields}
    row = spark.createDataFrame([tuple(values[f.name] for f in RUNS_SCHEMA.fields)], RUNS_SCHEMA)
    row = row.withColumn("run_id", F.lit(run_id))
    if values["created_at"] is None:
        row = row.withColumn("created_at", F.current_timestamp())
    return row


def append_run(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def list_runs(spark, path: str) -> DataFrame:
    """Every readable run, newest first, missing fields defaulted.

    Corrupt files are skipped (``ignoreCorruptFiles``); the schema is fixed
    so older rows without a field read as NULL and get their default."""
    df = spark.read.schema(RUNS_SCHEMA).option("ignoreCorruptFiles", "true").parquet(path)
    return df.select(*[F.coalesce(qcol(f.name), F.lit(DEFAULTS[f.name])).alias(f.name) if f.name in DEFAULTS
                       else qcol(f.name) for f in RUNS_SCHEMA.fields]).orderBy(F.col("created_at").desc_nulls_last(),
                                                                                F.col("run_id").desc())


def load_run(runs: DataFrame, run_id: str) -> DataFrame:
    """One run by id; a missing id raises."""
    one = runs.where(F.col("run_id") == F.lit(run_id))
    if not one.take(1):
        raise KeyError(f"Run '{run_id}' not found")
    return one


def compare_runs(runs: DataFrame, run_ids: list[str]) -> DataFrame:
    """T4: parameter rows (one value column per run), the best score row, and
    the metric label of the first run."""
    if not run_ids:
        raise ValueError("run_ids must not be empty")
    chosen = runs.where(F.col("run_id").isin(run_ids))
    params = [*DESCRIBED_BY, *COMPARE_PARAMS, "best_score"]
    long = chosen.select("run_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(p).alias("parameter"), qcol(p).cast("string").alias("value"))
        for i, p in enumerate(params)])).alias("s")).select("run_id", "s.*")
    wide = long.groupBy("position", "parameter").pivot("run_id", run_ids).agg(F.first("value"))
    first = chosen.where(F.col("run_id") == F.lit(run_ids[0])).select("metric_label").take(1)
    label = first[0][0] if first else None
    return wide.withColumn("metric_label", F.lit(label).cast("string"))


def flatten_metrics(run_models: DataFrame) -> DataFrame:
    """T5: ``{model}_score`` per model and ``best_score`` per run as (run_id, key, value).

    A model that stands in several rows of a run (baseline and tuned) counts with its best rank."""
    per_model = run_models.select("run_id", F.concat("display_name", F.lit("_score")).alias("key"), "rank", "score")
    best = run_models.select("run_id", F.lit("best_score").alias("key"), "rank", "score")
    return per_model.unionByName(best).groupBy("run_id", "key").agg(F.min_by("score", "rank").alias("value"))


def alias_lookup(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Model path to model name, falling back to the entry's own name."""
    a = aliases.select("model_path", F.col("model_name").alias("__alias"))
    return entries.join(a, "model_path", "left").withColumn(
        "display_name", F.coalesce(F.col("__alias"), F.col("model_name"))).drop("__alias")


def baseline_beside_tuned(tuned: DataFrame, baseline: DataFrame, metric: str) -> DataFrame:
    """Baseline test score by model name and the *normalised* metric name
    (aliases applied first, so ``f1_weighted`` finds ``f1``)."""
    m = normalize_metric(metric)
    b = baseline.where(F.col("metric") == F.lit(m)).select("model_name", F.col("value").alias("baseline_test_score"))
    return tuned.join(b, "model_name", "left")
