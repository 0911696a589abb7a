"""Batch scoring and the prediction log.

The reference scores one request at a time and inserts each into SQLite. Here
scoring is ``PipelineModel.transform`` over a table, and the log is an
append-only parquet table partitioned by date, written by Spark tasks
(each task writes its own files; a failed task is retried, a failed job
leaves no partial commit).
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.exprs import qcol
from quarry.operators.models import load_pipeline
from quarry.operators.pipeline import inputs_of

LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("task_type", T.StringType()),
    T.StructField("input_features", T.StringType()),
    T.StructField("prediction", T.DoubleType()),
    T.StructField("confidence_score", T.DoubleType()),
    T.StructField("created_at", T.TimestampType()),
])
RECENT_DEFAULT = 100


def score(df: DataFrame, model, task: str, prediction: str = "prediction",
          probability: str = "probability") -> DataFrame:
    """B1: prediction per row; confidence 1.0 for regression, else the largest
    class probability (1.0 when the model has no probabilities). Row by row, so it
    serves a stream as well."""
    out = model.transform(df)
    if "confidence_score" in out.columns:  # a saved pipeline gives it
        return out
    if task == "classification" and probability in out.columns:
        conf = F.array_max(vector_to_array(F.col(probability)))
    else:
        conf = F.lit(1.0)
    return out.withColumn("confidence_score", conf.cast("double"))


def features_by_name(df: DataFrame, features_json: str, names: list[str], types: dict | None = None) -> DataFrame:
    """A JSON feature map per row to model input columns, by name (not position)."""
    m = F.from_json(qcol(features_json), T.MapType(T.StringType(), T.StringType()))
    types = types or {}
    return df.select("*", *[F.element_at(m, F.lit(n)).cast(types.get(n, "double")).alias(n) for n in names])


def utc_iso(at: F.Column, zoned: bool) -> F.Column:
    """ISO-8601 text of a UTC time as Python's ``isoformat`` writes it
    (microseconds only when non-zero, ``+00:00``), whatever the session zone.
    A zone-less timestamp is read as UTC wall-clock time."""
    wall = F.to_utc_timestamp(at, F.current_timezone()) if zoned else at
    whole = F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(wall, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
                    F.lit("+00:00"))


def log_rows(scored: DataFrame, model_version: str | F.Column, model_name: str | F.Column, task: str,
             feature_cols: list[str], id_col: str | None = None, at: F.Column | None = None) -> DataFrame:
    """The 9 log columns; features as JSON of the named inputs. Without ``id_col`` an id is 63 random bits,
    so that it does not come again with the next append."""
    at = F.current_timestamp() if at is None else at
    zoned = isinstance(scored.select(at).schema[0].dataType, T.TimestampType)
    rid = qcol(id_col).cast("long") if id_col else F.shiftrightunsigned(F.xxhash64(F.uuid()), 1)
    ver = model_version if isinstance(model_version, F.Column) else F.lit(model_version)
    name = model_name if isinstance(model_name, F.Column) else F.lit(model_name)
    return scored.select(
        rid.alias("id"), utc_iso(at, zoned).alias("timestamp"),
        ver.cast("string").alias("model_version"), name.cast("string").alias("model_name"),
        F.lit(task).alias("task_type"),
        F.to_json(F.struct(*[qcol(c) for c in feature_cols])).alias("input_features"),
        F.col("prediction").cast("double").alias("prediction"),
        F.col("confidence_score").cast("double").alias("confidence_score"), at.alias("created_at"))


def utc_date() -> F.Column:
    """The log's partition: the date of its UTC ``timestamp``, whatever the session zone."""
    return F.to_date(F.substring("timestamp", 1, 10))


def append_log(rows: DataFrame, path: str) -> str:
    """Append to the log table, partitioned by the UTC date of created_at."""
    rows.withColumn("dt", utc_date()).write.mode("append").partitionBy("dt").parquet(path)
    return path


def read_log(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def recent(log: DataFrame, n: int = RECENT_DEFAULT) -> DataFrame:
    """Newest ``n`` rows (created_at, then id, descending), features decoded.

    ``orderBy(...).limit(n)`` is a top-n: each task keeps n rows."""
    return (log.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)
            .withColumn("features", F.from_json("input_features", T.MapType(T.StringType(), T.StringType()))))


def log_statistics(log: DataFrame) -> DataFrame:
    """Total, distinct model versions, average/min/max confidence."""
    c = F.col("confidence_score")
    return log.agg(F.count(F.lit(1)).alias("total_predictions"),
                   F.count_distinct("model_version").alias("unique_models"),
                   F.avg(c).alias("avg_confidence"), F.min(c).alias("min_confidence"),
                   F.max(c).alias("max_confidence"))


def production_model(models: DataFrame, stage: str = "Production") -> DataFrame:
    """The first (lowest) version whose stage equals ``stage``."""
    return models.where(F.col("stage") == F.lit(stage)).orderBy(F.col("version").asc()).limit(1)


def prediction_comparison(df: DataFrame, key: list[str], actual: str, predictors: list, digits: int = 4) -> DataFrame:
    """Actual beside one rounded prediction column per model.

    Each predictor is ``(display_name, fn)`` with ``fn(frame) -> Column`` or a
    fitted model; the columns are added to the same rows one after another, so
    no join on a row key is needed (the positional zip of the reference).
    """
    out = df.select(*[qcol(k) for k in key], qcol(actual).alias("actual"), *[qcol(c) for c in df.columns
                                                                            if c not in key and c != actual])
    names = []
    for name, fn in predictors:
        col = f"{name}_prediction"
        if callable(fn) and not hasattr(fn, "transform"):
            out = out.withColumn(col, fn(out))
        else:
            out = fn.transform(out).withColumnRenamed("prediction", col)
            out = out.drop(*[c for c in ("rawPrediction", "probability") if c in out.columns])
        out = out.withColumn(col, F.round(F.col(col).cast("double"), digits))
        names.append(col)
    return out.select(*[qcol(k) for k in key], "actual", *names)


def score_saved(df: DataFrame, path: str) -> DataFrame:
    """B1: raw rows through a saved pipeline: ``prediction, confidence_score`` and, with classes, ``predicted_label``.

    A missing input column raises. Row by row, so it serves a stream as well."""
    model = load_pipeline(path)
    lacking = [c for c in inputs_of(model) if c not in df.columns]
    if lacking:
        raise ValueError(f"the input lacks {lacking}")
    return model.transform(df)


def compare_saved(df: DataFrame, key: list[str], actual: str, models: list[tuple[str, str]], digits: int = 4) -> DataFrame:
    """Actual beside the prediction of each saved pipeline (display name, path), numbers rounded, classes decoded.

    Every pipeline adds its outputs to the same rows, which are read once; none needs a join on a row key."""
    out, names = df, []
    for i, (name, path) in enumerate(models):
        out = score_saved(out, path)
        decoded = "predicted_label" in out.columns
        value = F.col("predicted_label") if decoded else F.round("prediction", digits)
        out = out.withColumn(f"__q_{i}", value).drop("prediction", "confidence_score", "predicted_label")
        out = out.withColumnRenamed(f"__q_{i}", f"__p_{i}")  # later pipelines drop what begins with __q_
        names.append(f"{name}_prediction")
    return out.select(*[qcol(k) for k in key], qcol(actual).alias("actual"),
                      *[F.col(f"__p_{i}").alias(n) for i, n in enumerate(names)])


def preview(df: DataFrame, key: list[str], n: int = 25) -> DataFrame:
    w = Window.orderBy(*[qcol(k) for k in key])
    return df.orderBy(*[qcol(k) for k in key]).limit(n).withColumn("row_id", F.row_number().over(w))
