"""Score-and-log as a Structured Streaming query (B1 + B4 + S9 on a stream).

The reference scores requests one at a time and logs each. On Spark the same
work is a streaming query: new request files arrive in a folder, each
micro-batch is scored with the fitted model and appended to the prediction
log through the file sink. The sink's metadata log plus the checkpoint make
the append exactly-once across restarts and lost executors; the checkpoint
lives in the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarry.operators import scoring
from quarry.operators.models import load_pipeline
from quarry.operators.pipeline import inputs_of
from quarry.session import checkpoint_dir


def scored_log_stream(stream: DataFrame, model, task: str, feature_cols: list[str], model_version,
                      model_name, id_col: str | None = None, at=None) -> DataFrame:
    """The streaming twin of ``score`` + ``log_rows``: a stateless projection,
    so every micro-batch is independent (no state store needed)."""
    scored = scoring.score(stream, model, task) if model is not None else stream
    rows = scoring.log_rows(scored, model_version, model_name, task, feature_cols, id_col=id_col, at=at)
    return rows.withColumn("dt", scoring.utc_date())


def run_scoring_stream(spark: SparkSession, source_path: str, schema: T.StructType, log_path: str, model, task: str,
                       feature_cols: list[str], model_version, model_name, id_col: str | None = None, at=None,
                       checkpoint: str | None = None, available_now: bool = True, prepare=None):
    """Start the stream: ``readStream`` (files under ``source_path``) ->
    score -> parquet log partitioned by ``dt``. With ``available_now`` the
    query processes what is there and stops (batch-style catch-up)."""
    src = spark.readStream.schema(schema).parquet(source_path)
    if prepare is not None:
        src = prepare(src)
    rows = scored_log_stream(src, model, task, feature_cols, model_version, model_name, id_col, at)
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/streams/prediction-log"
    writer = (rows.writeStream.format("parquet").outputMode("append").partitionBy("dt")
              .option("checkpointLocation", ckpt).option("path", log_path))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def run_saved_stream(spark: SparkSession, source_path: str, schema: T.StructType, log_path: str, model_path: str, task: str,
                     model_version, model_name, id_col: str | None = None, at=None, checkpoint: str | None = None,
                     available_now: bool = True):
    """The stream through a saved pipeline: raw requests are scored by what ``model_path`` holds when the stream starts.

    A restart on the same checkpoint loads the folder again and goes on with the files that are not logged yet."""
    model = load_pipeline(model_path)
    return run_scoring_stream(spark, source_path, schema, log_path, model, task, inputs_of(model), model_version, model_name,
                              id_col, at, checkpoint, available_now)
