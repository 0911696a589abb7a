import os

from pyspark.sql import functions as F

from conftest import SF001
from quarry.operators import scoring
from quarry.streaming.scoring_stream import run_scoring_stream


def _prepare(s):
    return s.withColumn("prediction", F.col("value")).withColumn(
        "confidence_score", F.lit(1.0) / (F.lit(1.0) + F.abs(F.col("value"))))


def test_stream_log_is_exactly_once_across_restarts(spark, tmpdir_path):
    events = spark.read.parquet(f"{SF001}/events.parquet")
    src = os.path.join(tmpdir_path, "requests")
    events.where("event_id % 2 = 0").write.parquet(os.path.join(src, "batch1"))
    log, ckpt = os.path.join(tmpdir_path, "log"), os.path.join(tmpdir_path, "ckpt")

    def run():
        q = run_scoring_stream(spark, os.path.join(src, "*"), events.schema, log, None, "regression", ["props"],
                               F.col("event_type"), "formula", id_col="event_id", at=F.col("ts"),
                               checkpoint=ckpt, prepare=_prepare)
        q.awaitTermination()

    run()
    first = scoring.read_log(spark, log).count()
    assert first == events.where("event_id % 2 = 0").count()
    run()                                            # restart on the same checkpoint: nothing new
    assert scoring.read_log(spark, log).count() == first
    events.where("event_id % 2 = 1").write.parquet(os.path.join(src, "batch2"))
    run()                                            # only the new file is scored and appended
    log_df = scoring.read_log(spark, log)
    assert log_df.count() == events.count()
    assert log_df.select("id").distinct().count() == events.count()


def test_stream_scores_with_a_fitted_model(spark, tmpdir_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from quarry.streaming.scoring_stream import run_scoring_stream
    df = spark.range(60).selectExpr("id", "double(id) AS x", "3 * double(id) + 1 AS label")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression()]).fit(df)
    df.drop("label").write.parquet(f"{tmpdir_path}/in")
    q = run_scoring_stream(spark, f"{tmpdir_path}/in", df.drop("label").schema, f"{tmpdir_path}/log", model, "regression",
                           ["x"], "v1", "linear", id_col="id", checkpoint=f"{tmpdir_path}/ckpt")
    q.awaitTermination()
    rows = spark.read.parquet(f"{tmpdir_path}/log").collect()
    assert len(rows) == 60 and all(abs(r.prediction - (3 * r.id + 1)) < 1e-6 for r in rows)
