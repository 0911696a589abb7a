"""Registered queries for scoring and the prediction log.

Log rows derive from ``events``: ``event_type`` is the model version, ``props``
the feature JSON, ``value`` the prediction and 1 / (1 + |value|) the
confidence; ``ts`` is the log time.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from quarry.operators import checks, features as fx, pipeline, registry, scoring
from quarry.operators import metrics as mx
from quarry.plans.catalog_metrics import REG_MODELS, _rank_sql, _reg_frame, _reg_metrics_sql
from quarry.plans.catalog_models import regression_sides, classification_sides
from quarry.plans.registry import query
from quarry.plans.tables import LINEITEM_WITH_NULLS_SQL, lineitem_with_nulls, rounded, sql_rounded, table
from quarry.session import scratch_dir


@query("B1_batch_score_regression")
def b1_batch_score_regression(spark, sf):
    from pyspark.ml.regression import LinearRegression
    train, test = regression_sides(spark, sf)
    model = LinearRegression().fit(train)
    out = scoring.score(train.unionByName(test), model, "regression")
    return rounded(out.select("l_orderkey", "l_linenumber", "prediction", "confidence_score"))


@query("B1_batch_score_classification")
def b1_batch_score_classification(spark, sf):
    from pyspark.ml.classification import LogisticRegression
    train, test, _ = classification_sides(spark, sf)
    model = LogisticRegression(maxIter=100).fit(train)
    out = scoring.score(train.unionByName(test), model, "classification")
    return rounded(out.select("l_orderkey", "l_linenumber", "prediction", "confidence_score"))


@query("B2_required_features", f"""
SELECT l_orderkey, l_linenumber, l_discount, l_tax,
  concat_ws(',', CASE WHEN l_discount IS NULL THEN 'l_discount' END, CASE WHEN l_tax IS NULL THEN 'l_tax' END)
    AS missing_features
FROM ({LINEITEM_WITH_NULLS_SQL}) WHERE l_discount IS NULL OR l_tax IS NULL""")
def b2_required_features(spark, sf):
    li = lineitem_with_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    rep = checks.required_features(li, ["l_discount", "l_tax"])
    return rep.withColumn("missing_features", F.array_join("missing_features", ","))


@query("B3_features_by_name", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")
def b3_features_by_name(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "props")
    return scoring.features_by_name(ev, "props", ["k"]).select("event_id", "k")


def _log_frame(spark, sf):
    ev = table(spark, sf, "events")
    scored = ev.withColumn("prediction", F.col("value")).withColumn(
        "confidence_score", F.lit(1.0) / (F.lit(1.0) + F.abs(F.col("value"))))
    rows = scoring.log_rows(scored, F.col("event_type"), "formula", "regression", ["props"], id_col="event_id",
                            at=F.col("ts"))
    # the features are the props JSON itself
    return rows.withColumn("input_features", F.get_json_object(F.col("input_features"), "$.props"))


def _written_log(spark, sf):
    path = scratch_dir(spark, "prediction-log")
    scoring.append_log(_log_frame(spark, sf), path)
    return scoring.read_log(spark, path)


_LOG_SQL = """SELECT event_id AS id,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END
    || '+00:00' AS timestamp,
  event_type AS model_version,
  'formula' AS model_name, 'regression' AS task_type, props AS input_features, value AS prediction,
  1.0 / (1.0 + abs(value)) AS confidence_score, ts AS created_at, CAST(ts AS DATE) AS dt FROM events"""


@query("B4_score_and_log", sql_rounded(_LOG_SQL, ["prediction", "confidence_score"]))
def b4_score_and_log(spark, sf):
    log = _written_log(spark, sf)
    return rounded(log.select("id", "timestamp", "model_version", "model_name", "task_type", "input_features",
                              "prediction", "confidence_score", "created_at", "dt"))


@query("B5_recent_predictions", sql_rounded(f"""
SELECT id, model_version, CAST(json_extract_string(input_features, '$.k') AS VARCHAR) AS k, confidence_score
FROM ({_LOG_SQL}) ORDER BY created_at DESC, id DESC LIMIT 100""", ["confidence_score"]))
def b5_recent_predictions(spark, sf):
    log = _written_log(spark, sf)
    r = scoring.recent(log, 100)
    return rounded(r.select("id", "model_version", F.element_at("features", F.lit("k")).alias("k"),
                            "confidence_score"))


@query("A19_log_statistics", sql_rounded(f"""
SELECT count(*) AS total_predictions, count(DISTINCT model_version) AS unique_models,
  avg(confidence_score) AS avg_confidence, min(confidence_score) AS min_confidence,
  max(confidence_score) AS max_confidence FROM ({_LOG_SQL})""", ["avg_confidence", "min_confidence",
                                                                  "max_confidence"]))
def a19_log_statistics(spark, sf):
    return rounded(scoring.log_statistics(_written_log(spark, sf)))


@query("S9_log_partitions", f"""
SELECT dt, count(*) AS n FROM ({_LOG_SQL}) GROUP BY dt""")
def s9_log_partitions(spark, sf):
    log = _written_log(spark, sf)
    return log.groupBy("dt").agg(F.count(F.lit(1)).alias("n"))


def _models_table(spark, sf):
    """The formula models as versions of a written registry; the first is promoted, then the best one."""
    ranked = mx.rank_models(mx.regression_metrics(_reg_frame(spark, sf), by=["seq", "model_name"]), "r2")
    path, best = scratch_dir(spark, "models"), None
    # one row a model
    for r in ranked.orderBy("seq").collect():
        version = registry.register(spark, path, r["model_name"], "formula", metric="r2", score=r["r2"])
        best = version if r["rank"] == 1 else best
        if version == 1:
            registry.promote(spark, path, version)
    registry.promote(spark, path, best)
    return registry.models(spark, path)


@query("B6_production_model", f"""
SELECT CAST(seq + 1 AS BIGINT) AS version, model_name AS name, 'Production' AS stage
FROM ({_rank_sql(_reg_metrics_sql(), "r2", True)}) WHERE rank = 1 ORDER BY version LIMIT 1""")
def b6_production_model(spark, sf):
    return scoring.production_model(_models_table(spark, sf)).select("version", "name", "stage")


@query("B6_model_versions", sql_rounded(f"""
SELECT CAST(seq + 1 AS BIGINT) AS version, model_name AS name, r2 AS score,
  CASE WHEN rank = 1 THEN 'Production' WHEN seq = 0 THEN 'Archived' ELSE 'Staging' END AS stage
FROM ({_rank_sql(_reg_metrics_sql(), "r2", True)})""", ["score"]))
def b6_model_versions(spark, sf):
    return rounded(_models_table(spark, sf).select("version", "name", "score", "stage"))


def _b7_sql():
    preds = ", ".join(f"round({s}, 4) AS {n}_prediction" for n, _, s in REG_MODELS)
    return f"""SELECT l_orderkey, l_linenumber, l_extendedprice AS actual, {preds}
FROM lineitem WHERE l_orderkey % 5 = 0"""


@query("B7_prediction_comparison", sql_rounded(_b7_sql(), ["actual"] + [f"{n}_prediction" for n, _, _ in REG_MODELS]))
def b7_prediction_comparison(spark, sf):
    li = table(spark, sf, "lineitem").where(F.col("l_orderkey") % 5 == 0).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    preds = [(n, (lambda e: (lambda frame: e()))(e)) for n, e, _ in REG_MODELS]
    return rounded(scoring.prediction_comparison(li, ["l_orderkey", "l_linenumber"], "l_extendedprice", preds))


@query("B4_stream_score_and_log", sql_rounded(_LOG_SQL, ["prediction", "confidence_score"]))
def b4_stream_score_and_log(spark, sf):
    """B4 through Structured Streaming: the events table is the request stream."""
    from quarry.streaming.scoring_stream import run_scoring_stream
    schema = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").schema
    # a glob that matches the one file: the file source watches its folder
    src = f"{sf.rstrip('/')}/events.parque[t]"
    log_path = scratch_dir(spark, "stream-log")

    def prepare(s):
        return (s.withColumn("prediction", F.col("value"))
                .withColumn("confidence_score", F.lit(1.0) / (F.lit(1.0) + F.abs(F.col("value")))))

    q = run_scoring_stream(spark, src, schema, log_path, None, "regression", ["props"], F.col("event_type"),
                           "formula", id_col="event_id", at=F.col("ts"),
                           checkpoint=scratch_dir(spark, "stream-ckpt"), prepare=prepare)
    q.awaitTermination()
    log = scoring.read_log(spark, log_path).withColumn(
        "input_features", F.get_json_object(F.col("input_features"), "$.props"))
    return rounded(log.select("id", "timestamp", "model_version", "model_name", "task_type", "input_features",
                              "prediction", "confidence_score", "created_at", "dt"))


def _saved_line(spark, train, feature, target, scaling="standard"):
    """A saved pipeline of a least-squares line: fill, scale, assemble, fit; the folder's path."""
    from pyspark.ml.regression import LinearRegression
    pre = fx.Preprocessor.fit(train, [feature], [], scaling=scaling)
    data = pre.assemble(train, keep=[target]).withColumn("label", F.col(target).cast("double"))
    model = LinearRegression(solver="normal").fit(data)
    path = scratch_dir(spark, "pipeline")
    pipeline.scoring_pipeline(pre.stages(), model, "regression").write().save(path)
    return path


def _line_sql(name, source, train, feature, target):
    """The line in SQL: missing values filled by the mean of train, slope and intercept by least squares."""
    return f"""{name}_f AS (SELECT avg({feature}) AS fill FROM {source} WHERE {train}),
{name} AS (SELECT fill, regr_slope({target}, coalesce({feature}, fill)) AS a, regr_intercept({target}, coalesce({feature}, fill)) AS b
  FROM {source}, {name}_f WHERE {train} GROUP BY fill)"""


@query("B1_saved_pipeline", sql_rounded(f"""
WITH li AS ({LINEITEM_WITH_NULLS_SQL}), {_line_sql("m", "li", "l_orderkey % 5 <> 0", "l_tax", "l_extendedprice")}
SELECT l_orderkey, l_linenumber, b + a * coalesce(l_tax, fill) AS prediction, 1.0 AS confidence_score FROM li, m""",
                                        ["prediction", "confidence_score"], 3))
def b1_saved_pipeline(spark, sf):
    """Raw rows, with missing values, through a pipeline that was saved and is loaded by its folder alone."""
    li = lineitem_with_nulls(spark, sf)
    path = _saved_line(spark, li.where(F.col("l_orderkey") % 5 != 0), "l_tax", "l_extendedprice")
    raw = li.select("l_orderkey", "l_linenumber", "l_tax")
    return rounded(scoring.score_saved(raw, path).drop("l_tax"), 3)


_LINES = ("l_quantity", "l_discount", "l_tax")


@query("B7_saved_pipelines", f"""
WITH li AS ({LINEITEM_WITH_NULLS_SQL}), {", ".join(_line_sql(f"m{i}", "li", "l_orderkey % 5 <> 0", f, "l_extendedprice")
                                                   for i, f in enumerate(_LINES))}
SELECT l_orderkey, l_linenumber, l_extendedprice AS actual,
  {", ".join(f"round(m{i}.b + m{i}.a * coalesce({f}, m{i}.fill), 2) AS {f}_prediction" for i, f in enumerate(_LINES))}
FROM li, m0, m1, m2 WHERE l_orderkey % 5 = 0""")
def b7_saved_pipelines(spark, sf):
    """Actual beside the predictions of three saved pipelines on the raw test rows."""
    li = lineitem_with_nulls(spark, sf)
    models = [(f, _saved_line(spark, li.where(F.col("l_orderkey") % 5 != 0), f, "l_extendedprice")) for f in _LINES]
    return scoring.compare_saved(li.where(F.col("l_orderkey") % 5 == 0), ["l_orderkey", "l_linenumber"], "l_extendedprice",
                                 models, digits=2)


@query("B4_stream_saved_pipeline", sql_rounded(f"""
WITH {_line_sql("m", "events", "event_id % 5 <> 0", "user_id", "value")}
SELECT event_id AS id, CAST(json_extract_string(input_features, '$.user_id') AS BIGINT) AS user_id, prediction, 1.0 AS confidence_score,
  event_type AS model_version, CAST(ts AS DATE) AS dt
FROM (SELECT *, b + a * user_id AS prediction, to_json({{'user_id': user_id}}) AS input_features FROM events, m)""",
                                               ["prediction", "confidence_score"]))
def b4_stream_saved_pipeline(spark, sf):
    """The events as a stream of requests, scored by a saved pipeline that the stream loads, and logged; the stream is
    started twice on one checkpoint, so that what the first run has logged is not logged again."""
    from quarry.streaming.scoring_stream import run_saved_stream
    events = table(spark, sf, "events")
    path = _saved_line(spark, events.where(F.col("event_id") % 5 != 0), "user_id", "value")
    log, checkpoint = scratch_dir(spark, "stream-log"), scratch_dir(spark, "stream-ckpt")
    for _ in range(2):
        run_saved_stream(spark, f"{sf.rstrip('/')}/events.parque[t]", events.schema, log, path, "regression", F.col("event_type"),
                         "line", id_col="event_id", at=F.col("ts"), checkpoint=checkpoint).awaitTermination()
    rows = scoring.features_by_name(scoring.read_log(spark, log), "input_features", ["user_id"], {"user_id": "long"})
    return rounded(rows.select("id", "user_id", "prediction", "confidence_score", "model_version", "dt"))
