"""Registered queries for metrics, ranking and gates.

Predictions are formulas over the driver tables, so both engines compute the
same (y, p) pairs: several "models" are several formulas.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import metrics as mx
from quarry.plans.registry import query
from quarry.plans.tables import rounded, sql_rounded, table

# (name, Spark expression, SQL expression) of the formula regressors on lineitem
# (Spark expressions are built lazily: importing the catalog needs no session)
REG_MODELS = [
    ("qty_x1500", lambda: F.col("l_quantity") * 1500.0, "l_quantity * 1500.0"),
    ("qty_x1000_plus", lambda: F.col("l_quantity") * 1000.0 + 5000.0, "l_quantity * 1000.0 + 5000.0"),
    ("mean_only", lambda: F.lit(38000.0), "38000.0"),
]
# class prediction by thresholds on l_tax
CLS_MODELS = [
    ("tax_cut", lambda: F.when(F.col("l_tax") < 0.03, "A").when(F.col("l_tax") < 0.06, "N").otherwise("R"),
     "CASE WHEN l_tax < 0.03 THEN 'A' WHEN l_tax < 0.06 THEN 'N' ELSE 'R' END"),
    ("always_r", lambda: F.lit("R"), "'R'"),
]


def _reg_frame(spark, sf, where=None):
    li = table(spark, sf, "lineitem")
    if where is not None:
        li = li.where(where)
    parts = [li.select(F.lit(i).alias("seq"), F.lit(n).alias("model_name"), F.col("l_extendedprice").alias("y"),
                       e().alias("prediction")) for i, (n, e, _) in enumerate(REG_MODELS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _reg_sql(where="true"):
    return "\nUNION ALL\n".join(
        f"SELECT {i} AS seq, '{n}' AS model_name, l_extendedprice AS y, {s} AS prediction FROM lineitem WHERE {where}"
        for i, (n, _, s) in enumerate(REG_MODELS))


def _reg_metrics_sql(where="true"):
    return f"""
SELECT seq, model_name,
  CASE WHEN var_pop(y) * count(*) > 0 THEN 1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*))
       WHEN sum((y - prediction) * (y - prediction)) = 0 THEN 1.0 ELSE 0.0 END AS r2,
  avg(abs(y - prediction)) AS mae, sqrt(avg((y - prediction) * (y - prediction))) AS rmse
FROM ({_reg_sql(where)}) GROUP BY seq, model_name"""


@query("M10_regression_metrics", sql_rounded(_reg_metrics_sql(), ["r2", "mae", "rmse"]))
def m10_regression_metrics(spark, sf):
    return rounded(mx.regression_metrics(_reg_frame(spark, sf), by=["seq", "model_name"]))


def _cls_frame(spark, sf):
    li = table(spark, sf, "lineitem")
    parts = [li.select(F.lit(i).alias("seq"), F.lit(n).alias("model_name"), F.col("l_returnflag").alias("y"),
                       e().alias("prediction")) for i, (n, e, _) in enumerate(CLS_MODELS)]
    return parts[0].unionByName(parts[1])


def _cls_metrics_sql():
    src = "\nUNION ALL\n".join(
        f"SELECT {i} AS seq, '{n}' AS model_name, l_returnflag AS y, {s} AS p FROM lineitem"
        for i, (n, _, s) in enumerate(CLS_MODELS))
    return f"""
WITH d AS ({src}),
cm AS (SELECT seq, model_name, y, p, count(*) AS n FROM d GROUP BY ALL),
t AS (SELECT seq, model_name, y AS c, sum(n) AS support, sum(CASE WHEN y = p THEN n END) AS tp FROM cm GROUP BY ALL),
pr AS (SELECT seq, model_name, p AS c, sum(n) AS predicted FROM cm GROUP BY ALL),
per AS (SELECT coalesce(t.seq, pr.seq) AS seq, coalesce(t.model_name, pr.model_name) AS model_name,
          coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted
        FROM t FULL OUTER JOIN pr ON t.seq = pr.seq AND t.c = pr.c),
k AS (SELECT seq, model_name, support, tp,
        CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS pc,
        CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS rc,
        CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0.0 END AS fc FROM per)
SELECT seq, model_name, CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy,
  sum(pc * support) / sum(support) AS precision, sum(rc * support) / sum(support) AS recall,
  sum(fc * support) / sum(support) AS f1
FROM k GROUP BY seq, model_name"""


@query("M11_classification_metrics", sql_rounded(_cls_metrics_sql(), ["accuracy", "precision", "recall", "f1"]))
def m11_classification_metrics(spark, sf):
    return rounded(mx.classification_metrics(_cls_frame(spark, sf), by=["seq", "model_name"]))


def _rank_sql(inner, metric, higher):
    order = "DESC" if higher else "ASC"
    return f"""SELECT *, CAST({metric} AS DOUBLE) AS score,
  CAST(row_number() OVER (ORDER BY {metric} {order}, seq) AS INTEGER) AS rank FROM ({inner})"""


@query("M12_ranking", sql_rounded(_rank_sql(_reg_metrics_sql(), "rmse", False), ["r2", "mae", "rmse", "score"]))
def m12_ranking(spark, sf):
    return rounded(mx.rank_models(mx.regression_metrics(_reg_frame(spark, sf), by=["seq", "model_name"]), "rmse"))


@query("M14_tuned_ranking_alias", sql_rounded(_rank_sql(_cls_metrics_sql(), "f1", True),
                                              ["accuracy", "precision", "recall", "f1", "score"]))
def m14_tuned_ranking_alias(spark, sf):
    m = mx.classification_metrics(_cls_frame(spark, sf), by=["seq", "model_name"])
    return rounded(mx.rank_models(m, "f1_weighted"))


TEST_WHERE = "l_orderkey % 5 = 0"
TRAIN_WHERE = "l_orderkey % 5 <> 0"


@query("M16_final_comparison", sql_rounded(f"""
WITH b AS (SELECT seq, model_name, r2, mae, rmse, 'baseline' AS stage FROM ({_reg_metrics_sql(TEST_WHERE)})),
t AS (SELECT seq + 10000 AS seq, model_name, r2, mae, rmse, 'tuned' AS stage
      FROM ({_reg_metrics_sql(TEST_WHERE)}) WHERE model_name <> 'mean_only')
SELECT *, r2 AS score, CAST(row_number() OVER (ORDER BY r2 DESC, seq) AS INTEGER) AS rank
FROM (SELECT * FROM b UNION ALL SELECT * FROM t)""", ["r2", "mae", "rmse", "score"]))
def m16_final_comparison(spark, sf):
    test = mx.regression_metrics(_reg_frame(spark, sf, F.col("l_orderkey") % 5 == 0), by=["seq", "model_name"])
    tuned = test.where(F.col("model_name") != "mean_only").withColumn("seq", F.col("seq") + 10000)
    return rounded(mx.final_comparison(test, tuned, "r2"))


@query("M17_overfitting", sql_rounded(f"""
WITH te AS (SELECT *, r2 AS score, CAST(row_number() OVER (ORDER BY r2 DESC, seq) AS INTEGER) AS rank
            FROM ({_reg_metrics_sql(TEST_WHERE)})),
tr AS (SELECT model_name, r2 AS train_reference_score FROM ({_reg_metrics_sql(TRAIN_WHERE)}))
SELECT te.*, tr.train_reference_score, abs(tr.train_reference_score - te.score) AS score_gap,
  coalesce(abs(tr.train_reference_score - te.score) > 0.1, false) AS overfitting_warning
FROM te LEFT JOIN tr USING (model_name)""", ["r2", "mae", "rmse", "score", "train_reference_score", "score_gap"]))
def m17_overfitting(spark, sf):
    test = mx.rank_models(mx.regression_metrics(_reg_frame(spark, sf, F.col("l_orderkey") % 5 == 0),
                                                by=["seq", "model_name"]), "r2")
    ref = mx.regression_metrics(_reg_frame(spark, sf, F.col("l_orderkey") % 5 != 0),
                                by=["seq", "model_name"]).select("model_name", F.col("r2").alias("score"))
    return rounded(mx.overfitting(test, ref))


@query("M18_performance_gate", sql_rounded(f"""
SELECT model_name, score, 0.6 AS threshold, score >= 0.6 AS passed
FROM ({_rank_sql(_reg_metrics_sql(), "r2", True)}) WHERE rank = 1""", ["score", "threshold"]))
def m18_performance_gate(spark, sf):
    ranked = mx.rank_models(mx.regression_metrics(_reg_frame(spark, sf), by=["seq", "model_name"]), "r2")
    return rounded(mx.gate_frame(ranked, "r2", 0.6))


SCORE_EXPR = "CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 2000.0)"


def _sweep_sql():
    ts = ", ".join(f"({i}, {t!r})" for i, t in enumerate(mx.SWEEP))
    src = f"SELECT l.doc_id, l.quality, {SCORE_EXPR} AS score FROM labels l JOIN documents d USING (doc_id)"

    def counts(where, prefix):
        return f"""SELECT t.i, t.threshold,
  count(*) FILTER (WHERE s.score >= t.threshold AND s.quality = 1) AS {prefix}tp,
  count(*) FILTER (WHERE s.score >= t.threshold AND s.quality <> 1) AS {prefix}fp,
  count(*) FILTER (WHERE s.score < t.threshold AND s.quality = 1) AS {prefix}fn
FROM th t, ({src}) s WHERE {where} GROUP BY t.i, t.threshold"""
    return f"""
WITH th(i, threshold) AS (VALUES {ts}),
te AS ({counts('s.doc_id % 5 = 0', '')}),
tr AS ({counts('s.doc_id % 5 <> 0', 'train_')}),
j AS (SELECT te.*, tr.train_tp, tr.train_fp, tr.train_fn FROM te JOIN tr USING (i)),
m AS (SELECT CAST(i AS INTEGER) AS i, threshold,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS test_f1,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN 2 * train_tp + train_fp + train_fn > 0 THEN 2.0 * train_tp / (2 * train_tp + train_fp + train_fn)
       ELSE 0.0 END AS train_f1 FROM j)
SELECT *, row_number() OVER (ORDER BY test_f1 DESC, i) = 1 AS is_best FROM m"""


@query("M19_threshold_sweep", sql_rounded(_sweep_sql(), ["threshold", "test_f1", "precision", "recall", "train_f1"]))
def m19_threshold_sweep(spark, sf):
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    scored = labels.join(docs, "doc_id").select(
        "doc_id", "quality", (F.col("n_chars").cast("double") / (F.col("n_chars").cast("double") + 2000.0))
        .alias("score"))
    test = scored.where(F.col("doc_id") % 5 == 0)
    train = scored.where(F.col("doc_id") % 5 != 0)
    return rounded(mx.threshold_sweep(test, train, "quality", "score"))
