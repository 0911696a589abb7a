"""Metrics, ranking and gates as aggregates over (y, prediction) frames.

Metrics for many models are one ``groupBy(model)``; classification metrics go
through the confusion table ``groupBy(model, y, p)``, which has at most
models * classes^2 rows, so the per-class arithmetic runs on a tiny frame.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.exprs import qcol

# Metric direction, metric aliases and the sweep grid.
HIGHER_IS_BETTER = ("accuracy", "precision", "recall", "f1", "r2")
METRIC_ALIASES = {
    "f1_weighted": "f1",
    "precision_weighted": "precision",
    "recall_weighted": "recall",
    "neg_mean_absolute_error": "mae",
    "neg_root_mean_squared_error": "rmse",
    "neg_mean_squared_error": "rmse",
}
OVERFITTING_THRESHOLD = 0.1
SWEEP = [float(t) for t in np.linspace(0.2, 0.8, 25)]


class GateError(ValueError):
    pass


def normalize_metric(name: str) -> str:
    n = name.lower()
    return METRIC_ALIASES.get(n, n)


def higher_is_better(name: str) -> bool:
    return normalize_metric(name) in HIGHER_IS_BETTER


# ---------------------------------------------------------------- M10

def regression_metrics(df: DataFrame, y: str = "y", p: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """r2, mae, rmse per group. r2 = 1 - SSres / SStot with SStot = n * var_pop(y);
    a constant target gives 1.0 for a perfect fit and 0.0 otherwise."""
    by = list(by or [])
    yy, pp = qcol(y).cast("double"), qcol(p).cast("double")
    err = yy - pp
    agg = df.groupBy(*[qcol(b) for b in by]).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(err * err).alias("__ssr"), F.var_pop(yy).alias("__v"),
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"))
    sst = F.col("__v") * F.col("__n")
    r2 = F.when(sst > 0, F.lit(1.0) - F.col("__ssr") / sst).when(F.col("__ssr") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return agg.select(*by, r2.alias("r2"), "mae", "rmse")


# ---------------------------------------------------------------- M11

def confusion(df: DataFrame, y: str = "y", p: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """Counts of (label, prediction); numbers of any type are compared as doubles, so 1 and 1.0 are one class."""
    by = list(by or [])

    def value(name):
        number = isinstance(df.select(qcol(name)).schema[0].dataType, T.NumericType)
        return (qcol(name).cast("double") if number else qcol(name)).cast("string")

    return df.groupBy(*[qcol(b) for b in by], value(y).alias("y"), value(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, y: str = "y", p: str = "prediction",
                           by: list[str] | None = None) -> DataFrame:
    """accuracy and support-weighted precision, recall and F1; zero division gives 0."""
    by = list(by or [])
    cm = confusion(df, y, p, by)
    t = cm.groupBy(*by, F.col("y").alias("c")).agg(F.sum("n").alias("support"),
                                                    F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))).alias("tp"))
    pr = cm.groupBy(*by, F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    per = t.join(pr, by + ["c"], "full_outer").select(
        *by, "c", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(F.col("support") + F.col("predicted") > 0,
                2.0 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(F.lit(0.0))
    per = per.select(*by, "support", "tp", prec.alias("pc"), rec.alias("rc"), f1.alias("fc"))
    n = F.sum("support")
    return per.groupBy(*by).agg(
        (F.sum("tp") / n).alias("accuracy"), (F.sum(F.col("pc") * F.col("support")) / n).alias("precision"),
        (F.sum(F.col("rc") * F.col("support")) / n).alias("recall"),
        (F.sum(F.col("fc") * F.col("support")) / n).alias("f1"))


# ---------------------------------------------------------------- M12, M14, M16

def rank_models(results: DataFrame, metric: str, order_cols: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Rank by the chosen metric (aliases applied first); higher is
    better for accuracy, precision, recall, f1, r2; ties keep the input order
    (``order_cols``). The frame holds one row per model, so a single ordered
    window is fine."""
    m = normalize_metric(metric)
    if m not in results.columns:
        raise GateError(f"the results have no metric {m!r} to rank by")
    score = F.col(m).cast("double")
    key = score.desc() if higher_is_better(m) else score.asc()
    w = Window.orderBy(key, *order_cols)
    return results.withColumn("score", score).withColumn("rank", F.row_number().over(w))


def final_comparison(baseline: DataFrame, tuned: DataFrame, metric: str) -> DataFrame:
    """Baseline and tuned rows scored on the same test set, ranked together."""
    both = baseline.withColumn("stage", F.lit("baseline")).unionByName(
        tuned.withColumn("stage", F.lit("tuned")))
    return rank_models(both, metric, order_cols=("stage", "seq"))


# ---------------------------------------------------------------- M17, M18

def overfitting(ranked: DataFrame, reference: DataFrame, key: str = "model_name",
                threshold: float = OVERFITTING_THRESHOLD) -> DataFrame:
    """|reference score - test score| > threshold; no reference means no flag."""
    ref = reference.select(qcol(key), F.col("score").alias("train_reference_score"))
    j = ranked.join(ref, key, "left")
    gap = F.abs(F.col("train_reference_score") - F.col("score"))
    return j.withColumn("score_gap", gap).withColumn(
        "overfitting_warning", F.coalesce(gap > F.lit(threshold), F.lit(False)))


def performance_gate(ranked: DataFrame, metric: str, threshold: float | None) -> bool:
    """Best score >= threshold when higher is better, else <=; raises on failure."""
    if threshold is None:
        return True
    best = ranked.where(F.col("rank") == 1).select("score").collect()
    if not best:
        raise GateError("no ranked models")
    s = best[0][0]
    ok = s >= threshold if higher_is_better(metric) else s <= threshold
    if not ok:
        raise GateError(f"the best {metric} is {s}, the gate asks for {threshold}")
    return True


def gate_frame(ranked: DataFrame, metric: str, threshold: float) -> DataFrame:
    """M18 as a row: best score, threshold and pass flag."""
    s = F.col("score")
    ok = (s >= F.lit(threshold)) if higher_is_better(metric) else (s <= F.lit(threshold))
    return ranked.where(F.col("rank") == 1).select(
        "model_name", "score", F.lit(float(threshold)).alias("threshold"), ok.alias("passed"))


# ---------------------------------------------------------------- M19

def _bucket(score, thresholds):
    """Number of thresholds <= score (a CASE chain, codegen friendly)."""
    expr = F.lit(len(thresholds))
    for i in range(len(thresholds) - 1, -1, -1):
        expr = F.when(score < F.lit(thresholds[i]), F.lit(i)).otherwise(expr)
    return expr


def threshold_counts(df: DataFrame, label: str, score: str, thresholds=SWEEP) -> DataFrame:
    """Per threshold t_i: tp, fp, fn, tn with prediction = score >= t_i.

    Rows are bucketed by how many thresholds their score passes and counted
    by (bucket, label); cumulative sums over the 26 buckets give every
    threshold's counts, so no row is repeated per threshold.
    """
    b = _bucket(qcol(score).cast("double"), thresholds)
    counts = df.where(qcol(score).isNotNull() & qcol(label).isNotNull()).groupBy(b.alias("bucket")).agg(
        F.count_if(qcol(label).cast("int") == 1).alias("pos"), F.count_if(qcol(label).cast("int") != 1).alias("neg"))
    rows = {r["bucket"]: (r["pos"], r["neg"]) for r in counts.collect()}
    tot_p = sum(v[0] for v in rows.values())
    tot_n = sum(v[1] for v in rows.values())
    out = []
    for i, t in enumerate(thresholds):
        tp = sum(v[0] for k, v in rows.items() if k >= i + 1)
        fp = sum(v[1] for k, v in rows.items() if k >= i + 1)
        out.append((i, float(t), tp, fp, tot_p - tp, tot_n - fp))
    return df.sparkSession.createDataFrame(out, "i int, threshold double, tp long, fp long, fn long, tn long")


def _prf(prefix):
    tp, fp, fn = F.col(f"{prefix}tp"), F.col(f"{prefix}fp"), F.col(f"{prefix}fn")
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f = F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    return p, r, f


def threshold_sweep(test: DataFrame, train: DataFrame, label: str, score: str, thresholds=SWEEP) -> DataFrame:
    """F1 on test for 25 thresholds in [0.2, 0.8]; the first best (strict >)
    wins; train F1 and test precision/recall at every threshold."""
    te = threshold_counts(test, label, score, thresholds)
    tr = threshold_counts(train, label, score, thresholds).select(
        "i", *[F.col(c).alias(f"train_{c}") for c in ("tp", "fp", "fn")])
    j = te.join(tr, "i")
    p, r, f = _prf("")
    _, _, f_tr = _prf("train_")
    j = j.select("i", "threshold", f.alias("test_f1"), p.alias("precision"), r.alias("recall"),
                 f_tr.alias("train_f1"))
    w = Window.orderBy(F.col("test_f1").desc(), F.col("i"))  # 25 rows
    return j.withColumn("is_best", F.row_number().over(w) == 1)
