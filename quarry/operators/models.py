"""Models, training, search and persistence on ``pyspark.ml``.

Training frames carry a ``features`` vector and a numeric ``label``; fitting is
distributed by Spark ML (tree learners aggregate split statistics per level,
linear models use distributed gradient/normal-equation aggregates). Metrics
come from ``quarry.operators.metrics`` as aggregates over the prediction frame.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import metrics as mx
from quarry.operators.split import assign_folds

SEED = 42
# Model names of the registry and the search spaces (value lists
# per model). Parameters without a Spark counterpart (solver,
# min_samples_split) are left out; max_depth None maps to Spark's limit 30;
# C maps to regParam = 1 / (C * n).
CLASSIFIERS = ("logistic_regression", "random_forest_classifier", "gradient_boosting_classifier")
REGRESSORS = ("linear_regression", "random_forest_regressor", "gradient_boosting_regressor")
SEARCH_SPACES = {
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "max_iter": [500, 1000, 1500]},
    "random_forest_classifier": {"n_estimators": [100, 200, 300, 500], "max_depth": [None, 5, 10, 20, 30],
                                 "min_samples_leaf": [1, 2, 4]},
    "gradient_boosting_classifier": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.05, 0.1, 0.2],
                                     "max_depth": [3, 5, 7], "subsample": [0.8, 1.0]},
    "linear_regression": {},
    "random_forest_regressor": {"n_estimators": [100, 200, 300, 500], "max_depth": [None, 5, 10, 20, 30],
                                "min_samples_leaf": [1, 2, 4]},
    "gradient_boosting_regressor": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.05, 0.1, 0.2],
                                    "max_depth": [3, 5, 7], "subsample": [0.8, 1.0]},
}
SPARK_MAX_DEPTH = 30
# most rows of a partition that learners scan
ROWS_PER_TASK = 500_000
# default forest depth: the reference grows unlimited trees; Spark needs a bound
FOREST_DEPTH = 10
# node statistics budget per pass: fewer passes over the data per tree level.
# Node ids are not cached: a row's ids (4 bytes a tree) would be kept and
# checkpointed again for every pass; walking the trees gives the same ones
FOREST_TUNING = dict(maxMemoryInMB=1024, cacheNodeIds=False)


class ModelError(ValueError):
    pass


def build_models(task: str, n_classes: int = 2, seed: int = SEED, features: str = "features",
                 label: str = "label", forest_depth: int = FOREST_DEPTH) -> dict:
    """M1-M4: the registry for a task type, in the reference's order."""
    common = dict(featuresCol=features, labelCol=label)
    if task == "classification":
        gbt = GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed, **common)
        return {
            "logistic_regression": LogisticRegression(maxIter=1000, **common),
            "random_forest_classifier": RandomForestClassifier(numTrees=100, maxDepth=forest_depth, seed=seed,
                                                               **FOREST_TUNING, **common),
            "gradient_boosting_classifier": gbt if n_classes <= 2 else OneVsRest(classifier=gbt, **common),
        }
    if task == "regression":
        return {
            "linear_regression": LinearRegression(**common),
            "random_forest_regressor": RandomForestRegressor(numTrees=100, maxDepth=forest_depth, seed=seed,
                                                             **FOREST_TUNING, **common),
            "gradient_boosting_regressor": GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed, **common),
        }
    raise ModelError(f"no models for a {task!r} task")


def choose_models(models: dict, mode: str = "manual", selected: str | None = None,
                  model_list: list[str] | None = None) -> dict:
    """M5: ``manual`` takes the one named model, ``auto`` the listed ones or all; unknown names raise."""
    wanted = {"manual": [selected] if selected else [], "auto": list(model_list or models)}.get(mode.lower())
    if not wanted:
        raise ModelError(f"mode {mode!r} with model {selected!r} names nothing to train")
    unknown = sorted(set(wanted) - set(models))
    if unknown:
        raise ModelError(f"no such models for this task: {', '.join(unknown)}; there are {', '.join(sorted(models))}")
    return {name: models[name] for name in wanted}


def evaluate(pred: DataFrame, task: str, label: str = "label", prediction: str = "prediction") -> dict:
    if task == "classification":
        row = mx.classification_metrics(pred, label, prediction).collect()[0]
        return {k: float(row[k]) for k in ("accuracy", "precision", "recall", "f1")}
    row = mx.regression_metrics(pred, label, prediction).collect()[0]
    return {k: float(row[k]) for k in ("r2", "mae", "rmse")}


def spread(df: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Deal rows over the session's shuffle partitions, and at least its default
    parallelism: fitting and scoring tree ensembles is CPU-heavy per row. More
    rows make more partitions, not larger ones."""
    spark = df.sparkSession
    n_rows = df.count() if n_rows is None else n_rows
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")),
                              -(-n_rows // ROWS_PER_TASK)))


def training_input(df: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Iterative learners scan their input many times: spread it and persist it
    (memory, spilling to disk)."""
    return spread(df, n_rows).persist(StorageLevel.MEMORY_AND_DISK)


def train_and_score(train: DataFrame, test: DataFrame, models: dict, task: str, label: str = "label",
                    prepared: bool = False):
    """M6: fit each model on train, predict test, compute metrics; ``prepared`` sides are spread and persisted already.

    Returns ``[(seq, name, fitted_model, metrics)]`` in registry order.
    """
    out = []
    data = train if prepared else training_input(train)
    scored_on = test if prepared else spread(test)
    try:
        for seq, (name, est) in enumerate(models.items()):
            fitted = est.fit(data)
            out.append((seq, name, fitted, evaluate(fitted.transform(scored_on), task, label)))
    finally:
        if not prepared:
            data.unpersist()
    return out


def results_frame(spark, results, task: str) -> DataFrame:
    keys = ("accuracy", "precision", "recall", "f1") if task == "classification" else ("r2", "mae", "rmse")
    rows = [(seq, name, *[m[k] for k in keys]) for seq, name, _, m in results]
    return spark.createDataFrame(rows, "seq int, model_name string, " + ", ".join(f"{k} double" for k in keys))


# ---------------------------------------------------------------- M7-M9

def _translate(name: str, params: dict, est, n_rows: int):
    """M8: reference parameter names to Spark ML params."""
    pm = {}
    target = est.getClassifier() if isinstance(est, OneVsRest) else est
    for k, v in params.items():
        if k == "n_estimators":
            pm[target.numTrees if hasattr(target, "numTrees") else target.maxIter] = int(v)
        elif k == "max_depth":
            pm[target.maxDepth] = SPARK_MAX_DEPTH if v is None else min(int(v), SPARK_MAX_DEPTH)
        elif k == "min_samples_leaf":
            pm[target.minInstancesPerNode] = int(v)
        elif k == "learning_rate":
            pm[target.stepSize] = float(v)
        elif k == "subsample":
            pm[target.subsamplingRate] = float(v)
        elif k == "C":
            pm[target.regParam] = 1.0 / (float(v) * max(n_rows, 1))
        elif k == "max_iter":
            pm[target.maxIter] = int(v)
    # keyed by the inner learner's params: OneVsRest.copy(extra) passes them down
    return pm


def sample_candidates(space: dict, n_iter: int, seed: int = SEED) -> list[dict]:
    """n_iter distinct candidates drawn from the value lists (all of them when the grid is smaller)."""
    keys = sorted(space)
    grid_size = int(np.prod([len(space[k]) for k in keys])) if keys else 0
    if grid_size == 0:
        return []
    rng = np.random.RandomState(seed)
    if grid_size <= n_iter:
        idx = list(range(grid_size))
    else:
        idx = sorted(rng.choice(grid_size, size=n_iter, replace=False).tolist())
    out = []
    for flat in idx:
        cand, rem = {}, flat
        for k in reversed(keys):
            vals = space[k]
            cand[k] = vals[rem % len(vals)]
            rem //= len(vals)
        out.append(cand)
    return out


def evaluator(task: str, metric: str, label: str = "label"):
    m = mx.normalize_metric(metric)
    if task == "classification":
        name = {"accuracy": "accuracy", "precision": "weightedPrecision", "recall": "weightedRecall",
                "f1": "f1"}.get(m, "f1")
        return MulticlassClassificationEvaluator(labelCol=label, metricName=name)
    name = {"r2": "r2", "mae": "mae", "rmse": "rmse"}.get(m, "r2")
    return RegressionEvaluator(labelCol=label, metricName=name)


def random_search(train: DataFrame, name: str, est, task: str, metric: str, n_iter: int = 10, cv: int = 3,
                  seed: int = SEED, parallelism: int = 1, label: str = "label", prepared: bool = False):
    """M7: sampled candidates, ``cv`` hash folds (stratified by label for
    classification), ``CrossValidator`` with ``parallelism``; an empty space is
    a plain fit, on ``prepared`` rows as they lie. Returns (best_model, best_params, cv_best_score)."""
    space = SEARCH_SPACES.get(name)
    if space is None:
        raise ModelError(f"{name!r} has no search space")
    cands = sample_candidates(space, n_iter, seed)
    if not cands:
        data = train if prepared else training_input(train)
        try:
            return est.fit(data), {}, None
        finally:
            if not prepared:
                data.unpersist()
    n = train.count()
    maps = [_translate(name, c, est, n) for c in cands]
    grid = ParamGridBuilder().build() if not maps else maps
    folded = assign_folds(train, k=cv, seed=seed, strata=[label] if task == "classification" else None,
                          fold_col="__fold")
    ev = evaluator(task, metric, label)
    cvr = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=ev, foldCol="__fold", numFolds=cv,
                         parallelism=parallelism, seed=seed)
    folded = training_input(folded, n)
    try:
        model = cvr.fit(folded)
    finally:
        folded.unpersist()
    scores = list(model.avgMetrics)
    best = int(np.argmax(scores) if ev.isLargerBetter() else np.argmin(scores))
    return model.bestModel, cands[best], float(scores[best])


def models_to_tune(ranked: DataFrame, choice="top_k", top_k: int = 3) -> list[str]:
    """M9: the first ``top_k`` names of the trainer's ranking, or an explicit list."""
    if choice == "top_k":
        return [r["model_name"] for r in ranked.orderBy("rank").limit(int(top_k)).collect()]
    if isinstance(choice, list):
        if not choice:
            raise ModelError("the list of models to tune is empty")
        return list(choice)
    raise ModelError(f"cannot tell which models to tune from {choice!r}")


# ---------------------------------------------------------------- M15

def save_models(models: list, base_path: str, prefix: str = "model") -> list[str]:
    """Write each fitted model (best first) as ``{prefix}_{i}`` directories."""
    paths = []
    for i, m in enumerate(models, start=1):
        path = f"{base_path.rstrip('/')}/{prefix}_{i}"
        m.write().overwrite().save(path)
        paths.append(path)
    return paths


def load_pipeline(path: str) -> PipelineModel:
    """A saved run: the whole way from raw rows to predictions (``operators.pipeline``)."""
    return PipelineModel.load(path)
