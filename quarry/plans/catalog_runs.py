"""Registered queries for run tracking, lookups, choices and proofs of fits.

Runs derive from ``orders``: a run for each o_custkey % 50, its models by priority and status. The log is written in
two versions of its schema, the older one without later columns, beside a file that is no Parquet.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import checks, features as fx, models as mdl, runs, trees, validate
from quarry.plans.catalog_models import CLS_FEATURES, REG_FEATURES, classification_sides, regression_sides
from quarry.plans.registry import query
from quarry.plans.tables import rounded, sql_rounded, table
from quarry.session import scratch_dir

RUNS, NEWER = 50, 3


def _per_run(spark, sf):
    orders = table(spark, sf, "orders").withColumn("run", F.col("o_custkey") % RUNS)
    return orders.groupBy("run").agg(
        F.concat(F.lit("run_"), F.first("run")).alias("run_id"), F.max("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(F.min("run") % 7 == 0, "failed").otherwise("completed").alias("status"), F.count(F.lit(1)).alias("rows"),
        F.round(F.avg("o_totalprice") / 1e6, 4).alias("best_score"))


def _run_log(spark, sf):
    """The written log: older rows as a table, newer ones as runs append them (T1), and a file that cannot be read."""
    path = scratch_dir(spark, "run-log")
    found = _per_run(spark, sf)
    older = found.where(F.col("run") >= NEWER).select("run_id", "created_at", "status", "rows", "best_score")
    older.write.parquet(path)
    for r in found.where(F.col("run") < NEWER).orderBy("run").collect():
        runs.append_run(runs.summary_row(
            spark, r["run_id"], created_at=r["created_at"], status=r["status"], rows=r["rows"], best_score=r["best_score"],
            task_type="regression", target_column="o_totalprice", metric_label=runs.metric_label("regression"), test_size=0.2,
            cv=3, n_iter=5, top_k=3, random_state=42, n_features=int(r["run"]) + 2, feature_mode="manual"), path)
    spark.createDataFrame([("no run",)], "value string").coalesce(1).write.mode("append").text(path)
    return path


_PER_RUN = f"""SELECT o_custkey % {RUNS} AS run, 'run_' || CAST(o_custkey % {RUNS} AS VARCHAR) AS run_id, max(o_orderdate) AS made,
  CASE WHEN (o_custkey % {RUNS}) % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, count(*) AS rows,
  round(avg(o_totalprice) / 1e6, 4) AS best_score FROM orders GROUP BY ALL"""
_LISTED = f"""SELECT run_id, strftime(made, '%Y-%m-%d %H:%M:%S') AS created_at, status, rows, best_score,
  CASE WHEN run < {NEWER} THEN 'regression' ELSE 'unknown' END AS task_type,
  CASE WHEN run < {NEWER} THEN 'o_totalprice' ELSE '' END AS target_column,
  CASE WHEN run < {NEWER} THEN 'R2' ELSE 'Score' END AS metric_label,
  CASE WHEN run < {NEWER} THEN 'manual' ELSE 'auto' END AS feature_mode, '' AS dataset_name, 'standard' AS scaling_method,
  CASE WHEN run < {NEWER} THEN 3 END AS cv, CASE WHEN run < {NEWER} THEN CAST(run + 2 AS INTEGER) END AS n_features
FROM ({_PER_RUN})"""
_COLUMNS = ["run_id", "status", "rows", "best_score", "task_type", "target_column", "metric_label", "feature_mode", "dataset_name",
            "scaling_method", "cv", "n_features"]


def _shown(df):
    return df.select(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), *_COLUMNS)


@query("T1_run_rows", f"SELECT * FROM ({_LISTED}) WHERE task_type = 'regression'")
def t1_run_rows(spark, sf):
    return _shown(runs.list_runs(spark, _run_log(spark, sf)).where("task_type = 'regression'"))


@query("T2_list_runs", _LISTED)
def t2_list_runs(spark, sf):
    return _shown(runs.list_runs(spark, _run_log(spark, sf)))


@query("T3_load_run", f"SELECT * FROM ({_LISTED}) WHERE run_id = 'run_7'")
def t3_load_run(spark, sf):
    return _shown(runs.load_run(runs.list_runs(spark, _run_log(spark, sf)), "run_7"))


_COMPARED = ("run_0", "run_2", "run_7")
_T4_VALUES = {"task_type": "task_type", "target_column": "target_column", "rows": "CAST(rows AS VARCHAR)",
              "test_size": "CASE WHEN task_type = 'regression' THEN '0.2' END", "feature_mode": "feature_mode",
              "n_features": "CAST(n_features AS VARCHAR)", "top_k": "CASE WHEN task_type = 'regression' THEN '3' END",
              "n_iter": "CASE WHEN task_type = 'regression' THEN '5' END", "cv": "CAST(cv AS VARCHAR)",
              "random_state": "CASE WHEN task_type = 'regression' THEN '42' END", "best_score": "CAST(best_score AS VARCHAR)"}


@query("T4_compare_runs", "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{p}' AS parameter, "
    + ", ".join(f"max(CASE WHEN run_id = '{r}' THEN {v} END) AS {r}" for r in _COMPARED)
    + f", 'R2' AS metric_label FROM ({_LISTED})" for i, (p, v) in enumerate(_T4_VALUES.items())))
def t4_compare_runs(spark, sf):
    return runs.compare_runs(runs.list_runs(spark, _run_log(spark, sf)), list(_COMPARED))


def _run_models(spark, sf):
    orders = table(spark, sf, "orders")
    each = orders.groupBy(F.concat(F.lit("run_"), F.col("o_custkey") % RUNS).alias("run_id"), F.col("o_orderpriority").alias("display_name"),
                          F.col("o_orderstatus").alias("stage")).agg(F.round(F.avg("o_totalprice") / 1e6, 4).alias("score"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("score"), "display_name", "stage"))
    return each.withColumn("rank", place)


_RUN_MODELS = f"""SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, display_name, stage) AS rank FROM (
  SELECT 'run_' || CAST(o_custkey % {RUNS} AS VARCHAR) AS run_id, o_orderpriority AS display_name, o_orderstatus AS stage,
    round(avg(o_totalprice) / 1e6, 4) AS score FROM orders GROUP BY ALL)"""


@query("T5_flatten_metrics", f"""
WITH m AS ({_RUN_MODELS})
SELECT run_id, display_name || '_score' AS key, arg_min(score, rank) AS value FROM m GROUP BY run_id, display_name
UNION ALL SELECT run_id, 'best_score', arg_min(score, rank) FROM m GROUP BY run_id""")
def t5_flatten_metrics(spark, sf):
    return runs.flatten_metrics(_run_models(spark, sf))


@query("J1_alias_lookup", f"""
SELECT run_id || '/' || CAST(rank AS VARCHAR) AS model_path, display_name AS model_name,
  CASE WHEN stage = 'O' THEN 'tuned_' || display_name ELSE display_name END AS display_name FROM ({_RUN_MODELS})""")
def j1_alias_lookup(spark, sf):
    path = F.concat_ws("/", "run_id", F.col("rank").cast("string"))
    entries = _run_models(spark, sf).select(path.alias("model_path"), F.col("display_name").alias("model_name"), "stage")
    aliases = entries.where("stage = 'O'").select("model_path", F.concat(F.lit("tuned_"), "model_name").alias("model_name"))
    return runs.alias_lookup(entries.drop("stage"), aliases)


@query("J2_baseline_beside_tuned", f"""
WITH m AS (SELECT * REPLACE (run_id || ' ' || display_name AS display_name) FROM ({_RUN_MODELS})),
b AS (SELECT display_name, score FROM m WHERE stage = 'F')
SELECT m.display_name AS model_name, m.score AS tuned_score, b.score AS baseline_test_score
FROM m LEFT JOIN b USING (display_name) WHERE m.stage = 'O'""")
def j2_baseline_beside_tuned(spark, sf):
    m = _run_models(spark, sf).withColumn("model_name", F.concat_ws(" ", "run_id", "display_name"))
    tuned = m.where("stage = 'O'").select("model_name", F.col("score").alias("tuned_score"))
    scores = m.where("stage = 'F'").select("model_name", F.explode(F.create_map(
        F.lit("f1"), F.col("score"), F.lit("accuracy"), F.lit(1.0))).alias("metric", "value"))
    return runs.baseline_beside_tuned(tuned, scores, "f1_weighted")


@query("V7_gate", """
WITH s AS (SELECT o_orderkey % 5 = 0 AS test, o_totalprice AS price FROM orders),
m AS (SELECT f.factor, avg(CASE WHEN test THEN price * f.factor END) AS em, avg(CASE WHEN NOT test THEN price END) AS tm,
        stddev_samp(CASE WHEN test THEN price * f.factor END) AS es, stddev_samp(CASE WHEN NOT test THEN price END) AS ts
      FROM s, (VALUES (1.0), (3.0)) AS f(factor) GROUP BY f.factor)
SELECT CAST(factor AS DOUBLE) AS factor, greatest(abs(tm - em) / greatest(abs(tm), abs(ts), 1.0),
  abs(ts - es) / greatest(abs(em), abs(es), 1.0)) <= 0.5 AS passed FROM m""")
def v7_gate(spark, sf):
    """The gate on the test side as it is, and with its prices multiplied."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    train = orders.where(F.col("o_orderkey") % 5 != 0).drop("o_orderkey")
    out = []
    for factor in (1.0, 3.0):
        test = orders.where(F.col("o_orderkey") % 5 == 0).drop("o_orderkey").withColumn("o_totalprice", F.col("o_totalprice") * factor)
        try:
            validate.gate(validate.validate(train, test, "o_orderpriority", drift_threshold=0.5))
            out.append((factor, True))
        except validate.ValidationError:
            out.append((factor, False))
    return spark.createDataFrame(out, "factor double, passed boolean")


_TARGETS = ("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_extendedprice")


@query("M5_model_choice", "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS target, unnest(CASE WHEN count(DISTINCT {t}) <= 20
  THEN ['logistic_regression', 'random_forest_classifier', 'gradient_boosting_classifier']
  ELSE ['linear_regression', 'random_forest_regressor', 'gradient_boosting_regressor'] END) AS model_name FROM lineitem"""
    for t in _TARGETS))
def m5_model_choice(spark, sf):
    """All models of the task that each column's values ask for."""
    li = table(spark, sf, "lineitem")
    chosen = [(t, name) for t in _TARGETS
              for name in mdl.choose_models(mdl.build_models(checks.infer_task_type(li, t)), "auto")]
    return spark.createDataFrame(chosen, "target string, model_name string")


@query("M8_search_space", """
SELECT c AS "C", i AS max_iter, 1.0 / (c * n) AS reg_param, CAST(i AS INTEGER) AS spark_max_iter
FROM (SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'),
  (VALUES (0.01e0), (0.1e0), (1e0), (10e0), (100e0)) AS x(c), (VALUES (500), (1000), (1500)) AS y(i)""")
def m8_search_space(spark, sf):
    """Every candidate of a space as Spark's parameters; regularisation depends on the rows of the training table."""
    n = table(spark, sf, "lineitem").where("l_returnflag = 'R'").count()
    est = mdl.build_models("classification")["logistic_regression"]
    out = []
    for cand in mdl.sample_candidates(mdl.SEARCH_SPACES["logistic_regression"], 100):
        params = {p.name: v for p, v in mdl._translate("logistic_regression", cand, est, n).items()}
        out.append((cand["C"], cand["max_iter"], params["regParam"], params["maxIter"]))
    return spark.createDataFrame(out, "C double, max_iter int, reg_param double, spark_max_iter int")


def _normal_equations_sql():
    """Least squares of three features by Cramer's rule on the centred sums, and its metrics on the test side."""
    f = REG_FEATURES
    covs = ", ".join(f"covar_pop({a}, {b}) AS s{i}{j}" for i, a in enumerate(f) for j, b in enumerate(f) if i <= j)
    s = [[f"s{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]

    def det(m):
        return (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
                f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")
    solved = ", ".join(f"{det([[f'y{i}' if j == k else s[i][j] for j in range(3)] for i in range(3)])} / {det(s)} AS b{k}" for k in range(3))
    return f"""
WITH t AS (SELECT {covs}, {", ".join(f"covar_pop({c}, l_extendedprice) AS y{i}, avg({c}) AS m{i}" for i, c in enumerate(f))},
  avg(l_extendedprice) AS my FROM lineitem WHERE l_orderkey % 5 <> 0),
b AS (SELECT *, {solved} FROM t),
e AS (SELECT l_extendedprice AS y, my + {" + ".join(f"b{i} * ({c} - m{i})" for i, c in enumerate(f))} AS p
      FROM lineitem, b WHERE l_orderkey % 5 = 0)
SELECT CAST(0 AS INTEGER) AS seq, 'linear_regression' AS model_name,
  1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) AS r2, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse FROM e"""


@query("M1_normal_equations", sql_rounded(_normal_equations_sql(), ["r2", "mae", "rmse"], 4))
def m1_normal_equations(spark, sf):
    train, test = regression_sides(spark, sf)
    models = mdl.choose_models(mdl.build_models("regression"), "manual", "linear_regression")
    return rounded(mdl.results_frame(spark, mdl.train_and_score(train, test, models, "regression"), "regression"), 4)


def _score_equations_sql():
    """Class shares and class means of the scaled features on the training side."""
    stats = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(CLS_FEATURES))
    names = ["intercept", *CLS_FEATURES]
    values = ["avg(y)", *(f"avg(y * ({c} - m{i}) / s{i})" for i, c in enumerate(CLS_FEATURES))]
    return f"""
WITH t AS (SELECT * FROM lineitem WHERE l_orderkey % 5 <> 0), s AS (SELECT {stats} FROM t),
k AS (SELECT l_returnflag AS class, row_number() OVER (ORDER BY l_returnflag) - 1 AS label FROM
      (SELECT DISTINCT l_returnflag FROM lineitem WHERE l_returnflag IS NOT NULL)),
y AS (SELECT label, CASE WHEN l_returnflag = class THEN 1.0 ELSE 0.0 END AS y, t.*, s.* FROM t, s, k)
""" + "\nUNION ALL\n".join(f"SELECT CAST(label AS INTEGER) AS label, '{n}' AS term, {v} AS value FROM y GROUP BY label"
                            for n, v in zip(names, values))


@query("M2_score_equations", sql_rounded(_score_equations_sql(), ["value"], 4))
def m2_score_equations(spark, sf):
    """A logistic fit is the best one exactly if, for each class and feature, the predicted probabilities weigh the
    feature as the classes themselves do; the SQL has the classes' side."""
    from pyspark.ml.functions import vector_to_array
    train, _, k = classification_sides(spark, sf)
    est = mdl.build_models("classification", k)["logistic_regression"].setTol(1e-10)
    scored = est.fit(train).transform(train).select(vector_to_array("features").alias("x"), vector_to_array("probability").alias("p"))
    names = ["intercept", *CLS_FEATURES]
    terms = F.array(*[F.struct(F.lit(n).alias("term"), (F.get("x", F.lit(i - 1)) if i else F.lit(1.0)).alias("x"))
                      for i, n in enumerate(names)])
    long = scored.select("p", F.explode(terms).alias("t")).select("t.*", F.posexplode("p").alias("label", "p"))
    return rounded(long.groupBy("label", "term").agg((F.avg(F.col("p") * F.col("x")) + 0.0).alias("value")), 4)


def _equal_rows(spark, sf, learners):
    """Rows on which a model evaluated by joins on its node table and ``transform`` agree, for each learner."""
    out = None
    for task, target, est in learners:
        li = table(spark, sf, "lineitem").withColumn("row", F.monotonically_increasing_id())
        data = fx.Preprocessor.fit(li, REG_FEATURES, [], scaling="standard").assemble(li, keep=["row", target])
        if task == "classification":
            data = fx.encode_labels(data, target, fx.label_table(li, li.limit(0), target), "label")
        else:
            data = data.withColumn("label", F.col(target))
        path = scratch_dir(spark, "forest-rows")
        data.select("row", "features", "label").write.parquet(path)
        data = spark.read.parquet(path)
        fitted_on = mdl.training_input(data)
        model = est.fit(fitted_on)
        fitted_on.unpersist()
        weights = list(model.treeWeights) if "GBT" in type(est).__name__ else None
        by_table = trees.predict(data, ["row"], trees.node_table(model), model.getNumTrees, task, weights=weights)
        both = model.transform(data).select("row", F.col("prediction").alias("want")).join(by_table, "row", "left")
        equal = F.count_if(F.abs(F.col("want") - F.col("prediction")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("want")))
        part = both.agg(F.lit(task).alias("task"), F.count(F.lit(1)).alias("n"), equal.alias("equal"))
        out = part if out is None else out.unionByName(part)
    return out


_ALL_EQUAL = ("SELECT 'regression' AS task, count(*) AS n, count(*) AS equal FROM lineitem "
              "UNION ALL SELECT 'classification', count(*), count(*) FROM lineitem")


@query("M3_trees_as_table", _ALL_EQUAL)
def m3_trees_as_table(spark, sf):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor
    shape = dict(numTrees=3, maxDepth=4, seed=7)
    return _equal_rows(spark, sf, [("regression", "l_extendedprice", RandomForestRegressor(**shape)),
                                   ("classification", "l_returnflag", RandomForestClassifier(**shape))])


@query("M4_trees_as_table", _ALL_EQUAL)
def m4_trees_as_table(spark, sf):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor
    shape = dict(maxIter=4, maxDepth=3, seed=7)
    return _equal_rows(spark, sf, [("regression", "l_extendedprice", GBTRegressor(**shape)),
                                   ("classification", "l_linestatus", GBTClassifier(**shape))])
