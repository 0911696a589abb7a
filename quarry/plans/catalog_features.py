"""Registered queries for feature preparation (F).

Fit side: ``l_orderkey % 5 <> 0`` (or the table's own key for part/orders);
the fitted transform is applied to the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import features as fx
from quarry.operators import pipeline
from quarry.plans.registry import query
from quarry.session import scratch_dir
from quarry.plans.tables import LINEITEM_WITH_NULLS_SQL, lineitem_with_nulls, rounded, sql_rounded, table

TRAIN_LI = f"SELECT * FROM ({LINEITEM_WITH_NULLS_SQL}) WHERE l_orderkey % 5 <> 0"


def _train_li(spark, sf):
    li = lineitem_with_nulls(spark, sf)
    return li, li.where(F.col("l_orderkey") % 5 != 0)


@query("F1_numeric_impute", sql_rounded(f"""
SELECT 'mean' AS strategy, 'l_discount' AS column_name, avg(l_discount) AS fill_value FROM ({TRAIN_LI})
UNION ALL SELECT 'mean', 'l_tax', avg(l_tax) FROM ({TRAIN_LI})
UNION ALL SELECT 'median', 'l_discount', quantile_cont(l_discount, 0.5) FROM ({TRAIN_LI})
UNION ALL SELECT 'median', 'l_tax', quantile_cont(l_tax, 0.5) FROM ({TRAIN_LI})""", ["fill_value"]))
def f1_numeric_impute(spark, sf):
    _, train = _train_li(spark, sf)
    rows = []
    for strategy in ("mean", "median"):
        fills = fx.fit_numeric_imputer(train, ["l_discount", "l_tax"], strategy)
        rows += [(strategy, c, float(v)) for c, v in fills.items()]
    return rounded(spark.createDataFrame(rows, "strategy string, column_name string, fill_value double"))


@query("F1_impute_apply", sql_rounded(f"""
SELECT l_orderkey, l_linenumber,
  coalesce(l_discount, (SELECT avg(l_discount) FROM ({TRAIN_LI}))) AS l_discount,
  coalesce(l_tax, (SELECT avg(l_tax) FROM ({TRAIN_LI}))) AS l_tax
FROM ({LINEITEM_WITH_NULLS_SQL})""", ["l_discount", "l_tax"]))
def f1_impute_apply(spark, sf):
    li, train = _train_li(spark, sf)
    fills = fx.fit_numeric_imputer(train, ["l_discount", "l_tax"], "mean")
    return rounded(fx.apply_fill(li.select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), fills))


def _mode_sql(c, tbl):
    return (f"SELECT '{c}' AS column_name, (SELECT CAST({c} AS VARCHAR) FROM {tbl} WHERE {c} IS NOT NULL "
            f"GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode")


@query("F2_categorical_impute", "\nUNION ALL\n".join(
    [_mode_sql(c, "orders") for c in ("o_orderstatus", "o_orderpriority")] + [_mode_sql("p_brand", "part"),
                                                                              _mode_sql("p_type", "part")]))
def f2_categorical_impute(spark, sf):
    a = fx.fit_mode(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])
    b = fx.fit_mode(table(spark, sf, "part"), ["p_brand", "p_type"])
    a.update(b)
    return spark.createDataFrame([(k, str(v)) for k, v in a.items()], "column_name string, mode string")


@query("F3_standard_scale", sql_rounded(f"""
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp,
                  stddev_pop(l_extendedprice) AS sp FROM ({TRAIN_LI}))
SELECT l_orderkey, l_linenumber,
  (l_quantity - mq) / CASE WHEN sq = 0 THEN 1 ELSE sq END AS l_quantity,
  (l_extendedprice - mp) / CASE WHEN sp = 0 THEN 1 ELSE sp END AS l_extendedprice
FROM lineitem, s""", ["l_quantity", "l_extendedprice"]))
def f3_standard_scale(spark, sf):
    li, train = _train_li(spark, sf)
    params = fx.fit_scaler(train, ["l_quantity", "l_extendedprice"], "standard")
    return rounded(fx.apply_scaler(li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), params))


@query("F4_minmax_scale", sql_rounded(f"""
WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) - min(l_quantity) AS r,
                  min(l_tax) AS ta, max(l_tax) - min(l_tax) AS tr FROM ({TRAIN_LI}))
SELECT l_orderkey, l_linenumber,
  (l_quantity - a) / CASE WHEN r = 0 THEN 1 ELSE r END AS l_quantity,
  (l_tax - ta) / CASE WHEN tr = 0 THEN 1 ELSE tr END AS l_tax
FROM ({LINEITEM_WITH_NULLS_SQL}), s""", ["l_quantity", "l_tax"]))
def f4_minmax_scale(spark, sf):
    li, train = _train_li(spark, sf)
    params = fx.fit_scaler(train, ["l_quantity", "l_tax"], "minmax")
    return rounded(fx.apply_scaler(li.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), params))


@query("F6_one_hot_index", """
WITH c AS (SELECT DISTINCT CAST(p_brand AS VARCHAR) AS v FROM part WHERE p_partkey % 5 <> 0 AND p_brand IS NOT NULL),
k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS idx FROM c)
SELECT p.p_partkey, CAST(k.idx AS INTEGER) AS hot_index, CAST((SELECT count(*) FROM c) AS INTEGER) AS n_categories
FROM part p LEFT JOIN k ON CAST(p.p_brand AS VARCHAR) = k.v""")
def f6_one_hot_index(spark, sf):
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    cats = fx.fit_categories(part.where(F.col("p_partkey") % 5 != 0), ["p_brand"])
    stages = pipeline.preparation(spark, [], ["p_brand"], {}, {}, cats)
    arr = vector_to_array(F.col("features"))
    out = PipelineModel(stages=stages).transform(part).select("p_partkey", arr.alias("a"))
    pos = F.array_position(F.col("a"), F.lit(1.0))
    return out.select("p_partkey", F.when(pos > 0, (pos - 1).cast("int")).alias("hot_index"),
                      F.size("a").cast("int").alias("n_categories"))


@query("F7_ordinal_encode", """
WITH c AS (SELECT DISTINCT CAST(o_orderpriority AS VARCHAR) AS v FROM orders
           WHERE o_orderkey % 5 <> 0 AND o_orderpriority IS NOT NULL),
k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS idx FROM c)
SELECT o.o_orderkey, CAST(coalesce(k.idx, -1) AS DOUBLE) AS o_orderpriority
FROM orders o LEFT JOIN k ON CAST(o.o_orderpriority AS VARCHAR) = k.v""")
def f7_ordinal_encode(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    cats = fx.fit_categories(o.where(F.col("o_orderkey") % 5 != 0), ["o_orderpriority"])
    return fx.ordinal_encode(o, cats, ["o_orderpriority"])


@query("F8_label_table", """
SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS index, label
FROM (SELECT DISTINCT CAST(l_returnflag AS VARCHAR) AS label FROM lineitem WHERE l_returnflag IS NOT NULL)""")
def f8_label_table(spark, sf):
    li = table(spark, sf, "lineitem")
    train, test = li.where(F.col("l_orderkey") % 5 != 0), li.where(F.col("l_orderkey") % 5 == 0)
    return fx.label_table(train, test, "l_returnflag").select(F.col("index").cast("int"), "label")


@query("F9_decode", """
WITH lab AS (SELECT row_number() OVER (ORDER BY label) - 1 AS idx, label
             FROM (SELECT DISTINCT CAST(l_returnflag AS VARCHAR) AS label FROM lineitem))
SELECT DISTINCT l.l_linenumber - 1 AS code, coalesce(lab.label, CAST(l.l_linenumber - 1 AS VARCHAR)) AS decoded
FROM lineitem l LEFT JOIN lab ON l.l_linenumber - 1 = lab.idx""")
def f9_decode(spark, sf):
    li = table(spark, sf, "lineitem")
    labels = fx.label_table(li, li.limit(0), "l_returnflag")
    codes = li.select((F.col("l_linenumber") - 1).alias("code"))
    return fx.decode_labels(codes, "code", labels).distinct()


SCORE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag"]
_CODE_FLAG = ("(SELECT CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code, v FROM "
              "(SELECT DISTINCT l_returnflag AS v FROM lineitem))")


def _scored_sql():
    return (f"SELECT l_quantity, l_discount, l_tax, l_linenumber, k.code AS l_returnflag, l_extendedprice "
            f"FROM lineitem LEFT JOIN {_CODE_FLAG} k ON l_returnflag = k.v")


def _f10_sql():
    parts = []
    for i, f in enumerate(SCORE_FEATURES):
        parts.append(f"""SELECT CAST({i} AS INTEGER) AS position, '{f}' AS feature,
  coalesce(abs(CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b))
  END), 0.0) AS score
FROM (SELECT CAST({f} AS DOUBLE) AS a, l_extendedprice AS b FROM ({_scored_sql()}))""")
    return "\nUNION ALL\n".join(parts)


@query("F10_correlation_scores", sql_rounded(_f10_sql(), ["score"]))
def f10_correlation_scores(spark, sf):
    li = table(spark, sf, "lineitem").select(*SCORE_FEATURES, "l_extendedprice")
    prepared = fx.selector_frame(li, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], ["l_returnflag"])
    return rounded(fx.correlation_scores(prepared, SCORE_FEATURES, "l_extendedprice"))


def _f11_sql(discrete=("l_returnflag",), bins=10):
    src = _scored_sql()
    cut = [c for c in SCORE_FEATURES + ["l_extendedprice"] if c not in discrete]
    at = ", ".join(str(i / bins) for i in range(1, bins))
    edges = ", ".join(f"list_distinct(quantile_cont(CAST({c} AS DOUBLE), [{at}])) AS e_{c}" for c in cut)

    def b(c):
        if c in discrete:
            return f"CAST({c} AS VARCHAR)"
        return f"CAST(len(list_filter(e_{c}, lambda e: e < CAST({c} AS DOUBLE))) AS VARCHAR)"
    longs = "\nUNION ALL\n".join(
        f"SELECT {i} AS position, '{f}' AS feature, {b(f)} AS xb, {b('l_extendedprice')} AS y "
        f"FROM ({src}), s WHERE {f} IS NOT NULL AND l_extendedprice IS NOT NULL"
        for i, f in enumerate(SCORE_FEATURES))
    return f"""
WITH s AS (SELECT {edges} FROM ({src})),
l AS ({longs}),
j AS (SELECT position, feature, xb, y, count(*) AS nxy FROM l GROUP BY ALL),
m AS (SELECT *, sum(nxy) OVER (PARTITION BY position, xb) AS nx, sum(nxy) OVER (PARTITION BY position, y) AS ny,
        sum(nxy) OVER (PARTITION BY position) AS n FROM j)
SELECT CAST(position AS INTEGER) AS position, feature,
  sum((CAST(nxy AS DOUBLE) / n) * ln((CAST(nxy AS DOUBLE) * n) / (CAST(nx AS DOUBLE) * ny))) AS score
FROM m GROUP BY position, feature"""


@query("F11_mutual_information", sql_rounded(_f11_sql(), ["score"]))
def f11_mutual_information(spark, sf):
    li = table(spark, sf, "lineitem").select(*SCORE_FEATURES, "l_extendedprice")
    prepared = fx.selector_frame(li, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], ["l_returnflag"])
    return rounded(fx.mutual_information(prepared, SCORE_FEATURES, "l_extendedprice", discrete_target=False,
                                         discrete=["l_returnflag"]))


@query("F12_top_features", sql_rounded(f"""
SELECT CAST(row_number() OVER (ORDER BY score DESC, feature) AS INTEGER) AS rank, feature, score
FROM ({_f10_sql()}) ORDER BY score DESC, feature LIMIT 3""", ["score"]))
def f12_top_features(spark, sf):
    li = table(spark, sf, "lineitem").select(*SCORE_FEATURES, "l_extendedprice")
    prepared = fx.selector_frame(li, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], ["l_returnflag"])
    scores = fx.correlation_scores(prepared, SCORE_FEATURES, "l_extendedprice")
    return rounded(fx.top_features(scores, 3, n_columns=len(SCORE_FEATURES) + 1))


@query("F14_output_names", """
SELECT 0 AS position, 'num__p_size' AS name
UNION ALL
SELECT CAST(row_number() OVER (ORDER BY v) AS INTEGER), 'cat__p_brand_' || regexp_replace(v, '[\\[\\]<>]', '_', 'g')
FROM (SELECT DISTINCT CAST(p_brand AS VARCHAR) AS v FROM part WHERE p_brand IS NOT NULL)""")
def f14_output_names(spark, sf):
    part = table(spark, sf, "part").select("p_size", "p_brand")
    pre = fx.Preprocessor.fit(part, ["p_size"], ["p_brand"])
    return spark.createDataFrame(list(enumerate(pre.names)), "position int, name string")


@query("F13_transform_apply", sql_rounded("""
WITH s AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS sd FROM part WHERE p_partkey % 5 <> 0)
SELECT p_partkey, (p_size - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS num__p_size,
  CASE WHEN p_brand = 'Brand#11' THEN 1.0 ELSE 0.0 END AS "cat__p_brand_Brand#11"
FROM part, s""", ["num__p_size"]))
def f13_transform_apply(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand")
    pre = fx.Preprocessor.fit(part.where(F.col("p_partkey") % 5 != 0), ["p_size"], ["p_brand"])
    out = pre.transform(part, keep=["p_partkey"])
    return rounded(out.select("p_partkey", "num__p_size", "`cat__p_brand_Brand#11`"))


@query("F13_saved_pipeline_features", sql_rounded("""
WITH t AS (SELECT * REPLACE (nullif(p_size, 7) AS p_size) FROM part),
f AS (SELECT avg(p_size) AS fill, avg(p_retailprice) AS mp, stddev_pop(p_retailprice) AS sp FROM t WHERE p_partkey % 5 <> 0),
s AS (SELECT avg(coalesce(p_size, fill)) AS ms, stddev_pop(coalesce(p_size, fill)) AS ss FROM t, f WHERE p_partkey % 5 <> 0),
b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) + 1 AS i FROM (SELECT DISTINCT p_brand FROM t WHERE p_partkey % 5 <> 0)),
k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i
      FROM (SELECT DISTINCT CAST(p_size > 25 AS VARCHAR) AS v FROM part WHERE p_partkey % 5 <> 0))
SELECT p_partkey, CAST(0 AS INTEGER) AS position, (coalesce(p_size, fill) - ms) / ss AS value FROM t, f, s
UNION ALL SELECT p_partkey, 1, (p_retailprice - mp) / sp FROM t, f
UNION ALL SELECT p_partkey, CAST(b.i AS INTEGER), 1.0 FROM t JOIN b USING (p_brand)
UNION ALL SELECT p_partkey, CAST(2 + (SELECT count(*) FROM b) + k.i AS INTEGER), 1.0
FROM part JOIN k ON CAST(p_size > 25 AS VARCHAR) = k.v""", ["value"]))
def f13_saved_pipeline_features(spark, sf):
    """Every feature of every row, all categories of a text and a boolean column, by stages that were saved and loaded."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array
    part = table(spark, sf, "part").select(
        "p_partkey", F.nullif("p_size", F.lit(7)).alias("p_size"), "p_retailprice", "p_brand", (F.col("p_size") > 25).alias("large"))
    pre = fx.Preprocessor.fit(part.where(F.col("p_partkey") % 5 != 0), ["p_size", "p_retailprice"], ["p_brand", "large"])
    path = scratch_dir(spark, "preparation")
    PipelineModel(stages=pre.stages()).write().save(path)
    out = PipelineModel.load(path).transform(part)
    every = out.select("p_partkey", F.posexplode(vector_to_array("features")).alias("position", "value"))
    return rounded(every.where((F.col("position") < 2) | (F.col("value") != 0)))
