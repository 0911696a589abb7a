"""Registered queries for sources (S), predicates (P), profiling (A) and plot data."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import checks, plots, profile
from quarry.plans.registry import pct_sql, query
from quarry.plans.tables import (LINEITEM_NUMERIC, LINEITEM_WITH_NULLS_SQL, lineitem_with_nulls, rounded,
                                 sql_rounded, table)
from quarry.sources import preview

NUM = list(LINEITEM_NUMERIC)
SRC = f"SELECT {', '.join(NUM)} FROM ({LINEITEM_WITH_NULLS_SQL})"


def _union(parts):
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- A3

def _a3_sql(cols, src):
    parts = []
    for i, c in enumerate(cols):
        parts.append(f"""
SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, count(x) AS count, avg(x) AS mean,
  quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std, min(x) AS min, quantile_cont(x, 0.25) AS q25,
  quantile_cont(x, 0.75) AS q75, max(x) AS max,
  CASE WHEN var_pop(x) > 0 THEN avg(power(x - mu, 3)) / power(var_pop(x), 1.5) END AS skewness,
  CASE WHEN var_pop(x) > 0 THEN avg(power(x - mu, 4)) / power(var_pop(x), 2) - 3 END AS kurtosis
FROM (SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS mu FROM ({src})) t
HAVING count(x) > 0""")
    return sql_rounded(_union(parts), ["mean", "median", "std", "min", "q25", "q75", "max", "skewness",
                                       "kurtosis"])


@query("A3_numeric_summary", _a3_sql(NUM, SRC))
def a3_numeric_summary(spark, sf):
    return rounded(profile.numeric_summary(lineitem_with_nulls(spark, sf).select(*NUM)))


# ---------------------------------------------------------------- A1

def _a1_sql(cols, tbl):
    c = ", ".join(cols)
    return sql_rounded(f"""
WITH g AS (SELECT {c}, count(*) AS c FROM {tbl} GROUP BY {c})
SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n_rows, CAST({len(cols)} AS INTEGER) AS n_columns,
  CAST(coalesce(sum(c), 0) - count(*) AS BIGINT) AS duplicates,
  {pct_sql('coalesce(sum(c), 0) - count(*)', 'coalesce(sum(c), 0)')} AS duplicate_pct
FROM g""", ["duplicate_pct"])


@query("A1_overview_documents", _a1_sql(["text", "lang"], "documents"))
def a1_overview_documents(spark, sf):
    return rounded(profile.overview(table(spark, sf, "documents").select("text", "lang")))


@query("A1_overview_lineitem_flags", _a1_sql(["l_returnflag", "l_linestatus"], "lineitem"))
def a1_overview_lineitem_flags(spark, sf):
    return rounded(profile.overview(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")))


# ---------------------------------------------------------------- A2

LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
          "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _a2_sql():
    parts = [f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name,
  count(*) FILTER (WHERE {c} IS NULL) AS missing_count,
  {pct_sql(f'count(*) FILTER (WHERE {c} IS NULL)', 'count(*)')} AS missing_pct
FROM ({LINEITEM_WITH_NULLS_SQL})""" for i, c in enumerate(LI_ALL)]
    return sql_rounded(f"SELECT * FROM ({_union(parts)}) WHERE missing_count > 0", ["missing_pct"])


@query("A2_missing_values", _a2_sql())
def a2_missing_values(spark, sf):
    return rounded(profile.missing_values(lineitem_with_nulls(spark, sf).select(*LI_ALL)))


# ---------------------------------------------------------------- A4

PART_CAT = ["p_name", "p_brand", "p_type"]


def _a4_sql():
    longs = _union([f"SELECT {i} AS position, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM part"
                    for i, c in enumerate(PART_CAT)])
    return sql_rounded(f"""
WITH long AS ({longs}),
c AS (SELECT position, column_name, value, count(*) AS count FROM long WHERE value IS NOT NULL GROUP BY ALL),
u AS (SELECT position, count(*) AS unique_count FROM c GROUP BY position),
r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY count DESC, value) AS rank FROM c)
SELECT CAST(r.position AS INTEGER) AS position, r.column_name, u.unique_count, CAST(r.rank AS INTEGER) AS rank,
  r.value, r.count, {pct_sql('r.count', '(SELECT count(*) FROM part)')} AS pct
FROM r JOIN u USING (position) WHERE r.rank <= 10""", ["pct"])


@query("A4_categorical_summary", _a4_sql())
def a4_categorical_summary(spark, sf):
    return rounded(profile.categorical_summary(table(spark, sf, "part").select(*PART_CAT)))


# ---------------------------------------------------------------- A5, A8, A18

def _pairs_sql(cols, src, diag=True):
    parts = []
    for i in range(len(cols)):
        for j in range(i if diag else i + 1, len(cols)):
            a, b = cols[i], cols[j]
            corr = ("CASE WHEN stddev_pop(xa) * stddev_pop(xb) > 0 THEN covar_pop(xa, xb) / "
                    "(stddev_pop(xa) * stddev_pop(xb)) END")
            inner = (f"SELECT CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END AS xa, "
                     f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({b} AS DOUBLE) END AS xb FROM ({src})")
            parts.append(f"SELECT {i} AS i, {j} AS j, '{a}' AS feature_1, '{b}' AS feature_2, {corr} AS correlation "
                         f"FROM ({inner})")
    return _union(parts)


def _a5_sql(cols, src):
    pairs = _pairs_sql(cols, src)
    return sql_rounded(f"""
WITH p AS ({pairs})
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, feature_1, feature_2, correlation FROM p
UNION ALL
SELECT CAST(j AS INTEGER), CAST(i AS INTEGER), feature_2, feature_1, correlation FROM p WHERE i <> j""",
                       ["correlation"])


@query("A5_correlation_matrix", _a5_sql(NUM, SRC))
def a5_correlation_matrix(spark, sf):
    return rounded(profile.correlation_matrix(lineitem_with_nulls(spark, sf).select(*NUM)))


def _a8_sql(cols, src, threshold):
    pairs = _pairs_sql(cols, src, diag=False)
    return sql_rounded(f"""
WITH p AS ({pairs})
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, feature_1, feature_2, correlation,
  CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS relationship,
  CAST(row_number() OVER (ORDER BY abs(correlation) DESC, i, j) AS INTEGER) AS rank
FROM p WHERE abs(correlation) >= {threshold}""", ["correlation"])


@query("A8_strong_correlations", _a8_sql(NUM, SRC, 0.7))
def a8_strong_correlations(spark, sf):
    return rounded(profile.strong_correlations(lineitem_with_nulls(spark, sf).select(*NUM)))


HEAT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("A18_heatmap", _a5_sql(HEAT, f"SELECT {', '.join(HEAT)} FROM lineitem"))
def a18_heatmap(spark, sf):
    li = table(spark, sf, "lineitem")
    # unknown ('no_such_column') and non-numeric ('l_returnflag') names are dropped
    return rounded(profile.heatmap(li, HEAT[:2] + ["no_such_column", "l_returnflag"] + HEAT[2:]))


# ---------------------------------------------------------------- A6, A7

def _a6_sql(cols, src):
    longs = _union([f"SELECT {i} AS position, '{c}' AS column_name, CAST({c} AS DOUBLE) AS x FROM ({src})"
                    for i, c in enumerate(cols)])
    return sql_rounded(f"""
WITH b AS ({longs}),
q AS (SELECT position, column_name, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3
      FROM b WHERE x IS NOT NULL GROUP BY ALL),
w AS (SELECT position, column_name, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT CAST(w.position AS INTEGER) AS position, w.column_name,
  count(*) FILTER (WHERE b.x < w.lo OR b.x > w.hi) AS count,
  {pct_sql('count(*) FILTER (WHERE b.x < w.lo OR b.x > w.hi)', 'count(b.x)')} AS percentage,
  w.lo AS lower_bound, w.hi AS upper_bound
FROM b JOIN w USING (position, column_name)
GROUP BY w.position, w.column_name, w.lo, w.hi
HAVING count(*) FILTER (WHERE b.x < w.lo OR b.x > w.hi) > 0""", ["percentage", "lower_bound", "upper_bound"])


@query("A6_outliers", _a6_sql(NUM, SRC))
def a6_outliers(spark, sf):
    return rounded(profile.outliers(lineitem_with_nulls(spark, sf).select(*NUM)))


def _moments_cte(cols, src):
    return _union([f"""
SELECT {i} AS position, '{c}' AS column_name, count(x) AS n,
  CASE WHEN var_pop(x) > 0 THEN avg(power(x - mu, 3)) / power(var_pop(x), 1.5) END AS skewness
FROM (SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS mu FROM ({src}))""" for i, c in
                   enumerate(cols)])


def _a7_sql(cols, src):
    return sql_rounded(f"""
WITH m AS ({_moments_cte(cols, src)})
SELECT CAST(position AS INTEGER) AS position, column_name, skewness,
  CASE WHEN skewness > 0 THEN 'right' ELSE 'left' END AS direction,
  CASE WHEN abs(skewness) < 1 THEN 'moderate' ELSE 'high' END AS severity
FROM m WHERE n > 2 AND abs(skewness) > 0.5""", ["skewness"])


SKEW_SRC = ("SELECT l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, l_tax, "
            "CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
SKEW_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice"]


def _skew_frame(spark, sf):
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_quantity", "l_extendedprice", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), "l_tax",
        F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query("A7_skewed_columns", _a7_sql(NUM, SRC))
def a7_skewed_columns(spark, sf):
    return rounded(profile.skewed_columns(lineitem_with_nulls(spark, sf).select(*NUM)))


# ---------------------------------------------------------------- A9

def _a9_sql(cols, src):
    parts = [f"SELECT {i} AS position, '{c}' AS column_name, count(DISTINCT {c}) AS d, count(*) AS n FROM ({src})"
             for i, c in enumerate(cols)]
    return sql_rounded(f"""
WITH u AS ({_union(parts)}), k AS (
  SELECT *, {pct_sql('d', 'n')} AS p,
    CASE WHEN d <= 1 THEN 'constant' WHEN {pct_sql('d', 'n')} < 1 THEN 'near_constant' END AS type FROM u)
SELECT CAST(position AS INTEGER) AS position, column_name, type, CAST(d AS BIGINT) AS unique_values,
  CASE WHEN d > 1 THEN p END AS unique_percentage
FROM k WHERE type IS NOT NULL""", ["unique_percentage"])


@query("A9_constant_columns", _a9_sql(LI_ALL, "SELECT * FROM lineitem"))
def a9_constant_columns(spark, sf):
    return rounded(profile.constant_columns(table(spark, sf, "lineitem").select(*LI_ALL)))


# ---------------------------------------------------------------- A10, A11

def _a10_sql(cols, src):
    return sql_rounded(f"""
SELECT 'outliers' AS kind, position, column_name AS feature, percentage AS value, CAST(count AS VARCHAR) AS detail
FROM ({_a6_sql(cols, src)})
UNION ALL
SELECT 'skewness', position, column_name, skewness, direction || ',' || severity FROM ({_a7_sql(cols, src)})
UNION ALL
SELECT 'strong_correlation', rank, feature_1 || ' & ' || feature_2, correlation, relationship
FROM ({_a8_sql(cols, src, 0.7)})
UNION ALL
SELECT 'constant', position, column_name, CAST(unique_values AS DOUBLE), type FROM ({_a9_sql(cols, src)})""",
                       ["value"])


@query("A10_insights", _a10_sql(SKEW_COLS, SKEW_SRC))
def a10_insights(spark, sf):
    return rounded(profile.insights(_skew_frame(spark, sf)))


def _a11_sql(cols, src):
    return f"""
WITH r AS (
  SELECT 0 AS rule, position AS item, column_name AS feature,
    'Skewed distribution (' || direction || ' skew: ' || printf('%.2f', skewness) || ')' AS issue,
    CASE WHEN direction = 'right' THEN 'Log transform' ELSE 'Box-Cox transform' END AS recommendation,
    CASE WHEN severity = 'high' THEN 'high' ELSE 'medium' END AS priority,
    'Can improve model performance by normalizing distribution' AS reason
  FROM ({_a7_sql(cols, src)})
  UNION ALL
  SELECT 1, position, column_name, 'Outliers detected (' || printf('%.1f', percentage) || '%)',
    'Consider robust scaling or outlier removal', 'medium', 'Outliers can negatively impact model training'
  FROM ({_a6_sql(cols, src)}) WHERE percentage > 5
  UNION ALL
  SELECT 2, position, column_name, 'Constant or near-constant feature', 'Remove this feature', 'high',
    'Non-informative features don''t contribute to predictions'
  FROM ({_a9_sql(cols, src)})
  UNION ALL
  SELECT 3, rank, feature_1 || ' & ' || feature_2, 'High correlation (' || printf('%.2f', correlation) || ')',
    'Consider removing one or using dimensionality reduction', 'medium',
    'Multicollinearity can reduce model interpretability'
  FROM ({_a8_sql(cols, src, 0.85)}) WHERE rank <= 5)
SELECT CAST(row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END,
    rule, item) AS INTEGER) AS rank, feature, issue, recommendation, priority, reason
FROM r"""


@query("A11_recommendations", _a11_sql(SKEW_COLS, SKEW_SRC))
def a11_recommendations(spark, sf):
    return profile.recommendations(_skew_frame(spark, sf))


# ---------------------------------------------------------------- A13

@query("A13_plot_field_summary", sql_rounded("""
SELECT 'l_extendedprice' AS field, 'numeric' AS field_type, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
  avg(l_extendedprice) AS mean, CAST(NULL AS INTEGER) AS rank, CAST(NULL AS VARCHAR) AS value FROM lineitem
UNION ALL
SELECT 'p_type', 'categorical', NULL, NULL, NULL, CAST(row_number() OVER (ORDER BY v NULLS LAST) AS INTEGER), v
FROM (SELECT DISTINCT CAST(p_type AS VARCHAR) AS v FROM part ORDER BY v NULLS LAST LIMIT 20)""",
                                              ["min", "max", "mean"]))
def a13_plot_field_summary(spark, sf):
    num = profile.plot_field_summary(table(spark, sf, "lineitem"), "l_extendedprice")
    cat = profile.plot_field_summary(table(spark, sf, "part"), "p_type")
    return rounded(num.unionByName(cat))


# ---------------------------------------------------------------- A20

@query("A20_class_distribution", """
SELECT CAST(l_returnflag AS VARCHAR) AS class, count(*) AS count,
  round_even(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM lineitem), 4) AS share
FROM lineitem GROUP BY l_returnflag""")
def a20_class_distribution(spark, sf):
    return profile.class_distribution(table(spark, sf, "lineitem"), "l_returnflag").drop("raw_share")


# ---------------------------------------------------------------- S2, S6, S7

@query("S2_frame_load", "SELECT * FROM events")
def s2_frame_load(spark, sf):
    from quarry.sources.readers import from_frame
    return from_frame(spark, spark.read.parquet(f"{sf}/events.parquet"))


@query("S6_preview_rows", """
SELECT """ + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in
                       ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]) + """
FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 8)""")
def s6_preview_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                          "o_orderpriority")
    return preview.preview_rows(o, key="o_orderkey", n=8)


@query("S7_data_preview", """
SELECT *, (SELECT count(*) FROM orders) AS total_rows FROM orders ORDER BY o_orderkey LIMIT 100""")
def s7_data_preview(spark, sf):
    return preview.data_preview(table(spark, sf, "orders"), key="o_orderkey", n=100)


# ---------------------------------------------------------------- P1, P2, P4-P7, P9, P10

@query("P1_target_checks", """
SELECT 'l_returnflag' AS target, true AS present, count(*) AS n_rows,
  count(*) FILTER (WHERE l_returnflag IS NULL) AS null_count,
  count(*) > 0 AND count(l_returnflag) = 0 AS all_null,
  count(*) FILTER (WHERE l_returnflag IS NULL) > 0 AS any_null
FROM lineitem""")
def p1_target_checks(spark, sf):
    return checks.target_checks(table(spark, sf, "lineitem"), "l_returnflag")


@query("P2_min_rows", """
SELECT (SELECT count(*) FROM lineitem) AS n_rows,
  (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)) AS n_dedup,
  100 AS min_rows,
  (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)) >= 100 AS passes""")
def p2_min_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return checks.min_rows_gate(li, min_rows=100)


@query("P4_feature_target_split", "SELECT * EXCLUDE (l_extendedprice) FROM lineitem")
def p4_feature_target_split(spark, sf):
    features, _ = checks.separate_target(table(spark, sf, "lineitem"), "l_extendedprice")
    return features


@query("P5_manual_projection", "SELECT l_quantity, l_discount, l_tax FROM lineitem")
def p5_manual_projection(spark, sf):
    li = table(spark, sf, "lineitem")
    return checks.project_features(li, li, ["l_quantity", "l_discount", "l_tax"], target="l_extendedprice")[0]


@query("P6_null_row_filter", f"""
SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM ({LINEITEM_WITH_NULLS_SQL})
WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL""")
def p6_null_row_filter(spark, sf):
    li = lineitem_with_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return plots.complete_pairs(li, "l_discount", "l_tax")


@query("P7_outlier_filter", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3
           FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, q
WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)""")
def p7_outlier_filter(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return profile.outlier_filter(li, "l_extendedprice")


@query("P9_feature_types", """
SELECT CAST(row_number() OVER (ORDER BY ordinal_position) - 1 AS INTEGER) AS position, column_name,
  CASE WHEN data_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE', 'HUGEINT')
       OR data_type LIKE 'DECIMAL%' THEN 'numerical' ELSE 'categorical' END AS kind
FROM information_schema.columns
WHERE table_name = 'lineitem' AND column_name <> 'l_extendedprice'""")
def p9_feature_types(spark, sf):
    features, _ = checks.separate_target(table(spark, sf, "lineitem"), "l_extendedprice")
    return checks.feature_types_frame(features)


@query("P10_task_type", """
SELECT 'l_returnflag' AS target, count(DISTINCT l_returnflag) AS n_distinct,
  CASE WHEN count(DISTINCT l_returnflag) <= 20 THEN 'classification' ELSE 'regression' END AS task_type
FROM lineitem
UNION ALL
SELECT 'o_totalprice', count(DISTINCT o_totalprice),
  CASE WHEN count(DISTINCT o_totalprice) <= 20 THEN 'classification' ELSE 'regression' END
FROM orders""")
def p10_task_type(spark, sf):
    a = checks.task_type_frame(table(spark, sf, "lineitem"), "l_returnflag")
    b = checks.task_type_frame(table(spark, sf, "orders"), "o_totalprice")
    return a.unionByName(b)


# ---------------------------------------------------------------- A14-A17

def _hist_sql():
    return sql_rounded("""
WITH s AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events WHERE value IS NOT NULL
           GROUP BY event_type),
b AS (SELECT e.event_type, s.lo, s.hi,
        CASE WHEN s.hi = s.lo THEN 0
             ELSE least(CAST(floor((e.value - s.lo) / (s.hi - s.lo) * 30) AS INTEGER), 29) END AS bin
      FROM events e JOIN s USING (event_type) WHERE e.value IS NOT NULL)
SELECT event_type, CAST(bin AS INTEGER) AS bin,
  lo + (hi - lo) * bin / 30 AS bin_start,
  CASE WHEN hi = lo THEN hi ELSE lo + (hi - lo) * (bin + 1) / 30 END AS bin_end,
  count(*) AS count
FROM b GROUP BY event_type, bin, lo, hi""", ["bin_start", "bin_end"])


@query("A14_histogram", _hist_sql())
def a14_histogram(spark, sf):
    return rounded(plots.histogram(table(spark, sf, "events"), "value", bins=30, group="event_type"))


@query("A15_scatter", """
SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS series FROM lineitem
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""")
def a15_scatter(spark, sf):
    return plots.scatter(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", group="l_returnflag")


@query("A16_box", sql_rounded("""
SELECT event_type AS grp, count(value) AS count, min(value) AS min, quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS max,
  avg(value) AS mean, stddev_samp(value) AS sd
FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY event_type""",
                              ["min", "q1", "median", "q3", "max", "mean", "sd"]))
def a16_box(spark, sf):
    return rounded(plots.box(table(spark, sf, "events"), "value", group="event_type"))


@query("A17_bar", """
SELECT CAST(p_brand AS VARCHAR) AS value, count(*) AS count,
  CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(p_brand AS VARCHAR)) AS INTEGER) AS rank
FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY count DESC, value LIMIT 20""")
def a17_bar(spark, sf):
    return plots.bar(table(spark, sf, "part"), "p_brand", top=20)


# ---------------------------------------------------------------- S1, S3, S4

S1_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax", "l_returnflag", "l_linestatus"]


@query("S1_csv_scan", f"""
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
FROM ({LINEITEM_WITH_NULLS_SQL})""")
def s1_csv_scan(spark, sf):
    """S3 then S1: lineitem (with NULLs) written as CSV by Spark, read back with
    NA-token handling and one-pass type inference."""
    from quarry.session import scratch_dir
    from quarry.sources import readers
    path = scratch_dir(spark, "csv")
    readers.write_table(lineitem_with_nulls(spark, sf).select(*S1_COLS), path, fmt="csv")
    return readers.read_csv(spark, path)


@query("S4_report_roundtrip", _a2_sql())
def s4_report_roundtrip(spark, sf):
    """A flat report frame (A2) written as JSON and read back with its schema."""
    from quarry.session import scratch_dir
    from quarry.sources import readers
    rep = rounded(profile.missing_values(lineitem_with_nulls(spark, sf).select(*LI_ALL)))
    path = scratch_dir(spark, "report")
    readers.write_report(rep, path)
    return readers.read_report(spark, path, rep.schema)


@query("S1_csv_text", "SELECT doc_id, text FROM documents")
def s1_csv_text(spark, sf):
    """Whole texts with quotes, commas and line breaks through CSV and back."""
    from quarry.session import scratch_dir
    from quarry.sources import readers
    path = scratch_dir(spark, "csv")
    readers.write_table(table(spark, sf, "documents").select("doc_id", "text"), path, fmt="csv")
    return readers.read_csv(spark, path, schema={"doc_id": "long", "text": "string"})


# lineitem with real tails: a product, a higher power, a falling square, and a near copy of a column
TAIL_COLS = ["l_quantity", "amount", "power", "fall", "close"]
TAIL_SRC = ("SELECT l_quantity, l_extendedprice * l_quantity / 1000000 AS amount, "
            "l_quantity * l_quantity * l_quantity * l_extendedprice / 1000000000 AS power, "
            "-(l_quantity * l_quantity * l_extendedprice) / 1000000 AS fall, "
            "l_quantity + l_extendedprice / 10000 AS close FROM lineitem")


def _tail_frame(spark, sf):
    q, e = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        q, (e * q / 1000000).alias("amount"), (q * q * q * e / 1000000000).alias("power"),
        (-(q * q * e) / 1000000).alias("fall"), (q + e / 10000).alias("close"))


@query("A6_outliers_tails", _a6_sql(TAIL_COLS, TAIL_SRC))
def a6_outliers_tails(spark, sf):
    return rounded(profile.outliers(_tail_frame(spark, sf)))


@query("A7_skewed_tails", _a7_sql(TAIL_COLS, TAIL_SRC))
def a7_skewed_tails(spark, sf):
    return rounded(profile.skewed_columns(_tail_frame(spark, sf)))


@query("A8_strong_tails", _a8_sql(TAIL_COLS, TAIL_SRC, 0.7))
def a8_strong_tails(spark, sf):
    return rounded(profile.strong_correlations(_tail_frame(spark, sf)))


@query("P7_outlier_rows_tails", f"""
WITH t AS ({TAIL_SRC}),
q AS (SELECT quantile_cont(power, 0.25) AS q1, quantile_cont(power, 0.75) AS q3 FROM t)
SELECT l_quantity, count(*) AS n FROM t, q
WHERE power < q1 - 1.5 * (q3 - q1) OR power > q3 + 1.5 * (q3 - q1) GROUP BY l_quantity""")
def p7_outlier_rows_tails(spark, sf):
    rows = profile.outlier_filter(_tail_frame(spark, sf), "power")
    return rows.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"))
