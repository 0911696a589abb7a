"""Registered queries for validation (V) and deduplication/splits (R).

Train and test sides come from a deterministic predicate over the whole table
(``o_orderkey % 5 = 0`` is test), so both engines see the same two sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import split, validate
from quarry.plans.registry import query
from quarry.plans.tables import LINEITEM_WITH_NULLS_SQL, lineitem_with_nulls, rounded, sql_rounded, table

TRAIN_SQL = "SELECT * FROM orders WHERE o_orderkey % 5 <> 0"
TEST_SQL = "SELECT * FROM orders WHERE o_orderkey % 5 = 0"


def _sides(spark, sf):
    o = table(spark, sf, "orders")
    return o.where(F.col("o_orderkey") % 5 != 0), o.where(F.col("o_orderkey") % 5 == 0)


@query("V1_integrity", f"""
SELECT false AS status, (SELECT count(*) FROM ({TRAIN_SQL})) AS train_rows, CAST(6 AS INTEGER) AS train_columns,
  (SELECT count(*) FROM ({TEST_SQL})) AS test_rows, CAST(5 AS INTEGER) AS test_columns,
  'o_orderpriority' AS column_mismatch""")
def v1_integrity(spark, sf):
    train, test = _sides(spark, sf)
    return validate.integrity(train, test.drop("o_orderpriority"))[1]


EXPECTED = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
            "o_orderdate": "date", "o_comment": "string"}
_TYPE_MAP = ("CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' "
             "WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' "
             "THEN 'timestamp' ELSE lower(data_type) END")


@query("V2_schema", f"""
WITH e(column_name, expected_type) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in EXPECTED.items())}),
s AS (SELECT column_name, {_TYPE_MAP} AS t FROM information_schema.columns WHERE table_name = 'orders'),
tr AS (SELECT column_name, t AS train_type FROM s),
te AS (SELECT column_name, t AS test_type FROM s WHERE column_name <> 'o_orderpriority')
SELECT column_name, expected_type, train_type, test_type,
  CASE WHEN expected_type IS NOT NULL AND train_type IS NULL AND test_type IS NULL THEN 'missing'
       WHEN expected_type IS NULL THEN 'unexpected'
       WHEN train_type IS NULL OR test_type IS NULL THEN 'ok'
       WHEN train_type <> expected_type OR test_type <> expected_type THEN 'type_mismatch'
       ELSE 'ok' END AS state
FROM e FULL OUTER JOIN tr USING (column_name) FULL OUTER JOIN te USING (column_name)""")
def v2_schema(spark, sf):
    train, test = _sides(spark, sf)
    return validate.schema_check(train, test.drop("o_orderpriority"), EXPECTED)[1]


LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _v3_sql():
    src = f"({LINEITEM_WITH_NULLS_SQL})"
    parts = []
    for i, c in enumerate(LI_COLS):
        rate = f"round_even(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE, 4)"
        parts.append(f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name,
  (SELECT {rate} FROM {src} WHERE l_orderkey % 5 <> 0) AS train_missing,
  (SELECT {rate} FROM {src} WHERE l_orderkey % 5 = 0) AS test_missing""")
    inner = "\nUNION ALL\n".join(parts)
    return f"SELECT *, (train_missing > 0.1 OR coalesce(test_missing > 0.1, false)) AS flagged FROM ({inner})"


@query("V3_missing_rates", _v3_sql())
def v3_missing_rates(spark, sf):
    li = lineitem_with_nulls(spark, sf).select(*LI_COLS)
    train, test = li.where(F.col("l_orderkey") % 5 != 0), li.where(F.col("l_orderkey") % 5 == 0)
    return validate.missing_rates(train, test, threshold=0.1)[1]


@query("V4_target", sql_rounded(f"""
WITH d AS (
  SELECT 'train' AS side, CAST(o_orderpriority AS VARCHAR) AS class, count(*) AS count,
    CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM ({TRAIN_SQL})) AS raw_share
  FROM ({TRAIN_SQL}) GROUP BY o_orderpriority
  UNION ALL
  SELECT 'test', CAST(o_orderpriority AS VARCHAR), count(*),
    CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM ({TEST_SQL}))
  FROM ({TEST_SQL}) GROUP BY o_orderpriority),
s AS (SELECT side, count(class) AS n_unique, max(raw_share) AS majority_share FROM d GROUP BY side)
SELECT d.side, d.class, d.count, round_even(d.raw_share, 4) AS share, s.n_unique, s.majority_share,
  s.majority_share > 0.9 AS imbalanced
FROM d JOIN s USING (side)""", ["majority_share"]))
def v4_target(spark, sf):
    train, test = _sides(spark, sf)
    return rounded(validate.target_check(train, test, "o_orderpriority")[1])


DRIFT_COLS = ["o_orderkey", "o_custkey", "o_totalprice"]


def _v5_inner(threshold):
    parts = []
    for i, c in enumerate(DRIFT_COLS):
        parts.append(f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name,
  (SELECT coalesce(avg(CAST({c} AS DOUBLE)), 0.0) FROM ({TRAIN_SQL})) AS train_mean,
  (SELECT coalesce(avg(CAST({c} AS DOUBLE)), 0.0) FROM ({TEST_SQL})) AS test_mean,
  (SELECT CASE WHEN count({c}) = 0 THEN 0.0 ELSE stddev_samp(CAST({c} AS DOUBLE)) END FROM ({TRAIN_SQL})) AS train_std,
  (SELECT CASE WHEN count({c}) = 0 THEN 0.0 ELSE stddev_samp(CAST({c} AS DOUBLE)) END FROM ({TEST_SQL})) AS test_std""")
    inner = "\nUNION ALL\n".join(parts)
    score = ("greatest(abs(train_mean - test_mean) / greatest(abs(train_mean), abs(train_std), 1.0), "
             "abs(train_std - test_std) / greatest(abs(test_mean), abs(test_std), 1.0))")
    return f"SELECT *, {score} AS drift_score, {score} > {threshold} AS drift_detected FROM ({inner})"


@query("V5_drift", sql_rounded(_v5_inner(0.2), ["train_mean", "test_mean", "train_std", "test_std", "drift_score"]))
def v5_drift(spark, sf):
    train, test = _sides(spark, sf)
    return rounded(validate.drift(train, test, target="o_orderpriority", threshold=0.2)[1])


@query("V6_overall_status", f"""
WITH d AS ({_v5_inner(0.2)})
SELECT * FROM (VALUES ('data_integrity', true), ('schema_validation', true), ('missing_values', true),
  ('target_column', true)) AS t(check_name, status)
UNION ALL SELECT 'data_drift', NOT bool_or(drift_detected) FROM d
UNION ALL SELECT 'overall', NOT bool_or(drift_detected) FROM d""")
def v6_overall_status(spark, sf):
    train, test = _sides(spark, sf)
    rep = validate.validate(train, test, "o_orderpriority", expected_schema=None)
    return rep.status_frame(spark)


# ---------------------------------------------------------------- R1-R4

@query("R1_dedup_documents", "SELECT DISTINCT text, lang FROM documents")
def r1_dedup_documents(spark, sf):
    return split.deduplicate(table(spark, sf, "documents").select("text", "lang"))


@query("R1_dedup_lineitem_flags", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def r1_dedup_lineitem_flags(spark, sf):
    return split.deduplicate(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus"))


@query("R2_random_split_sizes", """
SELECT 'test' AS split, CAST(ceil(count(*) * 0.2) AS BIGINT) AS n, sum(l_quantity) IS NOT NULL AS covered FROM lineitem
UNION ALL
SELECT 'train', count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT), true FROM lineitem""")
def r2_random_split_sizes(spark, sf):
    train, test = split.random_split(table(spark, sf, "lineitem"), 0.2)
    return (test.agg(F.lit("test").alias("split"), F.count(F.lit(1)).alias("n"))
            .unionByName(train.agg(F.lit("train").alias("split"), F.count(F.lit(1)).alias("n")))
            .withColumn("covered", F.lit(True)))


@query("R3_stratified_split_sizes", """
WITH c AS (SELECT l_returnflag AS class, count(*) AS k FROM lineitem GROUP BY l_returnflag),
t AS (SELECT sum(k) AS n, CAST(ceil(sum(k) * 0.2) AS BIGINT) AS nt FROM c),
b AS (SELECT class, k, (nt * k) // n AS base, (nt * k) % n AS rem, nt FROM c, t),
r AS (SELECT *, row_number() OVER (ORDER BY rem DESC, class) AS rk,
        nt - sum(base) OVER () AS leftover FROM b)
SELECT class, 'test' AS split, CAST(base + CASE WHEN rk <= leftover THEN 1 ELSE 0 END AS BIGINT) AS n FROM r
UNION ALL
SELECT class, 'train', CAST(k - base - CASE WHEN rk <= leftover THEN 1 ELSE 0 END AS BIGINT) FROM r""")
def r3_stratified_split_sizes(spark, sf):
    train, test = split.stratified_split(table(spark, sf, "lineitem"), "l_returnflag", 0.2)
    g = lambda df, name: df.groupBy(F.col("l_returnflag").alias("class")).agg(
        F.count(F.lit(1)).alias("n")).select("class", F.lit(name).alias("split"), "n")
    return g(test, "test").unionByName(g(train, "train"))


@query("R4_fold_sizes", """
WITH n AS (SELECT count(*) AS n FROM lineitem)
SELECT CAST(f AS INTEGER) AS fold, CAST(n // 3 + CASE WHEN f < n % 3 THEN 1 ELSE 0 END AS BIGINT) AS n
FROM n, range(3) AS r(f)""")
def r4_fold_sizes(spark, sf):
    folds = split.assign_folds(table(spark, sf, "lineitem"), k=3)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("R4_folds_repeated", """
WITH n AS (SELECT count(*) AS n FROM lineitem)
SELECT CAST(f AS INTEGER) AS fold, CAST(n // 3 + CASE WHEN f < n % 3 THEN 1 ELSE 0 END AS BIGINT) AS n
FROM n, range(3) AS r(f)""")
def r4_folds_repeated(spark, sf):
    """Folds of rows that repeat thousands of times: two flags of every line item."""
    flags = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    return split.assign_folds(flags, k=3).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("R4_folds_null_strata", """
WITH c AS (SELECT nullif(l_returnflag, 'A') AS stratum, count(*) AS k FROM lineitem GROUP BY 1)
SELECT stratum, CAST(f AS INTEGER) AS fold, CAST(k // 3 + CASE WHEN f < k % 3 THEN 1 ELSE 0 END AS BIGINT) AS n
FROM c, range(3) AS r(f)""")
def r4_folds_null_strata(spark, sf):
    li = table(spark, sf, "lineitem").select(F.nullif("l_returnflag", F.lit("A")).alias("stratum"), "l_quantity")
    folds = split.assign_folds(li, k=3, strata=["stratum"])
    return folds.groupBy("stratum", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("R2_split_disjoint", """
SELECT count(*) AS n_keys, CAST(ceil(count(*) * 0.2) AS BIGINT) AS n_test, CAST(0 AS BIGINT) AS n_shared FROM orders""")
def r2_split_disjoint(spark, sf):
    train, test = split.random_split(table(spark, sf, "orders"), 0.2)
    sides = train.select("o_orderkey", F.lit(0).alias("t")).unionByName(test.select("o_orderkey", F.lit(1).alias("t")))
    per = sides.groupBy("o_orderkey").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return per.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("b") == 1).alias("n_test"),
                   F.count_if(F.col("a") < F.col("b")).alias("n_shared"))
