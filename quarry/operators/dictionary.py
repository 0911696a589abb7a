"""Dictionary encoding (F6, F7): categories as a table, codes by a join.

A column's categories are its distinct non-NULL values in train, as text; the
code of one is its place in sorted order. The table is built without a global
sort in one task: distinct values are dealt by ranges of (column, value), each
range numbers its own values, and a running sum of the ranges' sizes, one row a
range, gives where each begins. Nothing but a column's number of categories
reaches the driver, so ten categories and a hundred million take the same path.
Encoding joins the table; Spark sends it to the rows if it is under the
planner's byte threshold and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.exprs import qcol
from quarry.operators.profile import long_values
from quarry.session import scratch_dir


def category_table(train: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, code): the sorted distinct non-NULL values of each column, numbered from 0 (long).

    Values of any type count as their text (booleans, numbers, timestamps too). The table is written once to the
    scratch folder and read from there."""
    spark = train.sparkSession
    schema = "column_name string, value string, code long"
    if not cols:
        return spark.createDataFrame([], schema)
    values = long_values(train, cols, lambda c: qcol(c).cast("string")).where(F.col("x").isNotNull())
    dealt = values.select("column_name", F.col("x").alias("value")).distinct().repartitionByRange("column_name", "value")
    path = scratch_dir(spark, "category-ranges")
    dealt.withColumn("range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema("column_name string, value string, range int").parquet(path)
    sizes = dealt.groupBy("column_name", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("column_name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("column_name", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    place = F.row_number().over(Window.partitionBy("column_name", "range").orderBy("value")) - 1
    coded = dealt.withColumn("place", place).join(begins, ["column_name", "range"])
    path = scratch_dir(spark, "categories")
    coded.select("column_name", "value", (F.col("begin") + F.col("place")).cast("long").alias("code")).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def sizes(table: DataFrame) -> dict:
    """Number of categories of each column that has any."""
    return {r["column_name"]: r["n"] for r in table.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}


def encode(df: DataFrame, table: DataFrame, columns: dict, unseen: dict | float) -> DataFrame:
    """``df`` with the code (double) of each column ``c`` as ``columns[c][1]``, read from its column ``columns[c][0]``.

    Unseen values and NULL get ``unseen``, of the column or of all."""
    out = df
    for i, (c, (source, target)) in enumerate(columns.items()):
        codes = table.where(F.col("column_name") == F.lit(c)).select(
            F.col("value").alias(f"__value{i}"), F.col("code").cast("double").alias(f"__code{i}"))
        other = float(unseen[c] if isinstance(unseen, dict) else unseen)
        out = out.join(codes, qcol(source).cast("string") == F.col(f"__value{i}"), "left").drop(f"__value{i}")
        if target in out.columns:
            out = out.withColumn(target, F.coalesce(F.col(f"__code{i}"), F.lit(other))).drop(f"__code{i}")
        else:
            out = out.withColumn(f"__code{i}", F.coalesce(F.col(f"__code{i}"), F.lit(other))).withColumnRenamed(f"__code{i}", target)
    return out
