"""Loading the driver tables and small helpers shared by the query catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.readers import normalize_missing

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

ROUND = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, NaN normalised to NULL."""
    return normalize_missing(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def rounded(df: DataFrame, digits: int = ROUND) -> DataFrame:
    """Round every floating column so engines agree on the last bits."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def sql_rounded(inner: str, float_cols, digits: int = ROUND) -> str:
    """DuckDB twin of ``rounded``: ``SELECT * REPLACE (round(c, 6) AS c ...)``."""
    cols = list(float_cols)
    if not cols:
        return inner
    rep = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({inner}) AS q"


# Column sets of the fixture tables used by several queries.
LINEITEM_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax")


def lineitem_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with NULLs made the same way in both engines: nullif(tax, 0), nullif(discount, 0)."""
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("l_tax", F.nullif(F.col("l_tax"), F.lit(0.0))).withColumn(
        "l_discount", F.nullif(F.col("l_discount"), F.lit(0.0)))


LINEITEM_WITH_NULLS_SQL = ("SELECT * REPLACE (nullif(l_tax, 0) AS l_tax, nullif(l_discount, 0) AS l_discount) "
                           "FROM lineitem")
