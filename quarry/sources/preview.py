"""Previews (S6, S7).

Spark rows have no position, so a preview takes an explicit ordering key.
``orderBy(key).limit(n)`` plans as ``TakeOrderedAndProject``: each task keeps
its n best rows and only those reach the final merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import types as qt
from quarry.functions.exprs import qcol


def _order(df: DataFrame, key):
    keys = [key] if isinstance(key, str) else list(key or df.columns)
    return [qcol(k).asc_nulls_first() for k in keys]


def preview_rows(df: DataFrame, key=None, n: int = 8) -> DataFrame:
    """S6 sample rows: first ``n`` rows by key, every value as text, NULL as ''."""
    return df.orderBy(*_order(df, key)).limit(n).select(
        *[F.coalesce(qcol(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def preview_summary(df: DataFrame) -> dict:
    """S6 header: row count, names, numeric and categorical lists."""
    return {
        "rows": df.count(),
        "column_names": list(df.columns),
        "numeric_columns": qt.prep_numeric(df),
        "categorical_columns": qt.prep_categorical(df),
    }


def data_preview(df: DataFrame, key=None, n: int = 100) -> DataFrame:
    """First ``n`` rows by key with the total row count on each row."""
    total = df.count()
    return df.orderBy(*_order(df, key)).limit(n).withColumn("total_rows", F.lit(total).cast("long"))


def dtypes_table(df: DataFrame) -> DataFrame:
    """Column name, position and Spark type, as a frame."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column string, dtype string")
