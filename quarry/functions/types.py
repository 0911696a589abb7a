"""Column type classes.

Four overlapping classes are in use, and they differ on booleans:

* ``eda_numeric``      numeric types, booleans excluded (profiling)
* ``eda_categorical``  string columns only; booleans and dates are in neither
* ``prep_categorical`` every column that is not numeric (preparation, preview)
* ``drift_numeric``    numeric types and booleans (drift check)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def eda_numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if _is_numeric(f.dataType)]


def eda_categorical(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def prep_numeric(df: DataFrame) -> list[str]:
    return eda_numeric(df)


def prep_categorical(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not _is_numeric(f.dataType)]


def drift_numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if _is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType)]


def type_name(dt: T.DataType) -> str:
    return dt.simpleString()


def column_kinds(df: DataFrame):
    """(column, spark_type, eda_kind, prep_kind) for every column, in order."""
    num = set(eda_numeric(df))
    cat = set(eda_categorical(df))
    rows = []
    for position, f in enumerate(df.schema.fields):
        eda_kind = "numeric" if f.name in num else ("categorical" if f.name in cat else "other")
        prep_kind = "numerical" if f.name in num else "categorical"
        rows.append((position, f.name, type_name(f.dataType), eda_kind, prep_kind))
    return rows
