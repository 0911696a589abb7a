"""Table loaders (S1, S2) and sinks.

The CSV reader reads every column as text, turns the missing-value tokens into
NULL, then casts. Type inference is one distributed ``agg`` that checks, per
column, whether every present value casts to long, double or boolean, so no
sample or driver pass is involved.
"""

from __future__ import annotations


from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.exprs import nan_to_null, qcol

# Text tokens read as missing (the pandas ``read_csv`` default list).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


# What counts as integer and as floating-point text during inference.
INT_TEXT = r"^\s*[+-]?[0-9]+\s*$"
FLOAT_TEXT = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


class EmptyDataError(ValueError):
    pass


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in floating columns, once, at entry."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            exprs.append(nan_to_null(qcol(f.name)).cast(f.dataType).alias(f.name))
        else:
            exprs.append(qcol(f.name))
    return df.select(*exprs)


def _infer_casts(raw: DataFrame) -> dict[str, str]:
    """One pass: the narrowest of long / double / boolean / string per column.

    A cast is only attempted on text that looks numeric, so the pass never
    goes through the cast's failure path (an exception per value).
    """
    checks = []
    names = raw.columns
    for i, c in enumerate(names):
        x = qcol(c)
        present = x.isNotNull()
        as_long = F.when(x.rlike(INT_TEXT), F.trim(x).try_cast("long"))
        as_double = F.when(x.rlike(FLOAT_TEXT), F.trim(x).try_cast("double"))
        checks += [
            F.count_if(present & as_long.isNull()).alias(f"l{i}"),
            F.count_if(present & as_double.isNull()).alias(f"d{i}"),
            F.count_if(present & ~F.lower(x).isin("true", "false")).alias(f"b{i}"),
            F.count(x).alias(f"n{i}"),
        ]
    row = raw.agg(*checks).collect()[0]
    out = {}
    for i, c in enumerate(names):
        if row[f"n{i}"] == 0:
            out[c] = "double"          # an all-missing column reads as float in pandas
        elif row[f"b{i}"] == 0:
            out[c] = "boolean"
        elif row[f"l{i}"] == 0:
            out[c] = "long"
        elif row[f"d{i}"] == 0:
            out[c] = "double"
        else:
            out[c] = "string"
    return out


# How text is quoted, for the reader and the writer alike.
CSV_TEXT = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
            "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, schema: dict[str, str] | T.StructType | None = None,
             na_tokens=NA_TOKENS, multi_line: bool = True) -> DataFrame:
    """CSV with a header row; missing tokens become NULL; types inferred or given.

    Quoted fields may hold doubled quotes, commas and, with ``multi_line``, line
    breaks; such a file is read by one task, so large inputs come as many files
    or, without breaks in fields, with ``multi_line=False``. A record that does
    not fit the header fails the read. Paths are resolved by Spark alone.
    """
    if not path:
        raise ValueError("no path was given")
    reader = spark.read.options(**CSV_TEXT, multiLine=multi_line)
    try:
        names = reader.csv(path).columns
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no CSV input at {path}") from None
        raise
    fixed = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = reader.option("mode", "FAILFAST").schema(fixed).csv(path)
    tokens = list(na_tokens)
    raw = raw.select(*[
        F.when(F.trim(qcol(c)).isin(tokens) | qcol(c).isNull(), F.lit(None).cast("string")).otherwise(qcol(c)).alias(c)
        for c in raw.columns])
    if isinstance(schema, T.StructType):
        casts = {f.name: f.dataType.simpleString() for f in schema.fields}
    elif schema:
        casts = dict(schema)
    else:
        casts = _infer_casts(raw)
    out = raw.select(*[(F.trim(qcol(c)) if casts.get(c, "string") in ("long", "double", "boolean") else qcol(c))
                       .cast(casts.get(c, "string")).alias(c) for c in raw.columns])
    return normalize_missing(out)


def from_frame(spark: SparkSession, data) -> DataFrame:
    """An existing Spark DataFrame or a pandas frame, NaN normalised."""
    if isinstance(data, DataFrame):
        df = data
    else:
        df = spark.createDataFrame(data)
    return normalize_missing(df)


def read_table(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Parquet, ORC, JSON or CSV by extension; parquet is the default storage."""
    lower = path.lower().rstrip("/")
    if lower.endswith(".csv"):
        return read_csv(spark, path, **kw)
    if lower.endswith(".json"):
        return normalize_missing(spark.read.json(path))
    if lower.endswith(".orc"):
        return normalize_missing(spark.read.orc(path))
    return normalize_missing(spark.read.parquet(path))


def require_rows(df: DataFrame, name: str = "Dataset") -> DataFrame:
    """Empty input raises (the reference rejects empty files)."""
    if not df.columns:
        raise EmptyDataError(f"{name} has no columns")
    if not df.take(1):
        raise EmptyDataError(f"{name} is empty")
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """S3: parquet by default; CSV with a header row when asked."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.options(**CSV_TEXT).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)
    return path


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A flat report frame as JSON lines."""
    df.write.mode(mode).json(path)
    return path


def read_report(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)
