"""Profiling aggregates.

Every operator builds one list of aggregate expressions over all columns and
runs a single ``agg`` (one scan, partial aggregation on the map side), then
unpivots the one-row result to one row per column. Quartiles use the exact
grouped quantiles of ``quarry.functions.quantiles``.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import types as qt
from quarry.functions.exprs import kurtosis, nan_to_null, pct, qcol, skewness
from quarry.functions.quantiles import quantile_table
from quarry.session import scratch_dir

# Thresholds, labels and messages of the insight and
# recommendation rules.
SKEW_THRESHOLD = 0.5
SKEW_HIGH = 1.0
STRONG_CORR = 0.7
RECOMMEND_CORR = 0.85
RECOMMEND_CORR_TOP = 5
OUTLIER_RECOMMEND_PCT = 5.0
NEAR_CONSTANT_PCT = 1.0
# Error of distinct-value estimates, and how far above the line an estimate rules a column out.
ESTIMATE_ERROR, CLEARLY = 0.05, 2.0
TOP_VALUES = 10
PRIORITY_ORDER = ("high", "medium", "low")
MSG_SKEW_ISSUE = "Skewed distribution (%s skew: %s)"      # direction, skewness with 2 decimals
MSG_LOG = "Log transform"
MSG_BOXCOX = "Box-Cox transform"
MSG_SKEW_REASON = "Can improve model performance by normalizing distribution"
MSG_OUTLIER_ISSUE = "Outliers detected (%s%%)"             # percentage with 1 decimal
MSG_OUTLIER_REC = "Consider robust scaling or outlier removal"
MSG_OUTLIER_REASON = "Outliers can negatively impact model training"
MSG_CONST_ISSUE = "Constant or near-constant feature"
MSG_CONST_REC = "Remove this feature"
MSG_CONST_REASON = "Non-informative features don't contribute to predictions"
MSG_CORR_ISSUE = "High correlation (%s)"                   # correlation with 2 decimals
MSG_CORR_REC = "Consider removing one or using dimensionality reduction"
MSG_CORR_REASON = "Multicollinearity can reduce model interpretability"



def _unpivot_structs(agg: DataFrame, structs: list[Column]) -> DataFrame:
    return agg.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


# ---------------------------------------------------------------- A1, A2

def overview(df: DataFrame) -> DataFrame:
    """A1: rows, columns, duplicate rows (whole-row, NULLs equal) and percent.

    Rows are grouped on all columns with map-side combine, so repeated rows
    collapse before the shuffle; the percent is NULL on an empty frame.
    """
    counts = df.groupBy(*[qcol(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__c"))
    totals = counts.agg(F.coalesce(F.sum("__c"), F.lit(0)).cast("long").alias("n_rows"),
                        F.count(F.lit(1)).cast("long").alias("n_distinct"))
    return totals.select(
        "n_rows",
        F.lit(len(df.columns)).cast("int").alias("n_columns"),
        (F.col("n_rows") - F.col("n_distinct")).alias("duplicates"),
        pct(F.col("n_rows") - F.col("n_distinct"), "n_rows").alias("duplicate_pct"),
    )


def _num(c):
    """A column as double with NaN treated as missing (loaders already do this; frames passed in
    directly may not have)."""
    return nan_to_null(qcol(c).cast("double"))


def long_values(df: DataFrame, cols: list[str], value=_num) -> DataFrame:
    """Unpivot to ``(position, column_name, x)``.

    Per-column statistics are then one ``groupBy(position)`` with a few
    aggregate buffers, which stays inside whole-stage codegen however many
    columns there are (a wide one-row ``agg`` over hundreds of buffer fields
    exceeds ``spark.sql.codegen.maxFields`` and runs interpreted). Partial
    aggregation leaves k rows per map task, so the shuffle is tiny.
    """
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), value(c).alias("x"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")


def missing_values(df: DataFrame) -> DataFrame:
    """A2: NULL count and percent of all rows, only columns with at least one."""
    cols = df.columns
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    long = long_values(df, cols, lambda c: (qcol(c).isNull() | F.isnan(qcol(c))) if c in floating
                       else qcol(c).isNull())
    agg = long.groupBy("position", "column_name").agg(
        F.count_if(F.col("x")).cast("long").alias("missing_count"), F.count(F.lit(1)).alias("__n"))
    return agg.select("position", "column_name", "missing_count",
                      pct(F.col("missing_count"), F.col("__n")).alias("missing_pct")).where(F.col("missing_count") > 0)


# ---------------------------------------------------------------- A3, A6, A7

def moments(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, max, population skewness and excess kurtosis.

    One scan for any number of columns: values go into the long form
    ``(position, x)`` and are aggregated by position, partially in each task.
    """
    cols = qt.eda_numeric(df) if cols is None else cols
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], _MOMENT_SCHEMA)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("position"), _num(c).cast("double").alias("x"))
                                         for i, c in enumerate(cols)])).alias("s")).select("s.*")
    x = F.col("x")
    found = long.groupBy("position").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
        F.max(x).alias("max"), skewness(x).alias("skewness"), kurtosis(x).alias("kurtosis"))
    names = spark.createDataFrame(list(enumerate(cols)), "position int, column_name string")
    return names.join(found, "position", "left").select(
        "position", "column_name", F.coalesce("n", F.lit(0)).cast("long").alias("count"), "mean", "std", "min", "max",
        "skewness", "kurtosis")


_MOMENT_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()), T.StructField("column_name", T.StringType()),
    T.StructField("count", T.LongType()), T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()), T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()), T.StructField("skewness", T.DoubleType()),
    T.StructField("kurtosis", T.DoubleType())])

_QUART_SCHEMA = T.StructType([T.StructField("column_name", T.StringType()), T.StructField("q25", T.DoubleType()),
                              T.StructField("median", T.DoubleType()), T.StructField("q75", T.DoubleType())])


def quartiles(df: DataFrame, cols: list[str] | None = None, method: str = "exact") -> DataFrame:
    """Q1, median, Q3 per column (linear interpolation), exact by default."""
    cols = qt.eda_numeric(df) if cols is None else cols
    rows = [(r["column"], *r["q"]) for r in quantile_table(df, cols, [0.25, 0.5, 0.75], method=method)]
    return df.sparkSession.createDataFrame(rows, _QUART_SCHEMA)


def numeric_summary(df: DataFrame, cols: list[str] | None = None, method: str = "exact") -> DataFrame:
    """A3: per numeric column with at least one value."""
    cols = qt.eda_numeric(df) if cols is None else cols
    m_rows = moments(df, cols).collect()
    q = {r[0]: r[1:] for r in quartiles(df, cols, method).collect()}
    out = []
    for r in sorted(m_rows, key=lambda x: x["position"]):
        if r["count"] == 0:
            continue
        q25, med, q75 = q.get(r["column_name"], (None, None, None))
        out.append((r["position"], r["column_name"], r["count"], r["mean"], med, r["std"], r["min"], q25, q75,
                    r["max"], r["skewness"], r["kurtosis"]))
    return df.sparkSession.createDataFrame(
        out, "position int, column_name string, count long, mean double, median double, std double, min double, "
             "q25 double, q75 double, max double, skewness double, kurtosis double")


def outliers(df: DataFrame, cols: list[str] | None = None, method: str = "exact",
             precomputed: dict | None = None) -> DataFrame:
    """IQR rule; strictly outside [Q1-1.5 IQR, Q3+1.5 IQR]; percent of non-null rows."""
    cols = qt.eda_numeric(df) if cols is None else cols
    qrows = precomputed if precomputed is not None else {
        r["column"]: r["q"] for r in quantile_table(df, cols, [0.25, 0.75], method=method)}
    if not qrows:
        return df.sparkSession.createDataFrame(
            [], "position int, column_name string, count long, percentage double, lower_bound double, "
                "upper_bound double")
    bounds = []
    for c in cols:
        q1, q3 = qrows.get(c, (None, None))
        if q1 is None:
            bounds.append((None, None))
        else:
            bounds.append((q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
    lo_arr = F.array(*[F.lit(b[0]).cast("double") for b in bounds])
    hi_arr = F.array(*[F.lit(b[1]).cast("double") for b in bounds])
    long = long_values(df, cols).select(
        "position", "column_name", "x",
        F.element_at(lo_arr, F.col("position") + 1).alias("lo"), F.element_at(hi_arr, F.col("position") + 1).alias("hi"))
    x = F.col("x")
    agg = long.groupBy("position", "column_name", "lo", "hi").agg(
        F.count_if((x < F.col("lo")) | (x > F.col("hi"))).cast("long").alias("count"), F.count(x).alias("__n"))
    return agg.where(F.col("count") > 0).select(
        "position", "column_name", "count", pct(F.col("count"), F.col("__n")).alias("percentage"),
        F.col("lo").alias("lower_bound"), F.col("hi").alias("upper_bound"))


def outlier_filter(df: DataFrame, column: str, method: str = "exact") -> DataFrame:
    """Rows strictly outside the IQR bounds of ``column``."""
    q = quantile_table(df, [column], [0.25, 0.75], method=method)
    if not q:
        return df.limit(0)
    q1, q3 = q[0]["q"]
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    x = qcol(column).cast("double")
    return df.where((x < F.lit(lo)) | (x > F.lit(hi)))


def skewed_columns(df: DataFrame, cols: list[str] | None = None, threshold: float = SKEW_THRESHOLD) -> DataFrame:
    """More than 2 values and |skew| > threshold."""
    m = moments(df, cols)
    sk = F.col("skewness")
    return m.where((F.col("count") > 2) & (F.abs(sk) > F.lit(threshold))).select(
        "position", "column_name", "skewness",
        F.when(sk > 0, "right").otherwise("left").alias("direction"),
        F.when(F.abs(sk) < F.lit(SKEW_HIGH), "moderate").otherwise("high").alias("severity"))


# ---------------------------------------------------------------- A5, A8, A18

def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A5: Pearson with pairwise deletion; all ordered pairs including the diagonal.

    Needs at least two numeric columns (otherwise an empty frame). Two scans for
    any number of columns: one takes the means, the other the Gramian of the rows
    ``[m, m x, m x^2]`` with x shifted by its mean and m = 1 where it is present.
    Its entries are, for every pair, the count, the sums, the sums of squares and
    the product over the rows where both are present. r is NULL when either side
    is constant over the shared rows.
    """
    cols = qt.eda_numeric(df) if cols is None else list(cols)
    spark = df.sparkSession
    schema = "i int, j int, feature_1 string, feature_2 string, correlation double"
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    k = len(cols)
    means = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(_num(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    if not means["n"]:
        return spark.createDataFrame([(i, j, cols[i], cols[j], None) for i in range(k) for j in range(k)], schema)
    present = [F.when(_num(c).isNotNull(), 1.0).otherwise(0.0) for c in cols]
    x = [F.coalesce(_num(c).cast("double") - F.lit(float(means[f"m{i}"] or 0.0)), F.lit(0.0)) for i, c in enumerate(cols)]
    rows = df.select(array_to_vector(F.array(*present, *x, *[v * v for v in x])).alias("v"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v")).computeGramianMatrix().toArray()
    n, total = gram[:k, :k], gram[k:2 * k, :k]
    squares, product = gram[2 * k:, :k], gram[k:2 * k, k:2 * k]
    out = []
    for i in range(k):
        for j in range(k):
            corr = None
            if n[i, j]:
                sa, sb = total[i, j] / n[i, j], total[j, i] / n[i, j]
                va, vb = squares[i, j] / n[i, j] - sa * sa, squares[j, i] / n[i, j] - sb * sb
                if va > 0 and vb > 0:
                    corr = float((product[i, j] / n[i, j] - sa * sb) / (va ** 0.5 * vb ** 0.5))
            out.append((i, j, cols[i], cols[j], corr))
    return spark.createDataFrame(out, schema)


def strong_correlations(df: DataFrame, cols: list[str] | None = None, threshold: float = STRONG_CORR) -> DataFrame:
    """Upper-triangle pairs with |r| >= threshold, by |r| descending (stable)."""
    m = correlation_matrix(df, cols)
    r = F.col("correlation")
    return (m.where((F.col("i") < F.col("j")) & (F.abs(r) >= F.lit(threshold)))
            .select("i", "j", "feature_1", "feature_2", "correlation",
                    F.when(r > 0, "positive").otherwise("negative").alias("relationship"),
                    F.row_number().over(_abs_corr_window()).alias("rank")))


def _abs_corr_window():
    from pyspark.sql import Window
    # the frame is tiny (k^2 rows), a single ordered window is fine here
    return Window.orderBy(F.abs(F.col("correlation")).desc(), F.col("i"), F.col("j"))


def heatmap(df: DataFrame, columns: list[str]) -> DataFrame:
    """A5 over chosen columns; unknown or non-numeric names are dropped."""
    numeric = set(qt.eda_numeric(df))
    keep = [c for c in columns if c in numeric]
    if len(keep) < 2:
        raise ValueError(f"a heatmap of {len(keep)} numeric columns has no pairs")
    return correlation_matrix(df, keep)


# ---------------------------------------------------------------- A4, A9, A13, A20

def categorical_summary(df: DataFrame, cols: list[str] | None = None, top: int = TOP_VALUES) -> DataFrame:
    """A4: distinct non-null count and top values with count and percent of all rows.

    Values are unpivoted to ``(column, value)`` and counted with map-side
    combine; ``row_number() <= top`` is planned as a partial
    ``WindowGroupLimit`` before the shuffle, so no task sees more than ``top``
    rows per column and map partition. Ties order by value.
    """
    from pyspark.sql import Window
    cols = qt.eda_categorical(df) if cols is None else cols
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "position int, column_name string, unique_count long, rank int, value string, "
                                         "count long, pct double")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), qcol(c).cast("string").alias("value"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")
    # one counting subplan (NULL values kept as their own group) feeds both the
    # top values and the distinct count / row total, so the shuffle is reused
    counts = long.groupBy("position", "column_name", "value").agg(F.count(F.lit(1)).alias("count"))
    # the NULL group sorts after every value and is dropped after the window, so
    # the counting subplan stays identical in both branches
    w = Window.partitionBy("position").orderBy(F.col("value").isNull(), F.col("count").desc(), F.col("value"))
    top_rows = (counts.withColumn("rank", F.row_number().over(w))
                .where((F.col("rank") <= top) & F.col("value").isNotNull()))
    per_col = counts.groupBy("position").agg(F.count("value").alias("unique_count"),
                                             F.sum("count").alias("__rows"))
    return top_rows.join(per_col, "position").select(
        "position", "column_name", "unique_count", "rank", "value", "count",
        pct(F.col("count"), F.col("__rows")).alias("pct"))


def constant_columns(df: DataFrame, near_pct: float = NEAR_CONSTANT_PCT, method: str = "exact") -> DataFrame:
    """Distinct <= 1 is constant; distinct / rows < 1% is near-constant; all types.

    One scan estimates every column's distinct values (HyperLogLog++). Only
    columns whose estimate is not far above the line, CLEARLY times, are counted
    exactly, so columns of many values are never shuffled; that margin is over
    20 standard errors of the estimate. ``method="approx"`` reports the estimates.
    """
    cols = df.columns
    n = F.count(F.lit(1))
    estimate = [F.approx_count_distinct(qcol(c), ESTIMATE_ERROR) for c in cols]
    if method != "approx":
        seen = df.agg(n.alias("n"), *[e.alias(f"d{i}") for i, e in enumerate(estimate)]).first()
        line = max(1.0, near_pct / 100 * seen["n"])
        near = [i for i in range(len(cols)) if seen[f"d{i}"] <= CLEARLY * line]
    else:
        near = list(range(len(cols)))
    if not near:
        return df.sparkSession.createDataFrame([], "position int, column_name string, type string, unique_values long, "
                                                   "unique_percentage double")
    if method == "approx":
        agg = df.agg(n.alias("__n"), *[estimate[i].alias(f"d{i}") for i in near])
        u = _unpivot_structs(agg, [F.struct(F.lit(i).alias("position"), F.lit(cols[i]).alias("column_name"),
                                            F.col(f"d{i}").cast("long").alias("unique_values"),
                                            pct(F.col(f"d{i}"), F.col("__n")).alias("unique_pct")) for i in near])
    else:
        # few distinct values each: (column, value) collapses on the map side; + 0.0 makes -0.0 and 0.0 one
        def text(c):
            kind = df.schema[c].dataType.typeName()
            return (qcol(c) + F.lit(0.0).cast(kind) if kind in ("double", "float") else qcol(c)).cast("string")
        long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(cols[i]).alias("column_name"),
                                                      text(cols[i]).alias("value")) for i in near])).alias("s")).select("s.*")
        found = long.distinct().groupBy("position").agg(F.count("value").alias("found"))
        names = df.sparkSession.createDataFrame([(i, cols[i]) for i in near], "position int, column_name string")
        u = names.join(found, "position", "left").select(
            "position", "column_name", F.coalesce("found", F.lit(0)).cast("long").alias("unique_values")).withColumn(
            "unique_pct", pct(F.col("unique_values"), F.lit(seen["n"])))
    kind = (F.when(F.col("unique_values") <= 1, "constant")
            .when(F.col("unique_pct") < F.lit(near_pct), "near_constant"))
    return u.select("position", "column_name", kind.alias("type"), "unique_values",
                    F.when(F.col("unique_values") > 1, F.col("unique_pct")).alias("unique_percentage")
                    ).where(F.col("type").isNotNull())


def plot_field_summary(df: DataFrame, field: str, n_values: int = 20) -> DataFrame:
    """Numeric field gives min, max, mean; otherwise the first 20 distinct values."""
    schema = "field string, field_type string, min double, max double, mean double, rank int, value string"
    if field in qt.eda_numeric(df):
        x = qcol(field).cast("double")
        return df.agg(F.lit(field).alias("field"), F.lit("numeric").alias("field_type"), F.min(x).alias("min"),
                      F.max(x).alias("max"), F.avg(x).alias("mean"), F.lit(None).cast("int").alias("rank"),
                      F.lit(None).cast("string").alias("value"))
    from pyspark.sql import Window
    vals = (df.select(qcol(field).cast("string").alias("value")).distinct()
            .orderBy(F.col("value").asc_nulls_last()).limit(n_values))
    w = Window.orderBy(F.col("value").asc_nulls_last())  # at most n_values rows
    return vals.select(F.lit(field).alias("field"), F.lit("categorical").alias("field_type"),
                       F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"),
                       F.lit(None).cast("double").alias("mean"), F.row_number().over(w).alias("rank"),
                       "value").select(*[c.split()[0] for c in schema.split(", ")])


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Share of each target value over all rows, NULL included, rounded to 4 (half-even)."""
    n = df.count()
    counts = df.groupBy(qcol(target).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    share = F.try_divide(F.col("count").cast("double"), F.lit(float(n)))
    return counts.select(F.col("value").cast("string").alias("class"), "count",
                         F.bround(share, 4).alias("share"), share.alias("raw_share"))


def majority_share(df: DataFrame, target: str) -> float:
    """Largest unrounded class share; 0.0 on an empty frame."""
    row = class_distribution(df, target).agg(F.max("raw_share").alias("m")).collect()[0]
    return float(row["m"]) if row["m"] is not None else 0.0


# ---------------------------------------------------------------- A10, A11

class Profile:
    """The statistics behind A6-A11, computed once and shared.

    Moments (one chunked one-row aggregate), exact quartiles, the correlation sums and the distinct counts are
    each one small collected result (rows per column or per pair), so
    insights and recommendations do not rescan the table per rule. These passes
    read a copy in the scratch folder: a frame of joins is computed once.
    """

    def __init__(self, df: DataFrame, method: str = "exact"):
        self.spark = df.sparkSession
        if df.columns:
            path = scratch_dir(self.spark, "profile")
            df.write.parquet(path)
            df = self.spark.read.schema(df.schema).parquet(path)
        self.numeric = qt.eda_numeric(df)
        self.moments = sorted(moments(df, self.numeric).collect(), key=lambda r: r["position"]) if self.numeric else []
        q = quantile_table(df, self.numeric, [0.25, 0.75], method=method) if self.numeric else []
        self.quartiles = {r["column"]: r["q"] for r in q}
        self.correlations = correlation_matrix(df, self.numeric).collect()
        self.constants = constant_columns(df, method=method).collect()
        self._outliers = None
        self._df = df

    def outlier_rows(self):
        if self._outliers is None:
            self._outliers = outliers(self._df, self.numeric, precomputed=self.quartiles).collect()
        return self._outliers

    def skew_rows(self, threshold: float = SKEW_THRESHOLD):
        out = []
        for r in self.moments:
            sk = r["skewness"]
            if r["count"] > 2 and sk is not None and abs(sk) > threshold:
                out.append((r["position"], r["column_name"], sk, "right" if sk > 0 else "left",
                            "moderate" if abs(sk) < SKEW_HIGH else "high"))
        return out

    def strong_rows(self, threshold: float = STRONG_CORR):
        pairs = [r for r in self.correlations if r["i"] < r["j"] and r["correlation"] is not None
                 and abs(r["correlation"]) >= threshold]
        pairs.sort(key=lambda r: (-abs(r["correlation"]), r["i"], r["j"]))
        return [(k + 1, r["feature_1"], r["feature_2"], r["correlation"],
                 "positive" if r["correlation"] > 0 else "negative") for k, r in enumerate(pairs)]


INSIGHT_SCHEMA = "kind string, position int, feature string, value double, detail string"


def insights(df: DataFrame, method: str = "exact", profile: Profile | None = None) -> DataFrame:
    """A10: outliers, skewness, strong correlations and constant columns as long rows."""
    p = profile or Profile(df, method)
    rows = [("outliers", r["position"], r["column_name"], r["percentage"], str(r["count"]))
            for r in p.outlier_rows()]
    rows += [("skewness", pos, col, sk, f"{d},{sev}") for pos, col, sk, d, sev in p.skew_rows()]
    rows += [("strong_correlation", k, f"{a} & {b}", r, rel) for k, a, b, r, rel in p.strong_rows()]
    rows += [("constant", r["position"], r["column_name"], float(r["unique_values"]), r["type"])
             for r in p.constants]
    return p.spark.createDataFrame(rows, INSIGHT_SCHEMA)


def recommendations(df: DataFrame, method: str = "exact", profile: Profile | None = None) -> DataFrame:
    """Rule table over A6, A7, A9 and the top 5 pairs with |r| >= 0.85.

    Order is stable: priority (high, medium, low), then rule, then the rule's
    own order, as in the reference's stable sort of the concatenated lists.
    The texts are formatted by Spark (``format_string``) from the shared
    profile's numbers.
    """
    p = profile or Profile(df, method)
    rows = []
    for pos, col, sk, d, sev in p.skew_rows():
        rows.append((0, pos, col, "skew", d, sk, MSG_LOG if d == "right" else MSG_BOXCOX,
                     "high" if sev == "high" else "medium", MSG_SKEW_REASON))
    for r in p.outlier_rows():
        if r["percentage"] > OUTLIER_RECOMMEND_PCT:
            rows.append((1, r["position"], r["column_name"], "outlier", None, r["percentage"], MSG_OUTLIER_REC,
                         "medium", MSG_OUTLIER_REASON))
    for r in p.constants:
        rows.append((2, r["position"], r["column_name"], "constant", None, None, MSG_CONST_REC, "high",
                     MSG_CONST_REASON))
    for k, a, b, corr, _ in p.strong_rows(RECOMMEND_CORR)[:RECOMMEND_CORR_TOP]:
        rows.append((3, k, f"{a} & {b}", "corr", None, corr, MSG_CORR_REC, "medium", MSG_CORR_REASON))
    base = p.spark.createDataFrame(rows, "rule int, item int, feature string, kind string, direction string, "
                                         "value double, recommendation string, priority string, reason string")
    issue = (F.when(F.col("kind") == "skew",
                    F.format_string(MSG_SKEW_ISSUE, "direction", F.format_string("%.2f", "value")))
             .when(F.col("kind") == "outlier", F.format_string(MSG_OUTLIER_ISSUE, F.format_string("%.1f", "value")))
             .when(F.col("kind") == "constant", F.lit(MSG_CONST_ISSUE))
             .otherwise(F.format_string(MSG_CORR_ISSUE, F.format_string("%.2f", "value"))))
    from pyspark.sql import Window
    prio = F.array_position(F.array(*[F.lit(x) for x in PRIORITY_ORDER]), F.col("priority"))
    w = Window.orderBy(prio, F.col("rule"), F.col("item"))  # a handful of rows
    return base.select(F.row_number().over(w).alias("rank"), "feature", issue.alias("issue"), "recommendation",
                       "priority", "reason")
