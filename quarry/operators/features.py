"""Feature preparation (F1-F14): fitted on train, applied to any frame.

Fitting is one aggregate per statistic family (long form, so the aggregate
stays in codegen however many columns there are); applying is a projection
with literals (``coalesce``, arithmetic, ``CASE``), so the transform runs as
narrow whole-stage-codegen stages with no shuffle. Category lists are the
sorted distinct values of train, as in the reference's encoders.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.exprs import nan_to_null, qcol, safe_corr
from quarry.functions.quantiles import quantile_table
from quarry.operators import dictionary, pipeline
from quarry.operators.profile import long_values
from quarry.session import scratch_dir

# Option names and the mutual-information bin count.
NUMERIC_STRATEGIES = ("mean", "median", "most_frequent")
SCALERS = ("standard", "minmax", "none")
MI_BINS = 10
UNKNOWN_CODE = -1


class FeatureError(ValueError):
    pass


# ---------------------------------------------------------------- F1, F2

def fit_numeric_imputer(train: DataFrame, cols: list[str], strategy: str = "mean") -> dict:
    """fill value per column from train: mean, interpolated median or most frequent."""
    strategy = strategy.lower()
    if not cols:
        return {}
    if strategy == "mean":
        rows = long_values(train, cols).groupBy("column_name").agg(F.avg("x").alias("v")).collect()
        return {r["column_name"]: r["v"] for r in rows}
    if strategy == "median":
        return {r["column"]: r["q"][0] for r in quantile_table(train, cols, [0.5])}
    if strategy == "most_frequent":
        return fit_mode(train, cols)
    raise FeatureError(f"unsupported numerical imputation strategy '{strategy}'")


def fit_mode(train: DataFrame, cols: list[str]) -> dict:
    """most frequent non-NULL value per column; ties go to the smallest value.

    Counts per (column, value) with map-side combine, then ``min_by`` over
    ``(-count, value)``: a declarative aggregate, no window over a hot column.
    """
    if not cols:
        return {}
    out = {}
    by_type: dict = {}
    for c in cols:
        by_type.setdefault(train.schema[c].dataType.simpleString(), []).append(c)
    for _, group in by_type.items():
        long = train.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), qcol(c).alias("value")) for c in group])).alias("s")).select("s.*")
        counts = long.where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
            F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("column_name").agg(
            F.min_by(F.col("value"), F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))).alias("mode"))
        out.update({r["column_name"]: r["mode"] for r in best.collect()})
    return out


def apply_fill(df: DataFrame, fills: dict) -> DataFrame:
    return df.select(*[
        (F.coalesce(qcol(c), F.lit(fills[c]).cast(df.schema[c].dataType)).alias(c) if c in fills and
         fills[c] is not None else qcol(c)) for c in df.columns])


# ---------------------------------------------------------------- F3, F4

def fit_scaler(train: DataFrame, cols: list[str], method: str = "standard") -> dict:
    """(shift, divisor) per column; population std or range, divisor 1 when 0."""
    method = method.lower()
    if method not in SCALERS:
        raise FeatureError(f"no scaling called {method!r}")
    if method == "none" or not cols:
        return {}
    x = F.col("x")
    if method == "standard":
        aggs = [F.avg(x).alias("a"), F.stddev_pop(x).alias("b")]
    else:
        aggs = [F.min(x).alias("a"), (F.max(x) - F.min(x)).alias("b")]
    rows = long_values(train, cols).groupBy("column_name").agg(*aggs).collect()
    out = {}
    for r in rows:
        shift = r["a"] if r["a"] is not None else 0.0
        div = r["b"] if r["b"] not in (None, 0.0) and not (isinstance(r["b"], float) and math.isnan(r["b"])) else 1.0
        out[r["column_name"]] = (shift, div)
    return out


def apply_scaler(df: DataFrame, params: dict) -> DataFrame:
    return df.select(*[
        ((qcol(c).cast("double") - F.lit(params[c][0])) / F.lit(params[c][1])).alias(c) if c in params else qcol(c)
        for c in df.columns])


# ---------------------------------------------------------------- F6, F7

def fit_categories(train: DataFrame, cols: list[str]) -> DataFrame:
    """The category table (column_name, value, code): sorted distinct non-NULL values per column, as text, from train."""
    return dictionary.category_table(train, cols)


def category_names(table: DataFrame, cols: list[str]) -> dict:
    """The categories as lists, for outputs that have a column for each."""
    out = {c: [] for c in cols}
    for r in table.orderBy("column_name", "code").collect():
        out[r["column_name"]].append(r["value"])
    return out


def ordinal_encode(df: DataFrame, table: DataFrame, cols: list[str]) -> DataFrame:
    """position in the sorted train categories; unseen (or NULL) gives -1."""
    return dictionary.encode(df, table, {c: (c, c) for c in cols}, UNKNOWN_CODE).select(*[qcol(c) for c in df.columns])


def one_hot_columns(df: DataFrame, categories: dict, sep: str = "_") -> DataFrame:
    """F6 as named 0/1 columns ``c_value``; an unseen value is all zeros."""
    out = []
    for c in df.columns:
        if c in categories:
            for v in categories[c]:
                out.append(F.when(qcol(c).cast("string") == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0))
                           .alias(f"{c}{sep}{v}"))
        else:
            out.append(qcol(c))
    return df.select(*out)


# ---------------------------------------------------------------- F8, F9

def label_table(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """F8: sorted labels (as strings) over train and test -> (index, label).

    The table is written to the scratch folder: the planner then knows its size, so that encoding by a few labels
    does not shuffle the rows by class."""
    labels = train.select(qcol(target).cast("string").alias("label")).union(
        test.select(qcol(target).cast("string").alias("label"))).where(F.col("label").isNotNull()).distinct()
    w = Window.orderBy("label")  # classification: at most a few dozen labels
    found = labels.select((F.dense_rank().over(w) - 1).alias("index"), "label")
    path = scratch_dir(train.sparkSession, "labels")
    found.write.parquet(path)
    return train.sparkSession.read.schema(found.schema).parquet(path)


def encode_labels(df: DataFrame, target: str, labels: DataFrame, out: str | None = None) -> DataFrame:
    """F8 applied: the label's index (double) in ``out`` (default: replaces the target)."""
    out = out or target
    lk = labels.select(F.col("index").cast("double").alias("__idx"), F.col("label").alias("__label"))
    j = df.join(lk, qcol(target).cast("string") == F.col("__label"), "left").drop("__label")
    if out == target:
        j = j.drop(target)
    return j.withColumnRenamed("__idx", out)


def decode_labels(df: DataFrame, col: str, labels: DataFrame, out: str = "decoded") -> DataFrame:
    """index to label; out-of-range or non-numeric values stay as they are (as text)."""
    lk = labels.select(F.col("index").alias("__i"), F.col("label").alias("__l"))
    idx = qcol(col).cast("string").try_cast("double")
    key = F.when(idx == F.floor(idx), idx.cast("long"))
    j = df.join(lk, key == F.col("__i"), "left")
    return j.withColumn(out, F.coalesce(F.col("__l"), qcol(col).cast("string"))).drop("__i", "__l")


# ---------------------------------------------------------------- F10-F12

def selector_frame(train: DataFrame, numerical: list[str], categorical: list[str], num_strategy="mean"):
    """The scoring input: numeric imputed, categorical imputed and ordinal-coded."""
    fills = fit_numeric_imputer(train, numerical, num_strategy)
    fills.update(fit_mode(train, categorical))
    filled = apply_fill(train, fills)
    return ordinal_encode(filled, fit_categories(filled, categorical), categorical)


def correlation_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """|Pearson(feature, target)|; constant or undefined gives 0."""
    agg = df.agg(*[F.abs(safe_corr(qcol(f), qcol(target))).alias(f"s{i}") for i, f in enumerate(features)])
    structs = [F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"),
                        F.coalesce(F.col(f"s{i}"), F.lit(0.0)).alias("score")) for i, f in enumerate(features)]
    return agg.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def mutual_information(df: DataFrame, features: list[str], target: str, discrete_target: bool,
                       bins: int = MI_BINS, discrete: Sequence[str] = ()) -> DataFrame:
    """mutual information in nats of quantile buckets and categories.

    Features named in ``discrete`` (and a discrete target) count as they are; others are cut at their exact quantiles
    i / ``bins``, so that one far value empties no bucket: a value's bucket is the number of cuts below it, and equal
    cuts are one. MI = sum p(x,y) ln(p(x,y) / (p(x) p(y))) over rows where both are present. The joint counts are
    combined on the map side; what is shuffled has a row for each value pair that occurs.
    """
    discrete = set(discrete)
    cut = [c for c in [*features, *([] if discrete_target else [target])] if c not in discrete or c == target and not discrete_target]
    edges = {r["column"]: sorted(set(r["q"])) for r in quantile_table(df, cut, [i / bins for i in range(1, bins)])}

    def value(c, as_it_is):
        if as_it_is:
            return qcol(c).cast("string")
        x = nan_to_null(qcol(c).cast("double"))
        below = sum((F.when(x > F.lit(e), 1).otherwise(0) for e in edges.get(c, [])), F.lit(0))
        return F.when(x.isNotNull(), below.cast("string"))

    long = df.select(value(target, discrete_target).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"), value(f, f in discrete).alias("x"))
        for i, f in enumerate(features)])).alias("s")).select("y", "s.*").where("y is not null and x is not null")
    joint = long.groupBy("position", "feature", "x", "y").agg(F.count(F.lit(1)).alias("nxy"))
    of_x = joint.groupBy("position", "x").agg(F.sum("nxy").alias("nx"))
    of_y = joint.groupBy("position", "y").agg(F.sum("nxy").alias("ny"))
    of_all = joint.groupBy("position").agg(F.sum("nxy").alias("n"))
    j = joint.join(of_x, ["position", "x"]).join(of_y, ["position", "y"]).join(of_all, "position")
    term = (F.col("nxy") / F.col("n")) * F.log((F.col("nxy") * F.col("n")) / (F.col("nx") * F.col("ny")))
    return j.groupBy("position", "feature").agg(F.sum(term).alias("score"))


def top_features(scores: DataFrame, n: int, n_columns: int | None = None) -> DataFrame:
    """score descending, then name; n > 0, capped at n_columns - 1 when given."""
    if n <= 0:
        raise FeatureError(f"cannot keep {n} features")
    if n_columns is not None:
        n = max(1, min(n, n_columns - 1))
    head = scores.orderBy(F.col("score").desc(), F.col("feature")).limit(n)
    w = Window.orderBy(F.col("score").desc(), F.col("feature"))  # at most n rows
    return head.select(F.row_number().over(w).alias("rank"), "feature", "score")


# ---------------------------------------------------------------- F13, F14

_BAD = re.compile(r"[\[\]<>]")


def output_names(numerical: list[str], categories: dict) -> list[str]:
    """``num__c`` and ``cat__c_value`` with ``[ ] < >`` replaced by ``_``;
    a repeated name gets ``_{position}``."""
    raw = [f"num__{c}" for c in numerical] + [f"cat__{c}_{v}" for c in categories for v in categories[c]]
    out: list[str] = []
    for name in raw:
        clean = _BAD.sub("_", str(name))
        if clean in out:
            clean = f"{clean}_{len(out)}"
        out.append(clean)
    return out


def _as_numbers(df: DataFrame, numerical: list[str], others: list[str]) -> DataFrame:
    """Numeric inputs as doubles, so that a fill of an integer column keeps its fraction."""
    return df.select(*[qcol(c).cast("double").alias(c) for c in numerical], *[qcol(c) for c in others])


@dataclass
class Preprocessor:
    """parameters fitted on train; ``transform`` and ``assemble`` apply them to any frame."""
    numerical: list
    categorical: list
    fills: dict = field(default_factory=dict)
    scale: dict = field(default_factory=dict)
    table: DataFrame | None = None
    _stages: list | None = None
    _categories: dict | None = None

    @classmethod
    def fit(cls, train: DataFrame, numerical, categorical, num_strategy="mean", cat_strategy="most_frequent",
            scaling="standard"):
        if cat_strategy != "most_frequent":
            raise FeatureError(f"unsupported categorical imputation strategy '{cat_strategy}'")
        fills = fit_numeric_imputer(train, numerical, num_strategy)
        fills.update(fit_mode(train, categorical))
        filled = apply_fill(_as_numbers(train, numerical, categorical), fills)
        return cls(list(numerical), list(categorical), fills, fit_scaler(filled, numerical, scaling),
                   fit_categories(filled, categorical))

    @property
    def categories(self) -> dict:
        """The categories as lists: for named output columns, one for each."""
        if self._categories is None:
            self._categories = category_names(self.table, self.categorical)
        return self._categories

    @property
    def names(self) -> list[str]:
        return output_names(self.numerical, self.categories)

    def stages(self) -> list:
        """The fitted stages from raw columns to ``features``; they can be saved in a ``PipelineModel``."""
        if self._stages is None:
            self._stages = pipeline.preparation(self.table.sparkSession, self.numerical, self.categorical, self.fills,
                                                self.scale, self.table)
        return self._stages

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Named output columns (F14 order: numeric, then one-hot), plus ``keep`` columns last."""
        keep = [k for k in (keep or []) if k in df.columns]
        base = apply_fill(_as_numbers(df, self.numerical, self.categorical + keep), self.fills)
        base = apply_scaler(base, self.scale)
        exprs = [qcol(c).cast("double") for c in self.numerical]
        for c in self.categorical:
            for v in self.categories[c]:
                exprs.append(F.when(qcol(c).cast("string") == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)))
        return base.select(*[e.alias(n) for e, n in zip(exprs, self.names)], *[qcol(k) for k in keep])

    def assemble(self, df: DataFrame, keep: list[str] | None = None, out: str = "features") -> DataFrame:
        """The ``features`` vector (numeric first, then one-hot), ``keep`` columns beside it."""
        keep = [k for k in (keep or []) if k in df.columns]
        made = PipelineModel(stages=self.stages()).transform(df)
        return made.select(F.col("features").alias(out), *[qcol(k) for k in keep])
