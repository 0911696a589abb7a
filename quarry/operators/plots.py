"""Data behind the plots (P6, A14-A17); figure drawing is not part of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.exprs import qcol
from quarry.functions.quantiles import group_quantiles


def complete_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows where x and y are both present."""
    return df.dropna(subset=[x, y])


def histogram(df: DataFrame, x: str, bins: int = 30, group: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max] of the non-NULL values (per group).

    The last bin is closed on the right. The per-group bounds are an aggregate
    joined back on the group, so no window over a hot group is needed.
    """
    v = qcol(x).cast("double")
    keys = [group] if group else []
    base = df.select(*[qcol(k) for k in keys], v.alias("__x")).where(F.col("__x").isNotNull())
    if group:
        base = base.where(qcol(group).isNotNull())
    bounds = base.groupBy(*keys).agg(F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    if keys:
        data = base.join(bounds, keys)
    else:
        # one bounds row: read it once and inline it as literals
        r = bounds.collect()[0]
        data = base.select("__x", F.lit(r["lo"]).cast("double").alias("lo"), F.lit(r["hi"]).cast("double").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col("__x") - lo) / (hi - lo) * F.lit(bins)).cast("int"), F.lit(bins - 1)))
    counted = data.groupBy(*keys, "lo", "hi", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        *keys, "bin",
        (lo + (hi - lo) * F.col("bin") / F.lit(bins)).alias("bin_start"),
        F.when(hi == lo, hi).otherwise(lo + (hi - lo) * (F.col("bin") + 1) / F.lit(bins)).alias("bin_end"),
        "count")


def scatter(df: DataFrame, x: str, y: str, group: str | None = None, max_points: int | None = None,
            seed: int = 42) -> DataFrame:
    """X, y (both present) and the optional series value.

    All points are returned unless ``max_points`` is given, in which case a
    seeded Bernoulli sample is drawn (the sampling is then the feature).
    """
    cols = [qcol(x).alias("x"), qcol(y).alias("y")]
    if group:
        cols.append(qcol(group).alias("series"))
    out = df.select(*cols).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    if max_points is not None:
        n = out.count()
        if n > max_points:
            out = out.sample(fraction=max_points / n, seed=seed)
    return out


def box(df: DataFrame, x: str, group: str | None = None, method: str = "exact") -> DataFrame:
    """Count, min, quartiles, max, mean and sample sd per group (NULL groups dropped)."""
    keys = [group] if group else []
    base = df.select(*[qcol(k).alias("grp") for k in keys], qcol(x).cast("double").alias("__x"))
    if group:
        base = base.where(F.col("grp").isNotNull())
    else:
        base = base.withColumn("grp", F.lit(x))
    base = base.where(F.col("__x").isNotNull())
    stats = base.groupBy("grp").agg(F.count("__x").alias("count"), F.min("__x").alias("min"),
                                    F.max("__x").alias("max"), F.avg("__x").alias("mean"),
                                    F.stddev_samp("__x").alias("sd"))
    q = group_quantiles(base, ["grp"], "__x", [0.25, 0.5, 0.75], method)
    return stats.join(q, "grp").select("grp", "count", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                                       F.col("q")[2].alias("q3"), "max", "mean", "sd")


def bar(df: DataFrame, x: str, top: int = 20) -> DataFrame:
    """The ``top`` most frequent non-NULL values; ties by value."""
    counts = (df.select(qcol(x).cast("string").alias("value")).where(F.col("value").isNotNull())
              .groupBy("value").agg(F.count(F.lit(1)).alias("count")))
    head = counts.orderBy(F.col("count").desc(), F.col("value")).limit(top)
    w = Window.orderBy(F.col("count").desc(), F.col("value"))  # at most ``top`` rows
    return head.select("value", "count", F.row_number().over(w).alias("rank"))
