"""Exact grouped quantiles as DataFrames, without a global sort or a one-task group.

Spark's exact ``percentile`` keeps every distinct value of a group in one
buffer, and a window over a hot group runs in one task. Here only groups of at
most ``SMALL_GROUP`` values use the built-in aggregate, whose buffer is bounded
then. In larger ones:

1. one pass counts the values of every group and sketches its quantiles; the
   sketch's error bound gives a bracket around each wanted quantile that is sure
   to hold it, with a few thousandths of the group's values inside;
2. a second pass counts the values below each bracket, a third one keeps those
   inside, in the scratch folder;
3. the kept values are counted into buckets, with map-side combine; a running
   sum over a group's buckets finds the one that holds the wanted rank, whose
   least and greatest value are the next bracket. This goes on, over the kept
   values only, until a bracket is a single value.

Nothing is collected: the state of the search is a table with a row for each
group and rank, and a shuffle carries at most ``BUCKETS`` rows for each of these
and map task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.exprs import qcol
from quarry.session import scratch_dir

SMALL_GROUP = 20_000
#: Accuracy of the sketch and the half width of a bracket, in shares of a group: twice the sketch's error.
ACCURACY, MARGIN = 1000, 2e-3
BUCKETS = 1024


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bucket(x, lo, hi):
    """Place of x in the interval, monotone in x; the ends have places of their own, so every round narrows it."""
    half = hi / 2 - lo / 2
    share = (x / 2 - lo / 2) / F.when((half > 0) & (half < float("inf")), half)
    inner = F.coalesce(F.floor(share * (BUCKETS - 2)), F.lit(BUCKETS // 2))
    return F.when(x <= lo, 0).when(x >= hi, BUCKETS - 1).otherwise(
        F.greatest(F.lit(1), F.least(inner, F.lit(BUCKETS - 2)))).cast("int")


def group_quantiles(df: DataFrame, group_cols: Sequence[str], x: str, probs: Sequence[float], method: str = "exact") -> DataFrame:
    """The group columns, ``n`` and ``q`` (array, one for each probability, by linear interpolation).

    NULL and NaN values do not count, rows with a NULL group neither; groups without values have no row.
    ``method="approx"`` takes the sketch's values."""
    groups = [f"__g{i}" for i in range(len(group_cols))] or ["__g"]  # without groups, all rows are one
    rows = df.select(*([qcol(c).alias(g) for c, g in zip(group_cols, groups)] or [F.lit(0).alias("__g")]),
                     qcol(x).cast("double").alias("__x"))
    rows = rows.where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    for g in groups:
        rows = rows.where(F.col(g).isNotNull())
    named = [F.col(g).alias(c) for c, g in zip(group_cols, groups)]
    count = F.count(F.lit(1)).alias("n")
    if method == "approx":
        return rows.groupBy(*groups).agg(count, F.percentile_approx("__x", list(probs), 10 * ACCURACY).alias("q")).select(*named, "n", "q")

    cuts = [c for p in probs for c in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))]
    stats = rows.groupBy(*groups).agg(count, F.percentile_approx("__x", cuts, ACCURACY).alias("cuts"),
                                      F.min("__x").alias("least"), F.max("__x").alias("most"))
    stats = _kept(stats, "quantile-stats")
    large = stats.where(F.col("n") > SMALL_GROUP)
    small = stats.where(F.col("n") <= SMALL_GROUP).select(*groups)
    out = rows.join(small, groups).groupBy(*groups).agg(count, F.percentile("__x", F.array(*map(F.lit, probs))).alias("q"))
    if not large.isEmpty():
        out = out.unionByName(_large(rows, large, groups, list(probs)))
    return out.select(*named, "n", "q")


def _large(rows: DataFrame, large: DataFrame, groups: list[str], probs: list[float]) -> DataFrame:
    places = range(len(probs))
    # an end of the scale is its own bracket; the sketch's values bound the others
    low = [F.col("least") if p <= MARGIN else F.col("cuts")[2 * i] for i, p in enumerate(probs)]
    high = [F.col("most") if p >= 1 - MARGIN else F.col("cuts")[2 * i + 1] for i, p in enumerate(probs)]
    brackets = large.select(*groups, "n", *[c.alias(f"__lo{i}") for i, c in enumerate(low)],
                            *[c.alias(f"__hi{i}") for i, c in enumerate(high)])
    told = rows.join(brackets, groups)
    x = F.col("__x")
    below = _kept(told.groupBy(*groups).agg(*[F.count_if(x < F.col(f"__lo{i}")).alias(f"__b{i}") for i in places]), "quantile-below")
    inside = F.array_compact(F.array(*[F.when(x.between(F.col(f"__lo{i}"), F.col(f"__hi{i}")), i) for i in places]))
    hits = _kept(told.select(*groups, "__x", F.explode(inside).alias("i")), "quantile-hits")

    # two ranks for each probability; they are the same where the position is a whole number
    sought = []
    for i, p in enumerate(probs):
        position = F.lit(p) * (F.col("n") - 1)
        for t, rank in enumerate((F.floor(position), F.least(F.floor(position) + 1, F.col("n") - 1))):
            sought.append(F.struct(F.lit(i).alias("i"), F.lit(t).alias("t"), (rank - F.col(f"__b{i}")).cast("long").alias("rank"),
                                   F.col(f"__lo{i}").alias("lo"), F.col(f"__hi{i}").alias("hi")))
    state = brackets.join(below, groups).select(*groups, F.explode(F.array(*sought)).alias("s")).select(*groups, "s.*")
    state = _kept(state, "quantile-state")
    key = [*groups, "i", "t"]
    found = []
    while not state.isEmpty():
        near = hits.join(state.select(*key, "lo", "hi"), [*groups, "i"]).where(x.between(F.col("lo"), F.col("hi")))
        buckets = near.groupBy(*key, _bucket(x, F.col("lo"), F.col("hi")).alias("b")).agg(
            F.count(F.lit(1)).alias("c"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy(*key).orderBy("b"))
        at = buckets.withColumn("upto", upto).join(state.select(*key, "rank"), key).where(
            (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        state = _kept(at.select(*key, (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), "lo", "hi"), "quantile-state")
        found.append(state.where("lo = hi").select(*key, F.col("lo").alias("value")))
        state = state.where("lo < hi")
    values = reduce(DataFrame.unionByName, found).groupBy(*groups).agg(
        F.array_sort(F.collect_list(F.struct("i", "t", "value"))).alias("v"))
    q = []
    for i, p in enumerate(probs):
        a, b = F.get("v", F.lit(2 * i))["value"], F.get("v", F.lit(2 * i + 1))["value"]
        position = F.lit(p) * (F.col("n") - 1)
        q.append(F.when(a == b, a).otherwise(a + (b - a) * (position - F.floor(position))))
    # every rank has its value, or the sketch has broken its bound
    whole = F.when(F.size("v") == 2 * len(probs), F.array(*q)).otherwise(F.raise_error(F.lit("a quantile left its bracket")))
    return large.select(*groups, "n").join(values, groups).select(*groups, "n", whole.alias("q"))


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float], group_cols: Sequence[str] = (),
                   method: str = "exact") -> list[dict]:
    """Quantiles of several columns, for callers that need them on the driver: a row for each column (and group).

    Returns ``{group cols..., 'column', 'n', 'q': [values]}``, columns in order; all are found in the same passes."""
    columns, group_cols = list(columns), list(group_cols)
    if not columns:
        return []
    keys = [f"__k{i}" for i in range(len(group_cols))]
    long = df.select(*[qcol(g).alias(k) for g, k in zip(group_cols, keys)], F.explode(F.array(*[
        F.struct(F.lit(i).alias("place"), qcol(c).cast("double").alias("x")) for i, c in enumerate(columns)])).alias("s"))
    found = group_quantiles(long.select(*keys, "s.*"), [*keys, "place"], "x", probs, method).collect()
    out = [{g: r[k] for g, k in zip(group_cols, keys)} | {"column": columns[r["place"]], "n": r["n"], "q": list(r["q"])}
           for r in sorted(found, key=lambda r: (tuple(str(r[k]) for k in keys), r["place"]))]
    return out
