"""Deduplication and splits.

Splits are defined by a seeded 64-bit row hash: rows stand in the order of
``xxhash64(seed, row)`` inside their stratum, and test rows or folds are ranges
of that order. Equal rows are counted first and take as many places as they
have copies, so that sizes are exact however often rows repeat; strata may be
NULL. Places are running sums inside hash buckets on top of the sums of the
earlier buckets: no global sort, no window over a whole stratum, and nothing of
the data or its strata in the plan or on the driver. A split needs places only
in the buckets that its border runs through; the other buckets lie whole on one side.
Row membership differs from the reference's random generator by design.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.exprs import qcol
from quarry.session import scratch_dir

SEED = 42
# Leading bits of the row hash that make a bucket; a bucket of a stratum is one window.
BUCKET_BITS = 12
# Most distinct rows that a task sorts; partitions among which the copies of one row are counted first.
ROWS_PER_TASK, SALTS = 500_000, 16


class SplitError(ValueError):
    pass


def deduplicate(df: DataFrame) -> DataFrame:
    """Whole-row dedup, NULLs equal; map-side combine collapses copies early."""
    return df.dropDuplicates()


def row_hash(df: DataFrame, seed: int = SEED, cols: list[str] | None = None) -> Column:
    cols = list(df.columns if cols is None else cols)
    return F.xxhash64(F.lit(seed), *[qcol(c) for c in cols])


def test_count(n: int, test_size) -> int:
    """Exact test size: ceil(n * size) for a share in (0, 1); a whole number of rows in (0, n)."""
    share = isinstance(test_size, float)
    if isinstance(test_size, bool) or not (share or isinstance(test_size, int)):
        raise SplitError(f"the test size is a share or a number of rows, not {test_size!r}")
    if not 0 < test_size < (1 if share else n):
        raise SplitError(f"the test size {test_size} leaves no rows on one side")
    return math.ceil(n * test_size) if share else test_size


def _distinct(df: DataFrame, bucket: Column, seed: int, n_rows: int | None = None) -> DataFrame:
    """The distinct rows, their copies ``__copies`` and bucket ``__b``; few enough of ``n_rows`` need no estimate.

    Copies collapse in the map tasks. Where the distinct rows would fill the session's shuffle partitions, they are
    dealt by bucket over as many partitions as they need, the copies of a hot row by ``SALTS`` partitions first."""
    spark, cols = df.sparkSession, [qcol(c) for c in df.columns]
    fit = ROWS_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = n_rows if n_rows is not None and n_rows <= fit else df.agg(
        F.approx_count_distinct(row_hash(df, seed, df.columns)).alias("n")).first()["n"]
    if found <= fit:
        return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__copies")).withColumn("__b", bucket)
    parts = -(-found // ROWS_PER_TASK)
    dealt = df.withColumns({"__b": bucket, "__salt": F.spark_partition_id() % SALTS}).repartition(parts, "__b", "__salt")
    some = dealt.groupBy(*cols, "__b", "__salt").agg(F.count(F.lit(1)).alias("__copies"))
    return some.repartition(parts, "__b").groupBy(*cols, "__b").agg(F.sum("__copies").alias("__copies"))


def _bucket(df: DataFrame, seed: int) -> Column:
    return F.shiftright(row_hash(df, seed, df.columns), 64 - BUCKET_BITS)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A table with a row for each bucket and stratum, written so that the planner knows how few these are."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _starts(df: DataFrame, strata: list[str], seed: int) -> DataFrame:
    """Of each stratum ``__g0r``, ... and bucket ``__br`` its rows ``__s``, the place ``__start`` of the first in the
    stratum, and the stratum's size ``__n``."""
    keys = [f"__g{i}r" for i in range(len(strata))]
    sums = _kept(df.select(*[qcol(s).alias(k) for k, s in zip(keys, strata)], _bucket(df, seed).alias("__br")).groupBy(
        *keys, "__br").agg(F.count(F.lit(1)).alias("__s")), "buckets")
    all_of = Window.partitionBy(*keys)
    return sums.withColumns({"__n": F.sum("__s").over(all_of),
                             "__start": F.sum("__s").over(all_of.orderBy("__br")) - F.col("__s")})


def _same_bucket(strata: list[str]) -> Column:
    same = F.col("__b") == F.col("__br")
    for i in range(len(strata)):
        same = same & F.col(f"__g{i}").eqNullSafe(F.col(f"__g{i}r"))
    return same


def _placed(df: DataFrame, strata: list[str], seed: int, starts: DataFrame | None = None) -> DataFrame:
    """One row per distinct row of ``df`` with its copies ``__copies``, the place
    ``__from`` of the first copy in its stratum, and the stratum's size ``__n``."""
    keys = [f"__g{i}" for i in range(len(strata))]
    n_rows = None if starts is None else starts.agg(F.coalesce(F.sum("__s"), F.lit(0))).first()[0]
    rows = _distinct(df, _bucket(df, seed), seed, n_rows)
    rows = rows.withColumns({k: qcol(s) for k, s in zip(keys, strata)} | {"__h": row_hash(df, seed, df.columns)})
    if starts is None:
        starts = _starts(df, strata, seed).drop("__s").repartition(*[f"{k}r" for k in keys], "__br")
    # rows of equal hash but other values are told apart by a second hash, then by themselves
    inside = Window.partitionBy(*keys, "__b").orderBy("__h", row_hash(df, seed + 1, df.columns),
                                                      *[F.to_json(F.struct(qcol(c))) for c in df.columns])
    before = F.sum("__copies").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__copies")
    return rows.join(starts, _same_bucket(strata)).withColumn("__from", F.col("__start") + before)


def _copies(placed: DataFrame, columns: list[str], value: Column, name: str) -> DataFrame:
    """Every copy again, with ``value`` of its place ``__place`` as column ``name``."""
    each = placed.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
    return each.withColumn("__place", F.col("__from") + F.col("__i")).withColumn(name, value).select(
        *[qcol(c) for c in columns], name)


def _sides(df: DataFrame, strata: list[str], seed: int, starts: DataFrame, n_test: Column):
    """(train, test): test rows are those whose place in their stratum is under ``n_test``.

    ``starts`` has the stratum's ``n_test``. Buckets that end before it are test rows and those that begin at it or
    later train rows, whole; places are taken only in the one bucket of a stratum that it cuts, if it cuts one."""
    starts = _kept(starts.withColumns({"__first": F.col("__start") < n_test,
                                       "__last": F.col("__start") + F.col("__s") <= n_test, "__quota": n_test}), "sides")
    keys = {f"__g{i}": qcol(s) for i, s in enumerate(strata)}
    cut = F.col("__first") != F.col("__last")
    found = df.withColumns(keys | {"__b": _bucket(df, seed)})
    whole = found.join(starts.where(~cut), _same_bucket(strata))
    whole = whole.select(*[qcol(c) for c in df.columns], F.col("__first").alias("__test"))
    border = starts.where(cut)
    rows = found.join(border.select(*[f"{k}r" for k in keys], "__br"), _same_bucket(strata), "left_semi")
    placed = _placed(rows.select(*[qcol(c) for c in df.columns]), strata, seed, border)
    flagged = whole.unionByName(_copies(placed, df.columns, F.col("__place") < F.col("__quota"), "__test"))
    return flagged.where("not __test").drop("__test"), flagged.where("__test").drop("__test")


def random_split(df: DataFrame, test_size=0.2, seed: int = SEED):
    """R2: (train, test) with exactly ``test_count(n, test_size)`` test rows."""
    n = df.count()
    if n == 0:
        raise SplitError("there are no rows to split")
    return _sides(df, [], seed, _starts(df, [], seed), F.lit(test_count(n, test_size)))


def class_quotas(counts: dict, n_test: int) -> dict:
    """Test rows per class: floor of the proportional share, the remainder to
    the largest fractional parts (ties by class value)."""
    n = sum(counts.values())
    base = {c: (n_test * k) // n for c, k in counts.items()}
    left = n_test - sum(base.values())
    order = sorted(counts, key=lambda c: (-((n_test * counts[c]) % n), str(c)))
    for c in order[:left]:
        base[c] += 1
    return base


def quota_table(counts: DataFrame, n: int, n_test: int) -> DataFrame:
    """``class_quotas`` as a table: (class, k) to (class, quota)."""
    share = F.lit(n_test).cast("long") * F.col("k")
    parts = counts.withColumn("base", F.expr(f"{n_test}L * k div {n}L")).withColumn("rest", share % n)
    rank = F.row_number().over(Window.orderBy(F.desc("rest"), F.col("class").cast("string")))
    left = F.lit(n_test) - F.sum("base").over(Window.partitionBy())
    return parts.select("class", (F.col("base") + F.when(rank <= left, 1).otherwise(0)).alias("quota"))


def stratified_split(df: DataFrame, target: str, test_size=0.2, seed: int = SEED, task_type: str = "classification",
                     stratify: bool = True):
    """Per-class quotas; plain split when not classification, fewer than two
    classes, a class with fewer than two rows, or rows without a class."""
    if not stratify or task_type != "classification":
        return random_split(df, test_size, seed)
    counts = df.groupBy(qcol(target).alias("class")).agg(F.count(F.lit(1)).alias("k"))
    about = counts.agg(F.count(F.lit(1)).alias("classes"), F.min("k").alias("least"), F.sum("k").alias("n"),
                       F.count_if(F.col("class").isNull()).alias("missing")).first()
    if about["classes"] < 2 or about["least"] < 2 or about["missing"]:
        return random_split(df, test_size, seed)
    quotas = quota_table(counts, about["n"], test_count(about["n"], test_size))
    starts = _starts(df, [target], seed).join(quotas, F.col("__g0r") == F.col("class")).drop("class")
    return _sides(df, [target], seed, starts, F.col("quota"))


def fold_sizes(n: int, k: int) -> list[int]:
    """K-fold sizes: the first ``n % k`` folds get one extra row."""
    return [n // k + (1 if f < n % k else 0) for f in range(k)]


def assign_folds(df: DataFrame, k: int = 3, seed: int = SEED, strata: list[str] | None = None,
                 fold_col: str = "fold") -> DataFrame:
    """Integer fold column for ``CrossValidator(foldCol=...)``.

    Fold f holds the f-th block of ``fold_sizes`` of the places (within the
    stratum, if any; NULL is a stratum). Copies of a row take places one by one
    and may so fall into different folds.
    """
    if k < 2:
        raise SplitError("a search needs two folds or more")
    n, place = F.col("__n"), F.col("__place")
    size, extra = F.floor(n / k), n % k
    longer = extra * (size + 1)
    fold = F.when(place < longer, F.floor(place / (size + 1))).otherwise(
        extra + F.floor((place - longer) / F.greatest(size, F.lit(1))))
    return _copies(_placed(df, list(strata or []), seed), df.columns, fold.cast("int"), fold_col)
