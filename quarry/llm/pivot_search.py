"""Exact top-k search by inner product over a pivot-distance index.

A vector v gets one more component, sqrt(M^2 - |v|^2) with M the greatest norm,
and a query gets 0 there. Then |q - v|^2 = |q|^2 + M^2 - 2 q.v: the greatest
inner products are the smallest distances, so the triangle inequality applies.

Index: each vector is keyed by its nearest pivot and its distance to it. A
pivot's vectors, sorted by distance, are cut into annuli of bounded size.

Search: a query first looks into the annuli of its nearest pivots that hold its
own distance; the k-th best score found there bounds the distance that still
matters. Of all other annuli it visits those whose distance range, by the
triangle inequality, may hold something nearer, and in each of them only the
rows within the bound. Work is a join of annuli with blocks of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import written

#: Rows of an annulus and queries of a block: they bound the memory of one work item.
ANNULUS_ROWS = 2048
BLOCK_QUERIES = 256
#: Pivots: rows with the smallest hash of their id, at most so many, and of those nearest to a query the ones looked at first.
PIVOTS = 48
FIRST_PIVOTS = 2
#: Relative slack of the bounds for rounding of distances.
SLACK = 1e-9


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): integer components floor(scale * x), for vectors without NULL or non-finite components."""
    x = F.col(vec_col)
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return (vectors.where(F.coalesce(good, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as an integer matrix; shorter rows are filled with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(column).to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _distances(m: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    full = np.c_[m.astype(float), extra]
    return np.sqrt(np.maximum((full ** 2).sum(1)[:, None] + (pivots ** 2).sum(1) - 2 * full @ pivots.T, 0))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` rows of the highest inner product for each query, other than the query itself.

    Both inputs are (id long, v array<long>). Returns ``query_id, rank, vec_id,
    score``; ties go to the smaller id; with fewer candidates all are returned.
    Vectors of different length are compared as if filled up with zeros. Every
    row must keep |component| * 256 within 2^31 or so, so that scores fit a long.
    Empty inputs give an empty result. Ids are unique; rows that repeat an id
    are candidates of their own but are no candidates for the query of that id.
    """
    spark = rows.sparkSession
    rows = written(rows, "vectors")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
    shape = rows.agg(F.max(F.size("v")).alias("width"), F.max(norm).alias("m")).first()
    schema_out = "query_id long, rank int, vec_id long, score long"
    if shape["width"] is None:
        return spark.createDataFrame([], schema_out)
    width, most = max(shape["width"], 1), float(shape["m"])
    chosen = rows.orderBy(F.xxhash64("id")).limit(PIVOTS).toArrow()
    m = _matrix(chosen["v"].combine_chunks(), width)
    points = spark.sparkContext.broadcast(np.c_[m.astype(float), np.sqrt(np.maximum(most - (m * m).sum(1), 0))])

    def key(batches):
        for b in batches:
            m = _matrix(b.column("v"), width)
            d = _distances(m, np.sqrt(np.maximum(most - (m * m).sum(1), 0)), points.value)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(near, pa.int32()),
                                              pa.array(d[np.arange(len(near)), near])], names=["id", "v", "pivot", "r"])

    keyed = written(rows.mapInArrow(key, "id long, v array<long>, pivot int, r double"), "keyed")
    # annuli: sorted by distance inside coarse rings first, so that no pivot is sorted in one task
    ring = F.floor(F.col("r") * 64 / (2 * most ** 0.5 + 1))
    keyed = keyed.withColumn("ring", ring)
    part = F.floor((F.row_number().over(W.partitionBy("pivot", "ring").orderBy("r", "id")) - 1) / ANNULUS_ROWS)
    keyed = keyed.withColumn("part", part)
    place = ["pivot", "ring", "part"]
    annuli = written(keyed.groupBy(*place).agg(
        F.array_sort(F.collect_list(F.struct("r", "id", "v"))).alias("rows")).withColumn(
        "annulus", F.xxhash64(*place)).select("annulus", "pivot", F.col("rows")[0]["r"].alias("low"),
                                              F.element_at("rows", -1)["r"].alias("high"), "rows"), "annuli")
    ranges = annuli.select("annulus", "pivot", "low", "high")

    def far(batches):
        for b in batches:
            m = _matrix(b.column("v"), width)
            d = _distances(m, np.zeros(len(m)), points.value)
            near = np.argsort(d, 1)[:, :FIRST_PIVOTS]
            n, p = d.shape
            first = np.zeros((n, p), bool)
            first[np.arange(n)[:, None], near] = True
            q = np.repeat(np.arange(n), p)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(q)), pa.array(np.tile(np.arange(p), n), pa.int32()),
                 pa.array(d.ravel()), pa.array(first.ravel())], names=["q", "pivot", "d", "first"])

    queries = written(queries, "queries")
    reach = written(queries.mapInArrow(far, "q long, pivot int, d double, first boolean"), "reach")

    def visit(wanted: DataFrame) -> DataFrame:
        """Best ``k`` rows of each wanted (annulus, query); wanted: annulus, q, d (to its pivot), bound (distance)."""
        block = F.floor((F.row_number().over(W.partitionBy("annulus", "lane").orderBy("q")) - 1) / BLOCK_QUERIES)
        blocks = (wanted.withColumn("lane", F.pmod(F.xxhash64("q"), F.lit(16)))
                  .join(queries.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q")
                  .withColumn("block", block).groupBy("annulus", "lane", "block")
                  .agg(F.collect_list(F.struct("q", "d", "bound", "qv")).alias("queries")))
        work = blocks.join(annuli.select("annulus", "rows"), "annulus").select("queries", "rows")

        def score(batches):
            for b in batches:
                out = {"q": [], "id": [], "score": []}
                for i in range(b.num_rows):
                    q, r = b.column("queries")[i].values, b.column("rows")[i].values
                    qid, qd, bound = (q.field(n).to_numpy(zero_copy_only=False) for n in ("q", "d", "bound"))
                    rid, rr = r.field("id").to_numpy(), r.field("r").to_numpy()
                    qm, rm = _matrix(q.field("qv"), width), _matrix(r.field("v"), width)
                    lo = np.searchsorted(rr, (qd - bound) * (1 - SLACK) - SLACK, "left")
                    hi = np.searchsorted(rr, (qd + bound) * (1 + SLACK) + SLACK, "right")
                    # sums of products of integers below 2^26 are exact in double precision up to 2^53
                    exact = float(np.abs(qm).max(initial=0)) * float(np.abs(rm).max(initial=0)) * width < 2.0 ** 53
                    s = (qm.astype(float) @ rm.T.astype(float)).astype(np.int64) if exact else qm @ rm.T
                    for j in range(len(qid)):
                        ids, sc = rid[lo[j]:hi[j]], s[j, lo[j]:hi[j]]
                        ids, sc = ids[ids != qid[j]], sc[ids != qid[j]]
                        if len(sc) > k:
                            edge = np.partition(sc, len(sc) - k)[len(sc) - k]
                            ids, sc = ids[sc >= edge], sc[sc >= edge]
                        best = np.lexsort((ids, -sc))[:k]
                        out["q"].append(np.full(len(best), qid[j]))
                        out["id"].append(ids[best])
                        out["score"].append(sc[best])
                if out["q"]:
                    yield pa.RecordBatch.from_pydict({n: pa.array(np.concatenate(x).astype(np.int64))
                                                      for n, x in out.items()})

        found = work.mapInArrow(score, "q long, id long, score long")
        rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    # first look: the annuli of the nearest pivots that hold the query's own distance, or the one next to it
    gap = F.greatest(F.col("low") - F.col("d"), F.col("d") - F.col("high"), F.lit(0.0))
    own = (reach.where("first").join(ranges, "pivot")
           .withColumn("gap", gap).withColumn("n", F.row_number().over(W.partitionBy("q", "pivot").orderBy("gap", "annulus")))
           .where("n <= 2").select("annulus", "q", "d", F.lit(float("inf")).alias("bound")))
    own = written(own, "own")
    seen = written(visit(own), "seen")
    # the k-th score so far gives the distance that still matters
    q_norm = queries.select(F.col("id").alias("q"), norm.cast("double").alias("qq"))
    kth = seen.where(F.col("rank") == k).select("q", F.col("score").alias("kth"))
    near = F.sqrt(F.greatest(F.col("qq") + most - 2 * F.col("kth"), F.lit(0.0)))
    bound = F.when(F.col("kth").isNotNull(), near).otherwise(float("inf"))  # fewer than k seen: nothing is ruled out
    bounds = q_norm.join(kth, "q", "left").select("q", bound.alias("bound"))
    rest = (reach.join(bounds, "q").join(ranges, "pivot")
            .where(gap <= F.col("bound") * (1 + SLACK) + SLACK)
            .join(own.select("annulus", "q"), ["annulus", "q"], "left_anti").select("annulus", "q", "d", "bound"))
    found = seen.select("q", "id", "score").unionByName(visit(rest).select("q", "id", "score"))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
