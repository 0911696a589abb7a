"""Near-duplicate vectors by spherical-cap filters from random product codes.

The filter directions are all sums of one code word per block of coordinates,
so there are ``words ** blocks`` of them without any being stored. List
decoding finds, for each vector, every direction whose inner product with it
exceeds a threshold: the scores of each half of the blocks are combined and
sorted once, and for each left half the right halves above the remainder are a
prefix. Two vectors are candidates when they share a filter; the candidates'
cosine is then computed in double precision.

Equal vectors are joined first and stand for one another. The candidates of a
very common filter are paired by a join, which Spark may split.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import components, written

#: Filters that a vector exceeds on average, and the number that it takes at least (its best ones); with codes of more
#: than FULL_WORDS words (20,000 vectors), so many times more as there are words, as a higher threshold has less recall.
MEAN_FILTERS, LEAST_FILTERS, FULL_WORDS = 48, 32, 34
BLOCKS = 4


class ProductCode:
    """``words`` random unit words for each of four blocks of the coordinates."""

    def __init__(self, width: int, words: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        rotation, _ = np.linalg.qr(rng.standard_normal((width, width)))
        self.parts = np.array_split(rotation, BLOCKS, axis=1) if width >= BLOCKS else [rotation] * BLOCKS
        self.code = []
        for p in self.parts:
            c = rng.standard_normal((p.shape[1], words))
            self.code.append(c / np.linalg.norm(c, axis=0) / math.sqrt(BLOCKS))
        self.words = words
        sample = rng.standard_normal((512, width))
        sample /= np.linalg.norm(sample, axis=1)[:, None]
        more = max(1.0, words / FULL_WORDS)
        self.least = round(LEAST_FILTERS * more)
        #: exceeded by a random direction for MEAN_FILTERS (times ``more``) of all filters, on average
        self.threshold = self._kept(sample, round(MEAN_FILTERS * more) * len(sample))

    def _kept(self, x: np.ndarray, n: int) -> float:
        """The n-th greatest of the scores of all filters with all rows, without making the scores."""
        size = self.words ** 2
        # the n greatest sums of two sorted lists are among those at places i, j with (i + 1) * (j + 1) <= n
        counts = np.minimum(n // np.arange(1, min(n, size) + 1), size)
        i = np.repeat(np.arange(len(counts)), counts)
        j = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
        best = np.zeros(0)
        for row in x:
            left, right = (-np.sort(-h[0]) for h in self._halves(row[None]))
            scores = left[i] + right[j]
            if len(best) == n:
                scores = scores[scores > best[0]]
            best = np.concatenate([best, scores])
            if len(best) > n:
                best = np.partition(best, len(best) - n)[-n:]
        return float(best.min())

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = [x @ p @ c for p, c in zip(self.parts, self.code)]
        n = len(x)
        return (s[0][:, :, None] + s[1][:, None, :]).reshape(n, -1), (s[2][:, :, None] + s[3][:, None, :]).reshape(n, -1)

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Numbers of all filters above the threshold for each unit row, and of its best ``least``."""
        left, right = self._halves(x)
        half = left.shape[1]
        out = []
        for a, b in zip(left, right):
            ob = np.argsort(-b)
            b = b[ob]
            # the best left halves first; those whose best partner is too low are out
            oa = np.argsort(-a)
            bound = self.threshold
            count = np.searchsorted(-b, a[oa] - bound, "right")
            if count.sum() < self.least:  # lower the bound to the score of the last one wanted
                top = (a[oa[:self.least], None] + b[:self.least]).ravel()
                bound = np.partition(top, -min(self.least, len(top)))[-min(self.least, len(top))]
                count = np.searchsorted(-b, a[oa] - bound + 1e-12, "right")
            use = np.flatnonzero(count)
            count = count[use]
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            out.append(np.repeat(oa[use], count).astype(np.int64) * half + ob[place])
        return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    least: float = 0.95) -> DataFrame:
    """Links between vectors of cosine ``least`` and more, and their components.

    Returns ``vec_id, n_links, component_id, kept``, one row per input row; ids
    are unique and not NULL. Vectors that are NULL, empty, zero or hold a NULL
    or non-finite component link with nothing. Vectors of other lengths than
    one another do not link. Equal vectors always link (their cosine is 1). A
    link is never reported below ``least``; found are those pairs that share a
    filter (recall above 0.99, measured in the tests). Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    x = F.col(vec_col)
    good = (x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
            & F.exists(x, lambda c: c != 0))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(good, x).alias("v"))
    classes = written(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("d"), F.count("*").alias("m")),
                      "classes")
    widths = [r["w"] for r in classes.select(F.size("v").alias("w")).distinct().collect()]
    found = None
    for width in widths:
        same = classes.where(F.size("v") == width)
        part = _links(spark, same, width, same.count(), least)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, ma long, mb long")
    links = written(found, "links")
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("d"), F.col("mb").alias("k")),
                                          F.struct(F.col("b").alias("d"), F.col("ma").alias("k")))).alias("e")).select("e.*")
    degree = ends.groupBy("d").agg(F.sum("k").alias("k"))
    groups = components(links, "a", "b")
    label = (classes.select("v", "d", "m").join(degree, "d", "left")
             .join(groups.withColumnRenamed("node", "d"), "d", "left")
             .select("v", (F.coalesce("k", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                     F.coalesce("component", "d").alias("component_id")))
    out = rows.join(label, "v", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "id").alias("component_id"),
                      (F.col("id") == F.coalesce("component_id", "id")).alias("kept"))


def _unit(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    m = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    scaled = m / np.abs(m).max(axis=1, keepdims=True)  # keeps squares of tiny and huge components in range
    return m, scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _links(spark, classes: DataFrame, width: int, n: int, least: float) -> DataFrame:
    """(a, b, ma, mb): linked classes of one width, by smallest id, with their sizes."""
    words = max(8, math.ceil((64 * max(n, 1)) ** (1 / BLOCKS)))
    shared = spark.sparkContext.broadcast(ProductCode(width, words))

    def decode(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                filters = shared.value.decode(_unit(part.column("v"), width)[1])
                sizes = [len(f) for f in filters]
                yield pa.RecordBatch.from_pydict({
                    "f": pa.array(np.concatenate(filters), pa.int64()),
                    "d": pa.array(np.repeat(part.column("d").to_numpy(), sizes), pa.int64())})

    keys = written(classes.select("d", "v").mapInArrow(decode, "f long, d long"), "filters")
    pairs = (keys.withColumnRenamed("d", "a").join(keys.withColumnRenamed("d", "b"), "f").where("a < b")
             .select("a", "b").distinct())
    side = classes.select("d", "m", F.transform("v", lambda c: c.cast("double")).alias("v"))
    full = (pairs.join(side.select(F.col("d").alias("a"), F.col("m").alias("ma"), F.col("v").alias("va")), "a")
            .join(side.select(F.col("d").alias("b"), F.col("m").alias("mb"), F.col("v").alias("vb")), "b"))

    def verify(batches):
        for b in batches:
            if b.num_rows:
                va, vb = _unit(b.column("va"), width)[1], _unit(b.column("vb"), width)[1]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("a", "b", "ma", "mb")],
                                                 names=["a", "b", "ma", "mb"]).filter(
                    pa.array(np.einsum("ij,ij->i", va, vb) >= least))

    return full.select("a", "b", "ma", "mb", "va", "vb").mapInArrow(verify, "a long, b long, ma long, mb long")
