"""Hard negatives by a vertical scan with bounds on what is left (BOND).

Vectors lie in blocks, column by column, with the least and the greatest value of
each dimension. A scan for one anchor adds up the products of a few dimensions at
a time, those of the anchor's greatest magnitude first. After each step the
remaining dimensions can add no more than their extremes allow, so every
candidate's score lies between two bounds. A candidate leaves the bitmap when
these miss all windows of scores that are asked for, or when a window already has
enough better ones. What is left at the end has its exact score.

First the window of an anchor is open above its k-th best score inside its own
block, which finds its positives among the rows of its label. Then each positive
gives a window for the rows of other labels. Pairs of a block of anchors and a
block of rows whose bounds miss every window are never made.

Rows are dealt to blocks by ranges of label and leading dimension, so labels are
mostly apart and a label of any size is split. Scores are sums of integers and
exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import written

#: Rows and anchors of a block, and blocks whose bounds are compared at once; they bound the memory of a work item.
BLOCK_ROWS, BLOCK_ANCHORS, BUNDLE = 8192, 256, 256
#: Dimensions after which the bitmap is renewed; then after each doubling.
FIRST_STEP = 4
FAR = 1 << 62

BLOCK = ("block long, label_low long, label_high long, low array<long>, high array<long>, "
         "window_low long, window_high long, ids binary, labels binary, v binary, w binary, anchors binary")


def prepared(vectors: DataFrame, id_col: str, label, vec_col: str, anchor, scale: int = 256) -> DataFrame:
    """(id, label, v, anchor): rows that take part, with integer components floor(scale * x).

    ``label`` and ``anchor`` are columns of ``vectors``.
    Left out are NULL ids, labels and vectors and vectors with NULL or non-finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                          F.col(vec_col).alias("x"), anchor.alias("anchor"))
    return (rows.where("id is not null and label is not null").where(F.coalesce(_finite(F.col("x")), F.lit(False)))
            .select("id", "label", F.transform("x", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"),
                    F.coalesce("anchor", F.lit(False)).alias("anchor")))


def _finite(x):
    return x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as an integer matrix; shorter rows are filled with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(column).to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _block(number: int, part: dict) -> dict:
    v, w = part["v"], part["w"]
    return {"block": number, "label_low": part["label"].min(), "label_high": part["label"].max(),
            "low": v.min(0), "high": v.max(0), "window_low": w[:, ::2].min(initial=FAR), "window_high": w[:, 1::2].max(initial=-FAR),
            "ids": part["id"].tobytes(), "labels": part["label"].tobytes(), "v": np.ascontiguousarray(v.T).tobytes(),
            "w": w.tobytes(), "anchors": part["anchor"].tobytes()}


def blocks(rows: DataFrame, most: int, width: int, windows: int) -> DataFrame:
    """Blocks of at most ``most`` rows (id, label, v, w, anchor), of one label unless it has few rows.

    ``v`` is stored dimension by dimension, ``w`` holds ``windows`` pairs of bounds a row."""
    size = F.transform("v", lambda c: F.abs(c))
    lead = F.array_position(size, F.array_max(size))
    order = ["label", "lead", "salt", "id"]
    dealt = rows.select("id", "label", "v", "w", "anchor", F.coalesce(lead, F.lit(0)).alias("lead"), F.xxhash64("id").alias("salt"))

    def cut(batches):
        at, held = 0, None
        base = TaskContext.get().partitionId() << 32

        def full(batches):
            nonlocal held
            for b in batches:
                part = {"id": b.column("id").to_numpy(), "label": b.column("label").to_numpy(),
                        "v": _matrix(b.column("v"), width), "w": _matrix(b.column("w"), 2 * windows),
                        "anchor": b.column("anchor").to_numpy(zero_copy_only=False).astype(np.uint8)}
                held = part if held is None else {k: np.concatenate([held[k], part[k]]) for k in part}
                while True:
                    n = len(held["id"])
                    # a block ends when it is full, or before another label once it has an eighth of its rows
                    new = np.flatnonzero(np.diff(held["label"][:most])) + 1
                    new = new[new >= most // 8]
                    end = int(new[0]) if len(new) else most
                    if n <= end:
                        break
                    yield {k: x[:end] for k, x in held.items()}
                    held = {k: x[end:] for k, x in held.items()}
            if held is not None and len(held["id"]):
                yield held

        for part in full(batches):
            yield pa.RecordBatch.from_pylist([_block(base + at, part)], schema=BLOCK_ARROW)
            at += 1

    return dealt.repartitionByRange(*order).sortWithinPartitions(*order, "v").drop("lead", "salt").mapInArrow(cut, BLOCK)


BLOCK_ARROW = pa.schema([
    *((n, pa.int64()) for n in ("block", "label_low", "label_high")),
    *((n, pa.list_(pa.int64())) for n in ("low", "high")), ("window_low", pa.int64()), ("window_high", pa.int64()),
    *((n, pa.binary()) for n in ("ids", "labels", "v", "w", "anchors"))])


def _ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def extremes(q_low, q_high, low, high) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest of the products of two intervals."""
    corners = np.stack([q_low * low, q_low * high, q_high * low, q_high * high])
    return corners.min(0), corners.max(0)


def scan(q: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, alive: np.ndarray,
         windows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of all candidates that may be among the ``k`` best of a window [lo, hi].

    ``columns`` has a row for each dimension, ``alive`` is the bitmap of candidates."""
    order = np.argsort(-np.abs(q), kind="stable")
    least, most = extremes(q, q, low, high)
    rest_least = np.r_[np.cumsum(least[order][::-1])[::-1], 0]
    rest_most = np.r_[np.cumsum(most[order][::-1])[::-1], 0]
    at = np.flatnonzero(alive)
    score = np.zeros(len(at), columns.dtype)
    done, step = 0, 0
    while True:
        lower, upper = score + rest_least[done], score + rest_most[done]
        keep = np.zeros(len(at), bool)
        for lo, hi in windows:
            floor = lo
            sure = lower[(lower >= lo) & (upper <= hi)]
            if len(sure) >= k:
                floor = max(lo, int(np.partition(sure, len(sure) - k)[len(sure) - k]))
            keep |= (upper >= floor) & (lower <= hi)
        if not keep.all():
            at, score = at[keep], score[keep]
        if done == len(q) or not len(at):
            return at, score.astype(np.int64)
        step = step or FIRST_STEP
        dims = order[done:done + step]
        values = columns[dims] if len(at) == columns.shape[1] else columns[np.ix_(dims, at)]
        score = score + q[dims].astype(columns.dtype) @ values
        done += len(dims)
        step = done  # twice as many dimensions each time


def _exact(q: np.ndarray, columns: np.ndarray, width: int) -> np.ndarray:
    """Columns as doubles where every sum of products is exact in them, as they are elsewhere."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(columns).max(initial=0)) * width
    return columns.astype(float) if most < 2.0 ** 52 else columns


def pairs(anchors: DataFrame, table: DataFrame, n_blocks: int, same_label: bool) -> DataFrame:
    """(q, block): blocks of anchors and of rows whose scores may lie inside a window, by the bounds of both."""
    lanes = -(-n_blocks // BUNDLE)
    boxes = (table.select(F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane"),
                          F.struct("block", "label_low", "label_high", "low", "high").alias("box"))
             .groupBy("lane").agg(F.collect_list("box").alias("boxes")))
    asked = anchors.select(F.col("block").alias("q"), F.col("label_low").alias("ll"), F.col("label_high").alias("lh"),
                           F.col("low").alias("ql"), F.col("high").alias("qh"), "window_low", "window_high",
                           F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))

    def meet(batches):
        for b in batches:
            for r in b.to_pylist():
                box = r["boxes"]
                least, most = (x.sum(1) for x in extremes(
                    np.array(r["ql"], np.int64), np.array(r["qh"], np.int64),
                    np.array([x["low"] for x in box], np.int64), np.array([x["high"] for x in box], np.int64)))
                ok = (most >= r["window_low"]) & (least <= r["window_high"])
                if same_label:
                    ok &= np.array([x["label_low"] <= r["lh"] and x["label_high"] >= r["ll"] for x in box])
                number = np.array([x["block"] for x in box], np.int64)[ok]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), r["q"])), pa.array(number)], names=["q", "block"])

    return asked.join(boxes, "lane").mapInArrow(meet, "q long, block long")


def search(anchors: DataFrame, table: DataFrame, n_blocks: int, width: int, windows: int, k: int, same_label: bool) -> DataFrame:
    """(anchor, place, id, score): the ``k`` best candidates of each block for each window (by its place) of each anchor.

    Candidates are rows of the same label, or of the others, and never of the anchor's id."""
    wanted = pairs(anchors, table, n_blocks, same_label)
    asked = anchors.select(F.col("block").alias("q"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "labels", "v", "w")))
    # anchors are small beside a block: they go to the blocks
    work = wanted.join(asked, "q").join(table.select("block", "low", "high", "ids", "labels", "v"), "block").drop("q", "block")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(n)[i].as_py() for n in b.schema.names}
                qid, qlabel = _ints(r["q_ids"]), _ints(r["q_labels"])
                q = _ints(r["q_v"]).reshape(width, -1).T
                w = _ints(r["q_w"]).reshape(len(qid), windows, 2)
                ids, labels, raw = _ints(r["ids"]), _ints(r["labels"]), _ints(r["v"]).reshape(width, -1)
                columns = _exact(q, raw, width)
                low, high = np.array(r["low"], np.int64), np.array(r["high"], np.int64)
                out = [], [], [], []
                for j in range(len(qid)):
                    ask = w[j][w[j, :, 0] <= w[j, :, 1]]
                    same = labels == qlabel[j]
                    alive = (same if same_label else ~same) & (ids != qid[j])
                    if not len(ask) or not alive.any():
                        continue
                    at, score = scan(q[j], columns, low, high, alive, ask, k)
                    for place in range(windows):
                        lo, hi = w[j, place]
                        inside = np.flatnonzero((score >= lo) & (score <= hi))
                        best = inside[np.lexsort((ids[at[inside]], -score[inside]))[:k]]
                        for column, x in zip(out, (np.full(len(best), qid[j]), np.full(len(best), place), ids[at[best]], score[best])):
                            column.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out],
                                                     names=["anchor", "place", "id", "score"])

    return work.mapInArrow(run, "anchor long, place long, id long, score long")


def own_bounds(table: DataFrame, width: int, k: int) -> DataFrame:
    """(id, label, v, bound) of each anchor: its k-th best score among the rows of its label in its own block."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(n)[i].as_py() for n in ("ids", "labels", "v", "anchors", "low", "high")}
                ids, labels = _ints(r["ids"]), _ints(r["labels"])
                raw = _ints(r["v"]).reshape(width, -1)
                chosen = np.flatnonzero(np.frombuffer(r["anchors"], np.uint8))
                if not len(chosen):
                    continue
                columns, bound = _exact(raw, raw, width), []
                low, high = np.array(r["low"], np.int64), np.array(r["high"], np.int64)
                for j in chosen:
                    alive = (labels == labels[j]) & (ids != ids[j])
                    _, score = scan(raw[:, j], columns, low, high, alive, np.array([[-FAR, FAR]]), k)
                    bound.append(int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else -FAR)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[chosen]), pa.array(labels[chosen]), pa.array(list(raw[:, chosen].T), pa.list_(pa.int64())),
                     pa.array(bound, pa.int64())], names=["id", "label", "v", "bound"])

    return table.mapInArrow(run, "id long, label long, v array<long>, bound long")


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100),
         most: tuple[int, int] = (100, 100)) -> DataFrame:
    """Hard negatives of each anchor and positive, by exact integer inner product.

    ``rows`` holds ``id, label, v`` (array of long) and ``anchor`` (boolean), see ``prepared``; other columns are
    ignored. An anchor's positives are the first rows of its label, its negatives for one of them those of other labels
    whose score lies between the fractions ``least`` and ``most`` of the positive's. Higher scores come first, ties by
    smaller id; with fewer rows, all are returned, and none for a window that is empty (as for negative scores).
    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Vectors of different length are compared as if filled up with zeros, empty ones score 0. Ids are unique; rows that
    repeat an id are candidates of their own, except for the anchor of that id, and anchors that repeat one are searched
    for once, as the first by label and vector. Sums of the products' magnitudes must stay under 2^62. An empty table gives
    an empty result.
    """
    spark = rows.sparkSession
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = written(rows.select("id", "label", "v", "anchor", F.array().cast("array<long>").alias("w")), "rows")
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], schema)
    width = max(width, 1)
    table = written(blocks(rows, BLOCK_ROWS, width, 0), "blocks")
    n_blocks = table.select("block").count()

    first = own_bounds(table, width, positives).groupBy("id").agg(F.min(F.struct("label", "v", "bound")).alias("a"))
    first = written(first.select("id", "a.label", "a.v", "a.bound"), "anchors").withColumn("anchor", F.lit(True))
    asked = written(blocks(first.withColumn("w", F.array("bound", F.lit(FAR))), BLOCK_ANCHORS, width, 1), "asked")
    order = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    found = search(asked, table, n_blocks, width, 1, positives, True)
    found = written(found.withColumn("r", order).where(F.col("r") <= positives), "positives")

    # a window for each positive: the integers between the two fractions of its score
    (a, b), (c, d) = least, most
    each = found.selectExpr("anchor", "r", f"(score * {a} + pmod(-score * {a}, {b})) div {b} as lo",
                            f"(score * {c} - pmod(score * {c}, {d})) div {d} as hi")
    given = each.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("r", "lo", "hi"))).alias("given"))
    padded = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.when(
        i <= F.size("given"), F.array(F.get("given", i - 1)["lo"], F.get("given", i - 1)["hi"]))
        .otherwise(F.array(F.lit(FAR), F.lit(-FAR)))))
    second = first.join(given.withColumnRenamed("anchor", "id"), "id").withColumn("w", padded)
    asked = written(blocks(second, BLOCK_ANCHORS, width, positives), "asked")
    other = search(asked, table, n_blocks, width, positives, negatives, False)
    order = F.row_number().over(W.partitionBy("anchor", "place").orderBy(F.desc("score"), "id"))
    other = other.withColumn("rank", order).where(F.col("rank") <= negatives).withColumn("r", (F.col("place") + 1).cast("int"))
    by = found.select("anchor", "r", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return other.join(by, ["anchor", "r"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
