"""Helpers shared by the operators: written tables, connected components and
sorted-group streaming inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a reread, never a recomputation.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small by bytes, as rows may be very long texts."""
    if spark.conf.get("quarry.arrow.bounded", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        spark.conf.set("quarry.arrow.bounded", "true")


#: Bits of the filter of ``hashed_in``: at most 65,536 rows of 64 bits are sent, whatever the input's size.
FILTER_BITS = 22


def hashed_in(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose hash ``column`` (long) may be one of ``wanted``: all that are, and few others.

    It spares other rows a shuffle. The filter is a table of bits of fixed size that Spark sends to the rows; when
    more is wanted than it can tell apart it lets every row pass, and the join behind it decides alone."""
    place = F.pmod(F.col(column), F.lit(1 << FILTER_BITS))
    bit = F.pmod(place, F.lit(64)).cast("int")
    bits = (wanted.select(F.shiftright(place, 6).cast("int").alias("__word"), bit.alias("__bit"))
            .groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits")))
    told = df.withColumn("__word", F.shiftright(place, 6).cast("int")).join(F.broadcast(bits), "__word")
    hit = F.call_function("shiftright", F.col("__bits"), bit)
    return told.where(hit.bitwiseAND(F.lit(1)) == 1).select(*df.columns)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of the graph with edges (a, b).

    Alternating large-star and small-star steps; every round is two grouped
    minima and two joins on a node, and its edges are written to the shared
    folder. Returns (node, component) with the smallest node of each component,
    for nodes that have at least one link to another node. NULL ends and loops
    are ignored; an empty input gives an empty result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    before = _signature(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("u"), F.col("v"), F.col("m"))
        edges = written(small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                                       F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
                                     .alias("e")).select("e.*").where("u <> v").distinct(), "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    label = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return label.unionByName(label.select(F.col("component").alias("node"), "component").distinct())


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most_bytes`` of one text column (one row at least)."""
    arr = batch.column(column)
    if not len(arr):
        return
    sizes = np.nan_to_num(pa.compute.binary_length(arr).to_numpy(zero_copy_only=False).astype(float))
    part = (np.cumsum(sizes) // most_bytes).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(arr)]):
        yield batch.slice(int(lo), int(hi - lo))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Column dicts of runs of whole groups from batches sorted by ``keys``.

    A run holds one or more complete groups; ``run["__start"]`` gives where each
    begins. Only the group that is still open is carried from batch to batch.
    """
    held: dict | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        if held is not None:
            cols = {n: np.concatenate([held[n], cols[n]]) for n in cols}
        new = np.zeros(len(cols[keys[0]]), bool)
        new[0] = True
        for k in keys:
            new[1:] |= cols[k][1:] != cols[k][:-1]
        start = np.flatnonzero(new)
        last = start[-1]
        if last:
            yield {n: c[:last] for n, c in cols.items()} | {"__start": start[:-1]}
        held = {n: c[last:].copy() for n, c in cols.items()}
    if held is not None:
        yield held | {"__start": np.zeros(1, np.int64)}
