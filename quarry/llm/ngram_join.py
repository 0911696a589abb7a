"""Exact Jaccard join on word n-grams as a blocked sparse matrix product.

Rows of the incidence matrix are distinct n-gram sets, columns are n-grams. The
columns are put into one global order, rarest first (by a fixed-size count
sketch over all documents), and cut into two column blocks per row:

1. the *leading block*, the first ``n - ceil(t n) + 1`` n-grams of a row. Two
   rows that reach similarity ``t`` share at least one of them. The product of
   the leading blocks accumulates overlap counts per pair of rows; a pair goes
   when its counts plus all that may still come stay below the overlap that the
   two sizes ask for.
2. the *rest*, multiplied only for pairs that are left, which gives the exact
   overlap.

Equal sets are one row. Groups of near copies are joined in two steps: every
row is first multiplied with the row that shares most n-grams in each column
(linear in the column's length), and only rows that these links leave in
different components meet in the pairwise product.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quarry.llm.common import components, hashed_in, slices, sorted_groups, written
from quarry.llm.shingles import mix, row_shingles, shingle_sets, word_hashes

_U = np.uint64

#: Counters of the frequency sketch: 8 MB whatever the input's size. They are added up in a tree: the chunks of the map
#: tasks in lanes, then the lanes.
SKETCH_BITS = 20
SKETCH_CHUNKS, SKETCH_LANES = 64, 64
#: Bits of a set's parity signature: the signatures of two sets differ in no more bits than the sets in elements.
#: Columns with many entries, as near copies make them, carry it into the product; other pairs are compared by it after.
SIGNATURE_BITS = 2048
SIGNATURE_WORDS, MANY_ENTRIES = SIGNATURE_BITS // 64, 64


#: Bytes of text whose words are hashed at once: the arrays made on the way stay in the processor's cache.
HASHED_BYTES = 1 << 18


def _words(batches) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in slices(batch, "text", HASHED_BYTES):
            yield part.column("doc_id"), *word_hashes(part.column("text"))


def frequency_sketch(docs: DataFrame, size: int) -> np.ndarray:
    """How often each bucket of n-grams occurs over all documents, ``2 ** SKETCH_BITS`` counters. Repeats in a document
    count too: it spares sorting every set for what only orders the columns."""
    width = 1 << (SKETCH_BITS - SKETCH_CHUNKS.bit_length() + 1)

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        held, n = [], 0
        for _, words, first in _words(batches):
            held.append((row_shingles(words, first, size)[0] >> _U(64 - SKETCH_BITS)).astype(np.int64))
            n += len(held[-1])
            if n > len(total):
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, n = [], 0
        if n:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        if total.any():
            lane = TaskContext.get().partitionId() % SKETCH_LANES
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array(range(SKETCH_CHUNKS), pa.int32()), "lane": pa.array([lane] * SKETCH_CHUNKS, pa.int32()),
                "counts": pa.array([zlib.compress(total[i * width:(i + 1) * width].tobytes(), 1)
                                    for i in range(SKETCH_CHUNKS)], pa.binary())})

    def add(batches):
        at, total = None, None
        for batch in batches:  # sorted by chunk and lane; only a running sum is held
            for chunk, lane, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "lane", "counts"))):
                part = np.frombuffer(zlib.decompress(counts), np.int64)
                if (chunk, lane) == at:
                    total = total + part
                    continue
                if at is not None:
                    yield summed(at, total)
                at, total = (chunk, lane), part
        if at is not None:
            yield summed(at, total)

    def summed(at, total):
        return pa.RecordBatch.from_pydict({"chunk": pa.array(at[:1], pa.int32()), "lane": pa.array(at[1:], pa.int32()),
                                           "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "chunk int, lane int, counts binary"
    lanes = (docs.select("doc_id", "text").mapInArrow(count, schema)
             .repartition("chunk", "lane").sortWithinPartitions("chunk", "lane").mapInArrow(add, schema))
    rows = (lanes.withColumn("lane", F.lit(0)).repartition("chunk").sortWithinPartitions("chunk")
            .mapInArrow(add, schema).collect())
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows:
        out[r["chunk"] * width:(r["chunk"] + 1) * width] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out


def leading_length(n: int, num: int, den: int) -> int:
    """Length of the leading block of a set of ``n`` for similarity ``num / den``."""
    return n - -(-n * num // den) + 1 if n else 0


def incidence(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, k1, k2, sig, lead): set size, a 128-bit key of the set, its parity signature and leading block."""
    level = np.frompyfunc(int.bit_length, 1, 1)(frequency_sketch(docs, size)).astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def rows(batches):
        level = shared.value
        for ids, words, first in _words(batches):
            s, start = shingle_sets(words, first, size)
            n = np.diff(start)
            row = np.repeat(np.arange(len(n)), n)
            bits = np.bincount(row * SIGNATURE_BITS + ((s >> _U(7)).astype(np.int64) & (SIGNATURE_BITS - 1)),
                               minlength=len(n) * SIGNATURE_BITS) & 1
            keys = (np.r_[_U(0), np.cumsum(mix(x), dtype=np.uint64)] for x in (s, s ^ _U(0x5BF03635)))
            k1, k2 = ((x[start[1:]] - x[start[:-1]]).astype(np.int64) for x in keys)
            # the sets are sorted: by level alone, as it is stable, the order is that of level and n-gram
            rank = level[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)]
            lead = [s[a:b][np.argsort(rank[a:b], kind="stable")[:leading_length(b - a, num, den)]]
                    for a, b in zip(start[:-1].tolist(), start[1:].tolist())]
            ends = np.r_[0, np.cumsum([len(x) for x in lead])].astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids.cast(pa.int64()), "n": pa.array(n, pa.int64()), "k1": pa.array(k1, pa.int64()),
                "k2": pa.array(k2, pa.int64()),
                "sig": pa.ListArray.from_arrays(np.arange(0, len(bits) // 64 + 1, SIGNATURE_WORDS, dtype=np.int32),
                                                pa.array(np.packbits(bits.astype(np.uint8)).view(np.int64))),
                "lead": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lead).view(np.int64) if lead else [], pa.int64()))})

    return docs.select("doc_id", "text").mapInArrow(
        rows, "doc_id long, n long, k1 long, k2 long, sig array<long>, lead array<long>")


def overlaps(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Exact overlap of the sets of each pair (a, b): the product of the whole rows."""
    pairs = written(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("d")).select(F.xxhash64("d").alias("h"))

    def rows(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                packed = [zlib.compress(t.encode(), 1) if t else b"" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"d": part.column("doc_id").cast(pa.int64()),
                                                  "t": pa.array(packed, pa.binary())})

    # packed whole texts are a fraction of the rows' n-grams, which both ends make anew
    whole = hashed_in(docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("long")).alias("h")), "h", wanted).mapInArrow(
        rows, "d long, t binary")
    left = pairs.join(whole.select(F.col("d").alias("a"), F.col("t").alias("ta")), "a")
    both = left.join(whole.select(F.col("d").alias("b"), F.col("t").alias("tb")), "b")

    def multiply(batches):
        def sets(column):
            texts = pa.array([zlib.decompress(x).decode() if x else "" for x in column.to_pylist()], pa.large_string())
            s, start = shingle_sets(*word_hashes(texts), size)
            return [s[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist())]

        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                part = batch.slice(lo, 32)
                common = [len(np.intersect1d(x, y, assume_unique=True))
                          for x, y in zip(sets(part.column("ta")), sets(part.column("tb")))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("a", "b", "na", "nb")),
                                                  pa.array(common, pa.int64())], names=["a", "b", "na", "nb", "common"])

    return both.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(
        multiply, "a long, b long, na long, nb long, common long")


def _linked(docs, pairs, size, num, den) -> DataFrame:
    return (overlaps(docs, pairs, size)
            .where(F.col("common") * den >= (F.col("na") + F.col("nb") - F.col("common")) * num).select("a", "b"))


def _shared_columns(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Product of the leading blocks: a row for each column that two rows of different components share."""
    a, b = (entries.select("s", F.col("d").alias(x), F.col("n").alias(f"n{x}"), F.col("i").alias(f"i{x}"),
                           F.col("c").alias(f"c{x}")) for x in "ab")
    need = F.ceil((F.col("na") + F.col("nb")) * num / (num + den))
    # the overlap that two sizes ask for leaves a shorter leading block for the pair, and the least for the smaller set
    a = a.where(F.col("ia") <= F.col("na") - F.ceil(2 * F.col("na") * num / (num + den)))
    return (a.join(b, "s").where("ca <> cb and (na < nb or na = nb and a < b)")
            .where(F.col("na") * den >= F.col("nb") * num)
            .where((F.col("ia") <= F.col("na") - need) & (F.col("ib") <= F.col("nb") - need))
            .select("a", "b", "na", "nb", "ia", "ib"))


def _shared_long_columns(entries: DataFrame, num: int, den: int) -> DataFrame:
    """The same for columns with many entries, which carry the signatures ``g0``, ``g1``, ...: pairs whose signatures
    differ too much are left out. All pairs of a column are compared a tile at a time; only those that pass have a row."""
    tile = 512

    def pairs_of(run, lo, hi):
        d, n, i, c = (run[x][lo:hi] for x in ("d", "n", "i", "c"))
        sig = [run[f"g{j}"][lo:hi].view(np.uint64) for j in range(SIGNATURE_WORDS)]  # signed ones count without their sign
        for x in range(0, hi - lo, tile):
            xs = slice(x, min(x + tile, hi - lo))
            for y in range(x, hi - lo, tile):  # sorted by size and id: the smaller set comes first
                ys = slice(y, min(y + tile, hi - lo))
                na, nb = n[xs, None], n[None, ys]
                need = -(-(na + nb) * num // (num + den))
                keep = ((c[xs, None] != c[None, ys]) & (na * den >= nb * num)
                        & (i[xs, None] <= na - need) & (i[None, ys] <= nb - need))
                if x == y:
                    keep &= np.triu(np.ones(keep.shape, bool), 1)
                if not keep.any():
                    continue
                differ = np.zeros(keep.shape, np.int64)
                for g in sig:
                    differ += np.bitwise_count(g[xs, None] ^ g[None, ys])
                p, q = np.nonzero(keep & (differ <= na + nb - 2 * need))
                p, q = p + x, q + y
                if len(p):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, pa.int64()) for v in (d[p], d[q], n[p], n[q])]
                        + [pa.array(v, pa.int32()) for v in (i[p], i[q])], names=["a", "b", "na", "nb", "ia", "ib"])

    def rows(batches):
        for run in sorted_groups(batches, ["s"]):
            ends = np.r_[run["__start"], len(run["s"])].tolist()
            for lo, hi in zip(ends[:-1], ends[1:]):
                yield from pairs_of(run, lo, hi)

    spark = entries.sparkSession
    # by number: their bytes are few, by which the columns would be put into few tasks
    dealt = entries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s").sortWithinPartitions("s", "n", "d")
    return (dealt.select("s", "d", "n", "i", "c", *(f"g{j}" for j in range(SIGNATURE_WORDS)))
            .mapInArrow(rows, "a long, b long, na long, nb long, ia int, ib int"))


def jaccard_groups(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Groups of documents linked by n-gram Jaccard similarity of at least ``num / den``.

    ``docs`` has ``doc_id`` (unique) and ``text``; other columns, also of clashing
    names, are ignored, and rows without doc_id have no row in the result. A set holds the distinct runs of ``size``
    words; a text with fewer words is one run; NULL, empty and blank texts have
    the empty set and link with nothing. Returns ``doc_id``, ``n_shingles`` and
    ``component_id``, the smallest doc_id reachable by links. Equal texts give
    equal sets and always link. An empty table gives an empty result.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    sets = written(incidence(docs, size, num, den), "sets")
    rows = written(sets.where("n > 0").groupBy("k1", "k2", "n").agg(
        F.min("doc_id").alias("d"), F.min_by("lead", "doc_id").alias("lead"), F.min("sig").alias("sig")), "rows")

    # the leading block in coordinate form; columns with one entry multiply with nothing
    entries = rows.select("d", "n", F.posexplode("lead").alias("i", "s"))
    entries = written(entries.withColumn("df", F.count("*").over(Window.partitionBy("s"))).where("df > 1"), "entries")

    # step 1: each row with the row that shares most columns
    weight = entries.groupBy("d").agg((F.count("*") / F.max(F.col("n"))).alias("w"))
    hub = entries.join(weight, "d").groupBy("s").agg(
        F.max(F.struct("w", (-F.col("d")).alias("m"), F.col("n").alias("nb"))).alias("h"))
    near = (entries.join(hub.select("s", (-F.col("h.m")).alias("b"), F.col("h.nb").alias("nb")), "s")
            .where((F.col("d") != F.col("b")) & (F.least("n", "nb") * den >= F.greatest("n", "nb") * num))
            .where(F.col("i") <= F.col("n") - F.ceil((F.col("n") + F.col("nb")) * num / (num + den)))
            .groupBy(F.col("d").alias("a"), "b", F.col("n").alias("na"), "nb").agg(F.count("*").alias("c"))
            .where(F.col("c") * den * 4 >= F.col("na") * (den - num)).select("a", "b", "na", "nb"))
    first = written(_linked(docs, near, size, num, den), "links")
    merged = written(components(first, "a", "b"), "merged")

    # step 2: the pairwise product of what is still apart
    apart = (entries.select("s", "d", "n", "i").join(merged.withColumnRenamed("node", "d"), "d", "left")
             .withColumn("c", F.coalesce("component", "d")).drop("component"))
    mixed = (apart.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k"))
             .where("lo < hi").select("s", (F.col("k") > MANY_ENTRIES).alias("many")))
    apart = written(apart.join(mixed, "s"), "apart")
    long = apart.where("many").join(rows.select("d", *(F.col("sig")[j].alias(f"g{j}") for j in range(SIGNATURE_WORDS))), "d")
    pairs = _shared_columns(apart.where("not many"), num, den).unionByName(_shared_long_columns(long, num, den))
    need = F.ceil((F.col("na") + F.col("nb")) * num / (num + den))
    pairs = (pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("ia").alias("ia"),
                                                     F.max("ib").alias("ib"))
             .where(F.col("c") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) - 1 >= need)
             .select("a", "b", "na", "nb"))
    for x in "ab":
        pairs = pairs.join(rows.select(F.col("d").alias(x), F.col("sig").alias(f"sig{x}")), x)
    differ = sum(F.bit_count(F.col("siga")[j].bitwiseXOR(F.col("sigb")[j])) for j in range(SIGNATURE_WORDS))
    pairs = pairs.where(differ <= F.col("na") + F.col("nb") - 2 * need).select("a", "b", "na", "nb")
    links = written(_linked(docs, pairs, size, num, den), "links")
    groups = written(components(links.unionByName(first), "a", "b"), "groups")

    labels = (rows.select("k1", "k2", "n", "d").join(groups.withColumnRenamed("node", "d"), "d", "left")
              .select("k1", "k2", "n", F.coalesce("component", "d").alias("component")))
    return sets.join(labels, ["k1", "k2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
