"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, up to ``EPOCHS``
times over. An item's virtual finish time is the source's words up to and with
it, divided by the source's target. All items are put into buckets of finish
time, the sums of the buckets give the place of the cut, and only the bucket
that holds the cut is sorted; items up to the cut make the mix, so that every
source has got its share when the budget is used up.

Whole documents leave a gap of up to one document in each source. A source does
not pass its target (finish time 1) to use up what others leave; instead a few
further rounds hand each gap to the next documents of its own queue that fit.

DataFrame operations only. No source is gathered in one task: running sums are
taken inside hash buckets of a source, on top of the sums of earlier buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A document is used at most so many times.
EPOCHS = 3
#: Buckets of finish time, per unit and in all.
TIME_STEPS, TIME_BUCKETS = 4096, 16384
#: Rounds that fill the gaps.
FILL_ROUNDS = 4


def targets(sources: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size`` with ``turn`` (place by code point, NULL last) and ``target``.

    Targets share the total by weight. Those above ``epochs`` times their
    source's size stop there and the excess goes to the others by weight, until
    none is above: sources in order of limit per weight stop one after the
    other, up to the first that the remaining total does not fill.
    """
    place = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("turn"), F.lit(len(weights))) + 1).cast("int"))
    s = (sources.withColumn("turn", F.row_number().over(place) - 1).withColumn("weight", weight.cast("long"))
         .withColumn("limit", F.col("source_size") * epochs))
    order = W.orderBy(F.col("limit") / F.col("weight"), "turn")
    whole = W.partitionBy()
    s = (s.withColumn("k", F.row_number().over(order))
         .withColumn("stopped", F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("limit"))
         .withColumn("open", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
         .withColumn("total", F.sum("source_size").over(whole)))
    s = s.withColumn("level", (F.col("total") - F.col("stopped")) / F.col("open"))
    fits = F.col("limit") >= F.col("level") * F.col("weight")
    s = (s.withColumn("first", F.min(F.when(fits, F.col("k"))).over(whole))
         .withColumn("level", F.max(F.when(F.col("k") == F.col("first"), F.col("level"))).over(whole)))
    target = F.when(F.col("k") < F.col("first"), F.col("limit").cast("double")).otherwise(
        F.col("level") * F.col("weight"))
    return s.select("source", "source_size", "turn", target.alias("target"))


def running_sum(rows: DataFrame, value, name: str) -> DataFrame:
    """``name``: sum of ``value`` over the rows of the same ``turn`` up to this one, by (``key``, ``doc_id``)."""
    # dealt by bucket before anything is grouped, else a join or sum by source would deal whole sources
    rows = rows.withColumn("__v", value).repartition("turn", "bucket")
    sums = rows.groupBy("turn", "bucket").agg(F.sum("__v").alias("__s"))
    earlier = sums.select("turn", "bucket", (F.sum("__s").over(W.partitionBy("turn").orderBy("bucket")) - F.col("__s"))
                          .alias("__before")).repartition("turn", "bucket")
    inside = W.partitionBy("turn", "bucket").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    return (rows.join(earlier, ["turn", "bucket"]).withColumn(name, F.sum("__v").over(inside) + F.col("__before"))
            .drop("__v", "__before"))


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(sized: DataFrame, seed: str = "mix-1", weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """How often each document is used in the mix.

    ``sized`` has ``doc_id``, ``source`` and ``size`` (words); other columns are
    ignored. Returns ``doc_id, size, source_size, target, copies``, one row for
    each input row. The budget is the sum of all sizes. The shuffled order is
    that of ``md5(seed || doc_id)``, so reruns agree. A NULL source is a source
    of its own, last in order; documents without words are never used; rows with
    equal doc_id follow each other in the queue; an empty table gives none.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = written(sized.select("doc_id", "source", "size").withColumn("key", key)
                   .withColumn("bucket", F.substring("key", 1, 3)), "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    share = written(targets(by_source, weights, epochs), "targets")
    budget = share.agg(F.sum("source_size")).first()[0] or 0
    rows = rows.join(share, rows["source"].eqNullSafe(share["source"])).drop("source")
    rows = written(running_sum(rows, F.col("size"), "upto"), "queued")

    def finish(epoch):
        return (epoch * F.col("source_size") + F.col("upto")) / F.col("target")

    items = (rows.where("size > 0 and target > 0")
             .select("size", F.explode(F.array(*(finish(F.lit(e)) for e in range(epochs)))).alias("at"))
             .withColumn("step", F.least(F.floor(F.col("at") * TIME_STEPS), F.lit(TIME_BUCKETS - 1))))
    steps = items.groupBy("step").agg(F.sum("size").alias("s"))
    edge = (steps.withColumn("upto", F.sum("s").over(W.orderBy("step"))).where(F.col("upto") > budget)
            .orderBy("step").limit(1).first())
    if edge is None:
        cut = float("inf")
    else:
        inside = (items.where(F.col("step") == edge["step"])
                  .withColumn("upto", F.sum("size").over(W.orderBy("at")) + (edge["upto"] - edge["s"])))
        cut = inside.where(F.col("upto") <= budget).agg(F.max("at")).first()[0]
        cut = edge["step"] / TIME_STEPS if cut is None else cut
    cut = min(cut, 1.0)  # gaps of other sources do not carry a source past its own target
    used = [F.when(finish(F.lit(e)) <= cut, 1).otherwise(0) for e in range(epochs)]
    rows = rows.withColumn("copies", F.when((F.col("size") > 0) & (F.col("target") > 0), sum(used[1:], used[0]))
                           .otherwise(0))
    for _ in range(FILL_ROUNDS):
        rows = written(rows.drop("upto"), "round")
        gaps = rows.groupBy("turn").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
        rows = rows.join(gaps, "turn")
        fits = (F.col("copies") < epochs) & (F.col("size") <= F.col("gap")) & (F.col("size") > 0)
        rows = running_sum(rows, F.when(fits, F.col("size")).otherwise(0), "upto")
        rows = rows.withColumn("copies", F.col("copies") + F.when(fits & (F.col("upto") <= F.col("gap")), 1)
                               .otherwise(0)).drop("gap")
    return rows.select("doc_id", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"))


def _fill_sql(n: int, epochs: int) -> str:
    return f""",
g{n} AS (SELECT *, target - sum(size * copies) OVER (PARTITION BY turn) AS gap FROM c{n}),
f{n} AS (SELECT *, copies < {epochs} AND size <= gap AND size > 0 AS fits FROM g{n}),
u{n} AS (SELECT *, sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY turn ORDER BY key, doc_id
         ROWS UNBOUNDED PRECEDING) AS taken_upto FROM f{n}),
c{n + 1} AS (SELECT doc_id, size, source_size, target, turn, key,
             copies + CASE WHEN fits AND taken_upto <= gap THEN 1 ELSE 0 END AS copies FROM u{n})"""


def mix_sql(docs: str, seed: str = "mix-1", epochs: int = EPOCHS) -> str:
    """DuckDB common tables ending in ``mixed`` (doc_id, size, source_size, target, copies) over the relation ``docs``."""
    w = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(WEIGHTS))
    fin = [f"({e} * source_size + upto) / target" for e in range(epochs)]
    return f"""
z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
      md5('{seed}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM {docs}),
s0 AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS turn
       FROM z GROUP BY source),
s1 AS (SELECT *, CASE turn % {len(WEIGHTS)} {w} END AS weight, source_size * {epochs} AS lim FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY CAST(lim AS DOUBLE) / weight, turn) AS k,
       sum(lim) OVER (ORDER BY CAST(lim AS DOUBLE) / weight, turn ROWS UNBOUNDED PRECEDING) - lim AS stopped,
       sum(weight) OVER (ORDER BY CAST(lim AS DOUBLE) / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
       sum(source_size) OVER () AS total FROM s1),
s3 AS (SELECT *, CAST(total - stopped AS DOUBLE) / CAST(open AS DOUBLE) AS level FROM s2),
s4 AS (SELECT *, min(CASE WHEN lim >= level * weight THEN k END) OVER () AS stop FROM s3),
s5 AS (SELECT source, source_size, turn, CASE WHEN k < stop THEN CAST(lim AS DOUBLE)
       ELSE max(CASE WHEN k = stop THEN level END) OVER () * weight END AS target FROM s4),
q AS (SELECT z.doc_id, size, key, s5.source_size, turn, target,
      sum(size) OVER (PARTITION BY turn ORDER BY key, z.doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM z JOIN s5 ON z.source IS NOT DISTINCT FROM s5.source),
i AS (SELECT size, unnest([{', '.join(fin)}]) AS vt FROM q WHERE size > 0 AND target > 0),
a AS (SELECT vt, sum(size) OVER (ORDER BY vt) AS upto FROM i),
cut AS (SELECT least(max(vt), CAST(1 AS DOUBLE)) AS vt FROM a WHERE upto <= (SELECT sum(size) FROM z)),
c0 AS (SELECT doc_id, size, source_size, target, turn, key, CASE WHEN size > 0 AND target > 0 THEN
       {' + '.join(f'CASE WHEN {x} <= cut.vt THEN 1 ELSE 0 END' for x in fin)} ELSE 0 END AS copies FROM q, cut)""" + \
        "".join(_fill_sql(n, epochs) for n in range(FILL_ROUNDS)) + f""",
mixed AS (SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(copies AS BIGINT) AS copies
          FROM c{FILL_ROUNDS})"""
