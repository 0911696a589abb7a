"""Personal data: base patterns, and more by bootstrapped contextual extraction.

Base entities (email, ip, card, phone) are found by patterns in whole texts.
They are the seeds: the word in front of an entity is a lexical pattern, and
patterns and entities make a graph over the corpus. Spark scores it in rounds: a
pattern's confidence for a kind is the share of its distinct instances that
count as that kind; an instance counts as what its trusted patterns say. Tokens
with digits or @ that no base pattern covers, but trusted patterns lead to, are
added.

DataFrame operations only. Places of matches come from the lengths of the text
between them, summed by a window per document and kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import written

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive repetition and look-behind find the same matches as the plain patterns
# without going back, so that long runs take linear time and no deep stack.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?+[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Tokens that may be identifiers: hold a digit or @.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Characters looked at for the word in front of a match.
CONTEXT_CHARS = 64
#: Rounds; least confidence of a trusted pattern and of an instance; least sum of instance scores of a trusted pattern;
#: what the number of instances is raised by, so that few instances do not make certainty.
ROUNDS, TRUST, SUPPORT, PRIOR = 3, 0.6, 2.0, 1.0


def _matches(text, pattern: str):
    """Array of (gap before, match); the last gap has no match. Both functions run the same search."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                      lambda g, h: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT_CHARS)).alias("left"),
                                            h.alias("hit")))


def _found(docs: DataFrame, searches: list[tuple[int, F.Column, str]]) -> DataFrame:
    """(doc_id, h, kind, start, end, left, hit) of all matches; a search is (kind, may match at all, pattern)."""
    every = F.array(*(F.struct(F.lit(k).alias("kind"), F.when(may, _matches(F.col("text"), p)).alias("m"))
                      for k, may, p in searches))
    rows = (docs.select("doc_id", "h", F.explode(every).alias("x")).where(F.size("x.m") > 1)
            .select("doc_id", "h", "x.kind", F.posexplode("x.m").alias("j", "m")).where("m.hit is not null")
            .groupBy("doc_id", "h", "kind", "j").agg(F.first("m").alias("m"))  # rows that repeat a document
            .select("doc_id", "h", "kind", "j", "m.gap", "m.left", "m.hit"))
    upto = W.partitionBy("doc_id", "h", "kind").orderBy("j").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("hit")).over(upto)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit")).drop("gap", "j")


def _word_before(left):
    return F.lower(F.regexp_extract(left, r"(\S+)\s*+$", 1))


def base_spans(docs: DataFrame) -> DataFrame:
    """Base entities of ``docs`` (doc_id, h, text): (doc_id, h, kind, start, end, left, hit), kind as place in KINDS."""
    may = (F.col("text").contains("@"), F.col("text").rlike(r"[0-9]\.[0-9]"), F.col("text").rlike("[0-9][ -]?[0-9]"),
           F.col("text").contains("+"))
    found = _found(docs, [(k, may[k], PATTERNS[k]) for k in range(4)])
    digits = F.regexp_replace("hit", "[^0-9]", "")
    good = (F.when(F.col("kind") == 0, True)
            .when(F.col("kind") == 1, F.col("hit").rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
            .when(F.col("kind") == 2, F.length(digits).between(13, 19) & F.call_function("luhn_check", digits))
            .otherwise(F.length(digits).between(9, 15)))
    return found.where(good)


def candidates(docs: DataFrame, base: DataFrame) -> DataFrame:
    """Tokens with a digit or @ that touch no base span, without surrounding punctuation: (doc_id, h, start, end, left, hit)."""
    found = _found(docs, [(9, F.col("text").rlike("[0-9@]"), TOKEN)])
    lead = F.length("hit") - F.length(F.regexp_replace("hit", r"""^[("'\[<{]++""", ""))
    core = F.regexp_replace(F.regexp_replace("hit", r"""^[("'\[<{]++""", ""), r"""[.,;:!?)\]>}"']++$""", "")
    found = (found.withColumn("start", F.col("start") + lead).withColumn("hit", core)
             .withColumn("end", F.col("start") + F.length("hit")).where(F.length("hit") > 0))
    both = found.unionByName(base.select(found.columns))
    order = W.partitionBy("doc_id", "h").orderBy("start", F.desc("kind"))
    before = F.max(F.when(F.col("kind") < 9, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(F.col("kind") < 9, F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing))
    free = both.withColumn("b", before).withColumn("a", after).where("kind = 9")
    return free.where("coalesce(b, 0) <= start and coalesce(a, end) >= end").drop("a", "b", "kind")


def bootstrap(base: DataFrame, tokens: DataFrame) -> DataFrame:
    """(instance, kind, score) of the instances that trusted patterns lead to and that are no base entities."""
    word, instance = _word_before(F.col("left")).alias("pattern"), F.lower("hit").alias("instance")
    seeds = base.select(word, instance, "kind")
    edges = written(seeds.select("pattern", "instance").unionByName(tokens.select(word, instance))
                    .where("pattern <> ''").distinct(), "edges")
    seed = written(seeds.groupBy("instance").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0)), "seeds")
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    scores = seed
    for _ in range(ROUNDS):
        trust = (edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("s")).join(size, "pattern")
                 .withColumn("c", F.col("s") / (F.col("n") + PRIOR)).where((F.col("c") >= TRUST) & (F.col("s") >= SUPPORT))
                 .select("pattern", "kind", "c"))
        said = (edges.join(trust, "pattern").groupBy("instance", "kind")
                .agg((1 - F.exp(F.sum(F.log(1 - F.col("c") + 1e-9)))).alias("score")))
        best = said.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b")).select(
            "instance", (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score")).where(F.col("score") >= TRUST)
        scores = written(seed.unionByName(best.join(seed.select("instance"), "instance", "left_anti")), "scores")
    return scores.join(seed.select("instance"), "instance", "left_anti")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: counts of base entities by kind, the digest of their spans, and all spans.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. NULL texts
    are empty. Columns: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256,
    spans``. A span is kind:start:end in code points; spans are ordered by kind,
    then start. Added spans never overlap base spans. Repeated rows get equal
    results; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    base = written(base_spans(docs), "base")
    tokens = written(candidates(docs, base), "tokens")
    more = bootstrap(base, tokens)
    hit = F.col("hit")
    plausible = F.when(F.col("kind") == 0, hit.contains("@")).otherwise(F.length(F.regexp_replace(hit, "[^0-9]", "")) >= 4)
    added = (tokens.withColumn("instance", F.lower("hit")).join(more, "instance").where(plausible)
             .select("doc_id", "h", "kind", "start", "end", F.lit(False).alias("base")))
    spans = base.select("doc_id", "h", "kind", "start", "end", F.lit(True).alias("base")).unionByName(added)
    per = spans.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("s"))

    def text_of(s):
        return F.array_join(F.transform(s, lambda x: F.concat_ws(
            ":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])), ",")

    d, p = docs.select("doc_id", "h").alias("d"), per.alias("p")
    out = d.join(p, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.h") == F.col("p.h")), "left").select(
        F.col("d.doc_id").alias("doc_id"), F.coalesce("s", F.array().cast(per.schema["s"].dataType)).alias("s"))
    only = out.withColumn("b", F.filter("s", lambda x: x["base"]))

    def count(kind):
        return F.size(F.filter("b", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return only.select("doc_id", *map(count, range(len(KINDS))), F.sha2(text_of(F.col("b")), 256).alias("base_sha256"),
                       text_of(F.col("s")).alias("spans"))
