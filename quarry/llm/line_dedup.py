"""Line deduplication by a deletion-neighbourhood join.

Equal lines are one (by a 128-bit hash). A line is dropped where an earlier kept
line, by (doc_id, place), is equal or within the edit bound of one character: the
lines are settled in order, so a line that was itself dropped drops no other.

Two lines at edit distance one have a variant in common: the longer one without
one of its characters. Every line emits its variants as hashed keys, equal keys
are joined, and the edit distance of what meets is verified. A variant is known by
its place and the hashes of what lies before and after it. These come from chains
of hashes over blocks of the line, so that the keys of a line of any length cost
no more than its length. Lines that meet in a key differ in one given place:
however many lines share a half, a key holds no more of them than there are
characters.

Most lines have no neighbour and are set aside first, exactly: lines at distance
one agree in the first or in the last half of the longer one's characters, so a
line emits variants only of the halves that face a half key of another line.

DataFrame operations only. Hashes are shuffled, the texts of lines that may have
neighbours, and once the documents for their new text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hashed_in, written

#: Characters of a block of the hash chains. It changes the cost of a key, never a result.
BLOCK = 128


def _lines(docs: DataFrame) -> DataFrame:
    lines = (docs.where("text is not null and doc_id is not null")
             .select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line")))
    blank = F.trim(F.translate("line", "\t\r\u000b\u000c", "    ")) == ""
    return lines.select("doc_id", "place", "line", blank.alias("blank"), F.length("line").alias("n"),
                        F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(17)).alias("h2"))


def half_keys(line, n):
    """Keys of the halves that a line shares with any line at edit distance one: of the length of the longer line, the
    side, and the half. The line is the longer one in the first two, and the shorter one in the others."""
    def of(longer):
        h = F.floor(longer / 2).cast("int")
        return [F.xxhash64(longer, F.lit(0), F.substring(line, F.lit(1), h)),
                F.xxhash64(longer, F.lit(1), F.substring(line, n - h + 1, h))]
    return F.array(*of(n), *of(n + 1))


def _chain(blocks):
    """Hashes of all runs of blocks from the first one on, beginning with that of none."""
    return F.aggregate(blocks, F.array(F.lit(0).cast("long")),
                       lambda a, b: F.concat(a, F.array(F.xxhash64(F.element_at(a, -1), b))))


def variant_keys(line, n, faced):
    """Keys of the variants of a line, of the half keys ``faced`` (bits in the order of ``half_keys``).

    A key holds the length of the longer line, the place, and what stands before and after it."""
    def blocks(text):
        return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def part(s, side, chars):
        i = F.floor(chars / BLOCK).cast("int")
        return F.xxhash64(F.get(s[f"{side}_chain"], i), F.substring(
            F.coalesce(F.get(s[side], i), F.lit("")), F.lit(1), (chars % BLOCK).cast("int")))

    def key_of(s, longer):
        return lambda i: F.xxhash64(longer, i, part(s, "head", i), part(s, "tail", longer - 1 - i))

    def keys(s):
        out = []
        for bit, longer in ((0, n), (1, n), (2, n + 1), (3, n + 1)):
            h = F.floor(longer / 2).cast("int")
            low, high = (h, longer - 1) if bit % 2 == 0 else (F.lit(0), longer - h - 1)
            places = F.when(faced.bitwiseAND(F.lit(1 << bit)) != 0, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            out.append(F.transform(places, key_of(s, longer)))
        return F.array_distinct(F.concat(*out))

    cut = F.struct(line.alias("line"), blocks(line).alias("head"), blocks(F.reverse(line)).alias("tail"))
    chained = F.transform(F.array(cut), lambda s: F.struct(
        s["head"].alias("head"), s["tail"].alias("tail"), _chain(s["head"]).alias("head_chain"), _chain(s["tail"]).alias("tail_chain")))
    # transforms of one element name the value, so that it is made once a line and not once a key
    return F.flatten(F.transform(chained, keys))


def settled(links: DataFrame) -> DataFrame:
    """``at`` of what goes: ``links`` lead from an earlier line ``a`` to a later one ``b``; a line goes for an earlier
    one that stays. Lines are decided in rounds; the number of rounds is at most that of the lines in a chain."""
    def told(links):
        """The links, with whether their earlier line stays: nothing earlier is left that it could go for."""
        later = links.select(F.col("b").alias("a")).distinct().withColumn("open", F.lit(True))
        return links.join(later, "a", "left").select("a", "b", F.col("open").isNull().alias("stays"))

    links = written(told(links), "links")
    gone = links.where("stays").select(F.col("b").alias("at"))
    while not links.isEmpty():
        now = links.where("stays").select("b").distinct()
        # the links of lines that go say nothing any more; all those of lines that stay are among them
        left = links.where("not stays").select("a", "b").join(now, "b", "left_anti").join(
            now.withColumnRenamed("b", "a"), "a", "left_anti")
        links = written(told(left), "links")
        gone = gone.unionByName(links.where("stays").select(F.col("b").alias("at")))
    return gone.distinct()


def kept_lines(docs: DataFrame, least: int = 0) -> DataFrame:
    """(doc_id, place) of the lines that stay: first occurrences without a kept earlier neighbour, and blank lines."""
    lines = _lines(docs)
    half = half_keys(F.col("line"), F.col("n"))
    half = F.when(F.col("n") >= least, half) if least else half
    firsts = written(lines.where("not blank").select("doc_id", "place", "h1", "h2", "n", half.alias("half"))
                     .groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "place")).alias("at"), F.min("half").alias("half"))
                     .select("h1", "at.doc_id", "at.place", "half"), "firsts")

    halves = firsts.select("doc_id", "place", "h1", F.posexplode("half").alias("i", "k"))
    shared = halves.groupBy("k").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("k")
    near = written(halves.join(shared, "k", "left_semi").groupBy("doc_id", "place", "h1").agg(
        F.bit_or(F.expr("shiftleft(1, i)")).alias("faced")), "near")
    texts = written(hashed_in(lines, "h1", near).join(near.drop("h1"), ["doc_id", "place"])
                    .select(F.struct("doc_id", "place").alias("at"), "line", "n", "faced"), "texts")

    keys = texts.select("at", F.explode(variant_keys(F.col("line"), F.col("n"), F.col("faced"))).alias("k"))
    a, b = keys.select("k", F.col("at").alias("a")), keys.select("k", F.col("at").alias("b"))
    # Spark takes exploded keys for as many bytes as the packed texts they come from, and would send them all by the driver
    pairs = a.hint("merge").join(b.hint("merge"), "k").where("a < b").select("a", "b").distinct()
    la, lb = (texts.select(F.col("at").alias(x), F.col("line").alias(f"l{x}")).hint("merge") for x in "ab")
    close = pairs.join(la, "a").join(lb, "b").where(F.levenshtein("la", "lb", 1) >= 0).select("a", "b")
    gone = settled(close).select("at.doc_id", "at.place")
    stay = firsts.select("doc_id", "place").join(gone, ["doc_id", "place"], "left_anti")
    return stay.unionByName(lines.where("blank").select("doc_id", "place"))


def dedup_lines(docs: DataFrame, names: tuple[str, str] = ("n_lines", "n_kept"), least: int = 0) -> DataFrame:
    """``docs`` with the kept lines as ``text``, and its lines and kept lines as ``names``; one row per input row.

    ``docs`` has ``doc_id`` (unique) and ``text``; other columns stay as they
    are. Lines are what stands between line feeds, compared as they are; lines
    of white space only are never dropped. ``least`` sets lines with fewer
    characters aside, which are then dropped only for an equal one; 0 is none.
    A document all of whose lines go has the text ''. NULL texts stay NULL with
    no lines. A row without doc_id keeps its text and has no part in the
    comparison. Rows that repeat a doc_id count as one document. An empty table
    gives an empty result.
    """
    places = kept_lines(docs, least).distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("place")).alias("__places"))
    split = docs.withColumn("__lines", F.split("text", "\n"))
    full = split.join(places, "doc_id", "left")
    kept = F.transform("__places", lambda p: F.get("__lines", p))
    text = (F.when(F.col("text").isNull() | F.col("doc_id").isNull(), F.col("text"))
            .when(F.col("__places").isNull(), F.lit("")).otherwise(F.concat_ws("\n", kept)))
    n = F.coalesce(F.size("__lines"), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(n).cast("long")
    n_kept = (F.when(F.col("text").isNull(), 0).when(F.col("doc_id").isNull(), F.size("__lines"))
              .when(F.col("__places").isNull(), 0).otherwise(F.size("__places")).cast("long"))
    out = full.select(*docs.drop("text").columns, text.alias("text"), n.alias(names[0]), n_kept.alias(names[1]))
    return out.select(*docs.columns, *names)
