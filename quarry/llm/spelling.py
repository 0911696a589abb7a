"""Spelling variants: pairs of words at one edit, by finite-state composition.

The vocabulary is a minimised acceptor. Composed with a transducer that makes
one edit and with the acceptor again, it accepts the pairs of words that differ
by one inserted, deleted or replaced code point. A state of the composition is a
pair of acceptor states and whether the edit has been made; before it both states
are the same, after it both sides read the same characters to the end.

The composition is enumerated in parts, one for each initial state: the state
that a shared beginning leads to, or a shared end (the reverse of it). Two words
at one edit share the first or the last half of the longer one's characters, so
every pair has a part. A part with too many words is split by longer shared
beginnings and ends, until it fits or a single character is left to differ; a
pair is accepted only in the part that its common prefix names, so it is found
once. Words are dealt to parts by Spark, and a task holds one part at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import sorted_groups, written

#: Code points of the first shared beginnings and ends, and words of a part above which it is split further.
SHARED, PART_WORDS = 3, 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTER = "A-Za-zÀ-ÿ"


class Acceptor:
    """Minimised deterministic acceptor of sorted distinct words: ``next[state]`` by character, and ``final``."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.final = [False]
        same: dict = {}
        path, previous = [0], ""
        for w in words:
            k, most = 0, min(len(w), len(previous))
            while k < most and w[k] == previous[k]:
                k += 1
            self._settle(path, previous, k, same)
            for c in w[k:]:
                self.next[path[-1]][c] = len(self.next)
                path.append(len(self.next))
                self.next.append({})
                self.final.append(False)
            self.final[path[-1]] = True
            previous = w
        self._settle(path, previous, 0, same)

    def _settle(self, path: list[int], word: str, depth: int, same: dict) -> None:
        """States of the last word below ``depth`` will not change any more: equal ones become one."""
        while len(path) > depth + 1:
            s = path.pop()
            key = (self.final[s], *sorted(self.next[s].items()))
            known = same.setdefault(key, s)
            if known != s:
                self.next[path[-1]][word[len(path) - 1]] = known

    def common(self, p: int, q: int, but: str = "", after: str = "") -> list[str]:
        """Words that lead from both states to final ones: the part after the edit.

        Followed by ``after``, they do not begin with ``but``."""
        out, stack = [], [(p, q, "")]
        while stack:
            p, q, s = stack.pop()
            if self.final[p] and self.final[q] and (s or not but or but != after):
                out.append(s)
            a, b = self.next[p], self.next[q]
            for c in a if len(a) <= len(b) else b:
                if c in a and c in b and (s or c != but):
                    stack.append((a[c], b[c], s + c))
        return out

    def edits(self, p: int, after: str) -> list[tuple[str, str]]:
        """Pairs of ends from state ``p`` that differ from their first character on; a longer end comes second.

        Of the places at which a character of a run may have been inserted, that is the last one."""
        out, arcs = [], sorted(self.next[p].items())
        for i, (b, q) in enumerate(arcs):
            for a, r in arcs[:i]:
                out += [(a + s, b + s) for s in self.common(r, q)]
            out += [(s, b + s) for s in self.common(p, q, b, after)]
        return out

    def pairs(self, depth: int, after: str = "") -> Iterator[tuple[str, str]]:
        """Accepted pairs of words, followed by ``after``, whose common prefix is shorter than ``depth``; each once."""
        known: dict[int, list] = {}
        stack = [(0, "")]
        while stack:
            p, prefix = stack.pop()
            if p not in known:
                known[p] = self.edits(p, after)
            for x, y in known[p]:
                yield prefix + x, prefix + y
            if len(prefix) + 1 < depth:
                stack += [(q, prefix + c) for c, q in self.next[p].items()]


def occurrences(docs: DataFrame, doc_col: str, text_col: str, least: int) -> DataFrame:
    """(doc_id, run): each maximal run of ``least`` or more letters of the whole text, A-Z in lower case. NULL has none.

    Letters are A-Z, a-z and the code points C0 to FF."""
    runs = docs.select(F.col(doc_col).alias("doc_id"), F.explode(
        F.regexp_extract_all(text_col, F.lit(f"[{LETTER}]{{{least},}}"), F.lit(0))).alias("run"))
    # lower() also changes letters beyond Z, so runs with such capitals take the slower way
    return runs.select("doc_id", F.when(F.col("run").rlike("[À-Þ]"), F.translate("run", UPPER, LOWER))
                       .otherwise(F.lower("run")).alias("run"))


def vocabulary(words: DataFrame, least: int, least_n: int) -> DataFrame:
    """(word, n): words of at least ``least`` code points and ``least_n`` occurrences. Counted before the shuffle."""
    return (words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= least_n))


PLACE = ["size", "head", "tail", "below"]


def _split(part: DataFrame, d, size) -> DataFrame:
    """Deal words to the parts of a longer shared beginning, and of a longer shared end.

    Columns: ``x`` is what lies between ``head`` and ``tail``; a pair belongs here if its common prefix is under
    ``below``; ``size`` is the length of the longer word of a pair, 0 where lengths are not told apart."""
    at_head = part.select(size.alias("size"), F.concat("head", F.substring("x", F.lit(1), d)).alias("head"), "tail", "below",
                          F.substring("x", d + 1, F.length("x")).alias("x"), "n")
    kept = F.length("x") - d
    at_tail = part.select(size.alias("size"), "head", F.concat(F.substring("x", kept + 1, d), "tail").alias("tail"),
                          F.least("below", F.length("head") + d).alias("below"), F.substring("x", F.lit(1), kept).alias("x"), "n")
    return at_head.unionByName(at_tail).where(F.length("head") < F.col("below"))


def _parts(words: DataFrame, least: int) -> DataFrame:
    """Words dealt to parts of at most PART_WORDS words (more only where a single character differs)."""
    d = min(SHARED, least // 2)
    rows = words.select(F.lit(0).alias("size"), F.lit("").alias("head"), F.lit("").alias("tail"),
                        F.lit((1 << 31) - 1).alias("below"), F.col("word").alias("x"), "n")
    rows = _split(rows, F.lit(d), F.lit(0)) if d else rows
    done = None
    while True:
        rows = written(rows, "parts")
        many = written(rows.groupBy(*PLACE).agg(F.count("*").alias("c")).where("c > 1"), "counts")
        middle = F.col("size") - F.length("head") - F.length("tail")
        split = (F.col("c") > PART_WORDS) & ((F.col("size") == 0) | (middle > 1))
        told = rows.join(many.withColumn("more", split).drop("c"), PLACE)
        small = told.where("not more").drop("more")
        done = small if done is None else done.unionByName(small)
        if many.where(split).isEmpty():
            return done
        big = told.where("more").drop("more")
        # a word takes part as the longer one of a pair and as the one that is shorter by one
        n = F.length("head") + F.length("x") + F.length("tail")
        by_size = big.withColumn("size", F.explode(F.when(F.col("size") == 0, F.array(n, n + 1)).otherwise(F.array("size"))))
        # a middle of one character cannot be cut any more and is left whole
        half = F.floor((F.col("size") - F.length("head") - F.length("tail")) / 2).cast("int")
        cut = by_size.withColumn("half", half)
        rows = _split(cut.where("half > 0"), F.col("half"), F.col("size")).unionByName(cut.where("half = 0").drop("half"))


def near_pairs(words: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, a_n, b_n): every pair of words at one edit, once, the longer one second.

    ``words`` holds distinct ``word`` and its ``n``; each has ``least`` code points or more. An empty vocabulary gives
    an empty result."""
    words = words.where("word is not null").select("word", "n")
    parts = _parts(words, least).repartition(*(F.col(c) for c in PLACE)).sortWithinPartitions(*PLACE, "x")

    def compose(batches):
        for run in sorted_groups(batches, PLACE):
            starts = run["__start"]
            out = [], [], [], []
            for lo, hi in zip(starts, [*starts[1:], len(run["x"])]):
                head, tail, size = run["head"][lo], run["tail"][lo], int(run["size"][lo])
                x = run["x"][lo:hi].tolist()
                n = dict(zip(x, run["n"][lo:hi].tolist()))
                middle = size - len(head) - len(tail)
                for a, b in Acceptor(x).pairs(int(run["below"][lo]) - len(head), tail[:1]):
                    if not size or len(b) == middle:
                        for column, value in zip(out, (head + a + tail, head + b + tail, n[a], n[b])):
                            column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(out[2], pa.int64()),
                                                  pa.array(out[3], pa.int64())], names=["a", "b", "a_n", "b_n"])

    return parts.select(*PLACE, "x", "n").mapInArrow(compose, "a string, b string, a_n long, b_n long")


def forms(words: DataFrame, least: int = 1, times: int = 10) -> DataFrame:
    """Each word with its near words' count and its form: ``word, form, root, n, n_near, form_n``.

    ``words`` holds distinct ``word`` and ``n``, other columns are ignored; NULL words have no row. ``form`` is the most
    frequent near word (ties: the first in code-point order) if it occurs at least ``times`` as often, else NULL; ``root``
    is the last word of the chain of forms, the word itself if it has none. Chains end, as counts grow along them.
    """
    words = written(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = written(near_pairs(words, least), "pairs")
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    form = F.when(-F.col("best.m") >= times * F.col("n"), F.col("best.other"))
    out = written(words.join(best, "word", "left").select(
        "word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(form.isNotNull(), -F.col("best.m")).alias("form_n")), "forms")
    chain = written(out.where("form is not null").select("word", F.col("form").alias("root")), "chain")
    step = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
    while True:  # one link a round; counts grow by ``times`` with each, so rounds are few
        longer = chain.join(step, "root", "left")
        if longer.where("further is not null").isEmpty():
            break
        chain = written(longer.select("word", F.coalesce("further", "root").alias("root")), "chain")
    return (out.join(chain, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
