"""Language identification by unigram pieces, marginalised over segmentations.

A fixed public vocabulary gives the pieces. Each language has a probability for
every piece, learned by expectation-maximisation from labelled words. A word's
probability in a language is the sum over all ways to cut it into pieces, by the
forward algorithm; a text's is the product over its words. The prediction is
the language of the highest posterior.

Words are maximal runs of letters, lower-cased, with the vocabulary's word mark
in front. Characters that no piece covers count as one piece each, of a fixed
small probability. The lattices of many words are filled at once with numpy.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import slices, written

MARK = "▁"


def _letters() -> re.Pattern:
    """Maximal runs of letters: word characters but digits, other numerals (such as ² or ½) and the underscore."""
    codes = [i for i in range(sys.maxunicode + 1) if (c := chr(i)).isalnum() and not c.isalpha() and not c.isdecimal()]
    ranges: list[tuple[int, int]] = []
    for i in codes:
        if ranges and ranges[-1][1] == i - 1:
            ranges[-1] = ranges[-1][0], i
        else:
            ranges.append((i, i))
    return re.compile(r"[^\W\d_" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]+")


LETTERS = _letters()
#: The fit takes at most so many documents of each language, those with the smallest hash of their id, and of these at
#: most so many distinct words of each language, the most frequent; everything else covers all rows.
FIT_DOCUMENTS, FIT_WORDS = 400, 40_000
FIT_ROUNDS = 3
#: Added to the expected count of each piece, and the probability of a character outside of the vocabulary.
SMOOTHING, UNKNOWN = 0.05, 1e-7
#: Longer runs of letters have no part in the fit; all are scored, and whole.
FIT_WORD_CHARS = 48
#: Places of a word whose pieces are looked up together; it only bounds memory.
PLACES = 4096
#: Words whose scores a task remembers.
REMEMBERED_WORDS = 200_000
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


class Pieces:
    """Vocabulary pieces of letters, found by a hash of their characters."""

    def __init__(self, pieces: list[str]):
        self.pieces = [p for p in dict.fromkeys(pieces) if p and LETTERS.fullmatch(p.removeprefix(MARK) or "x")
                       and MARK not in p[1:] and p == p.lower()]
        self.longest = max((len(p) for p in self.pieces), default=1)
        with np.errstate(over="ignore"):
            key = np.array([self._fold(np.array([[ord(c) for c in p]], np.uint64))[0, -1] for p in self.pieces],
                           np.uint64)
        order = np.argsort(key)
        self.key, self.number = key[order], order.astype(np.int64)
        # a direct table on the leading bits makes the search short
        self.bits = 16
        self.begin = np.searchsorted(self.key >> _U(64 - self.bits), np.arange((1 << self.bits) + 1).astype(np.uint64))
        self.depth = int(np.diff(self.begin).max(initial=1))

    @staticmethod
    def _fold(codes: np.ndarray) -> np.ndarray:
        """Hashes of all prefixes of each row of character codes."""
        out = np.zeros(codes.shape, np.uint64)
        h = np.zeros(len(codes), np.uint64)
        for i in range(codes.shape[1]):
            h = (h ^ (codes[:, i] + _U(1))) * _STEP
            h ^= h >> _U(29)
            out[:, i] = h
        return out

    def find(self, key: np.ndarray) -> np.ndarray:
        """Number of the piece with this hash, -1 if there is none."""
        at = self.begin[(key >> _U(64 - self.bits)).astype(np.int64)]
        out = np.full(key.shape, -1)
        last = len(self.key) - 1
        for d in range(self.depth):
            i = np.minimum(at + d, last)
            hit = self.key[i] == key
            out[hit] = self.number[i[hit]]
        return out

    def lattice(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Piece number of each (start, end) span of words of one length, where any word has one."""
        n = codes.shape[1]
        spans = {}
        with np.errstate(over="ignore"):
            for i in range(n):
                keys = self._fold(codes[:, i:i + self.longest])
                for k in range(keys.shape[1]):
                    found = self.find(keys[:, k])
                    if k == 0 or (found >= 0).any():
                        spans[i, i + k + 1] = found
        return spans


def _by_length(words: list[str]):
    """(positions, character codes) of marked words of equal length."""
    marked = [MARK + w for w in words]
    sizes = np.array([len(w) for w in marked])
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            text = "".join([marked[i] for i in part])
            yield part, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(part), -1).astype(np.uint64)


def forward(spans, n: int, rows: int, prob: np.ndarray):
    """Forward sums, one per position, and the log of what was scaled away, for all languages."""
    alpha = [np.ones((rows, prob.shape[1]))]
    scale = np.zeros((rows, prob.shape[1]))
    into: dict[int, list] = {}
    for (i, j), ids in spans.items():
        into.setdefault(j, []).append((i, ids))
    for j in range(1, n + 1):
        total = np.zeros((rows, prob.shape[1]))
        for i, ids in into[j]:
            total += alpha[i] * (prob[ids] if j - i > 1 else np.where(ids[:, None] >= 0, prob[ids], UNKNOWN))
        alpha.append(total)
        if j % 8 == 0:  # keep long words in range
            factor = total
            alpha = [a / factor for a in alpha]
            scale += np.log(factor)
    return alpha, scale, into


def word_scores(words: list[str], pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, summed over all segmentations."""
    out = np.zeros((len(words), prob.shape[1]))
    padded = np.vstack([prob, np.zeros(prob.shape[1])])  # -1 finds the last row: no such piece
    for part, codes in _by_length(words):
        out[part] = _log_forward(codes, pieces, padded)
    return out


def _log_forward(codes: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log forward sums of words of one length. Sums go from each place to the ends of the pieces that begin there, so
    only those of the next places are held, however long the words are."""
    rows, n = codes.shape
    longest, step = pieces.longest, max(1, PLACES // rows)
    ahead = np.zeros((longest + 1, rows, prob.shape[1]))
    ahead[0] = 1
    scale = np.zeros((rows, prob.shape[1]))
    # no piece holds the filling, so none reaches over the end
    filled = np.concatenate([codes, np.full((rows, longest), np.uint64(sys.maxunicode + 1))], axis=1)
    for low in range(0, n, step):
        places = min(step, n - low)
        windows = sliding_window_view(filled[:, low:low + places + longest - 1], longest, axis=1)
        with np.errstate(over="ignore"):
            keys = pieces._fold(windows.reshape(rows * places, longest))
        found = np.stack([pieces.find(keys[:, k]).reshape(rows, places) for k in range(longest)])
        some = (found >= 0).any(1)
        for i in range(places):
            at = low + i
            here = ahead[at % (longest + 1)]
            if at % 8 == 0 and at:  # keep long words in range
                scale += np.log(here)
                ahead /= here.copy()
            ids = found[0, :, i]
            ahead[(at + 1) % (longest + 1)] += here * np.where(ids[:, None] >= 0, prob[ids], UNKNOWN)
            for k in np.flatnonzero(some[1:, i]) + 1:
                ahead[(at + k + 1) % (longest + 1)] += here * prob[found[k, :, i]]
            here[:] = 0
    return np.log(ahead[n % (longest + 1)]) + scale


def expected_counts(words: list[str], weight: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in each language, over all segmentations of the words."""
    total = np.zeros((len(prob) + 1, prob.shape[1]))
    padded = np.vstack([prob, np.zeros(prob.shape[1])])
    for part, codes in _by_length(words):
        n = codes.shape[1]
        spans = pieces.lattice(codes)
        alpha, _, into = forward(spans, n, len(part), padded)
        beta = [np.zeros_like(alpha[0]) for _ in range(n)] + [np.ones_like(alpha[0])]
        for j in range(n, 0, -1):
            for i, ids in into[j]:
                p = padded[ids] if j - i > 1 else np.where(ids[:, None] >= 0, padded[ids], UNKNOWN)
                beta[i] += beta[j] * p
        whole = beta[0] * alpha[0]
        for j in range(1, n + 1):
            for i, ids in into[j]:
                p = padded[ids] if j - i > 1 else np.where(ids[:, None] >= 0, padded[ids], UNKNOWN)
                np.add.at(total, ids, weight[part] * alpha[i] * p * beta[j] / whole)
    return total[:-1]


def fit(labelled: DataFrame, pieces: Pieces) -> tuple[list[str], np.ndarray]:
    """Languages in order and the probability of each piece in each of them.

    ``labelled`` has ``doc_id, text, lang``; rows without text or language do
    not count. The words of the sample are counted by Spark, and each round of
    expectation runs over partitions of them; only sums over the vocabulary
    reach the driver.
    """
    spark = labelled.sparkSession
    known = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((len(pieces.pieces), 0))
    # hashes in [0, 1): those under 2 FIT_DOCUMENTS / rows all but surely hold the FIT_DOCUMENTS smallest, so that few rows
    # of a language are ranked
    unit = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    most = F.create_map(*[F.lit(x) for lang in langs for x in (lang, 2.0 * FIT_DOCUMENTS / counts[lang])])
    few = known.select("doc_id", "lang", unit.alias("u")).where(F.col("u") <= F.element_at(most, F.col("lang"))).distinct()
    pick = W.partitionBy("lang").orderBy("u", "doc_id")
    ids = few.withColumn("n", F.row_number().over(pick)).where(F.col("n") <= FIT_DOCUMENTS)
    # at most FIT_DOCUMENTS ids of each language: small whatever the corpus, so that no text is shuffled
    sample = known.join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"])
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
                          .alias("w")).where(F.length("w") <= FIT_WORD_CHARS).groupBy("lang", "w").agg(F.count("*").alias("c"))
    top = W.partitionBy("lang").orderBy(F.desc("c"), "w")
    words = written(words.withColumn("n", F.row_number().over(top)).where(F.col("n") <= FIT_WORDS).select("lang", "w", "c"),
                    "words")
    place = {x: i for i, x in enumerate(langs)}
    shared = spark.sparkContext.broadcast(pieces)
    prob = np.array([[4.0 ** -len(p)] for p in pieces.pieces]) * np.ones((1, len(langs)))
    prob /= prob.sum(0)
    for _ in range(FIT_ROUNDS):
        now = spark.sparkContext.broadcast(prob)  # destroyed with the round

        def expect(batches):
            for batch in batches:
                if batch.num_rows:
                    w = batch.column("w").to_pylist()
                    weight = np.zeros((len(w), len(place)))
                    weight[np.arange(len(w)), [place[x] for x in batch.column("lang").to_pylist()]] = batch.column("c")
                    got = expected_counts(w, weight, shared.value, now.value)
                    i, j = np.nonzero(got)
                    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                                      pa.array(got[i, j])], names=["p", "l", "x"])

        counts = words.repartition(8).mapInArrow(expect, "p int, l int, x double").groupBy("p", "l").agg(
            F.sum("x").alias("x")).toPandas()
        now.destroy()
        new = np.full(prob.shape, SMOOTHING)
        new[counts["p"], counts["l"]] += counts["x"]
        prob = new / new.sum(0)
    shared.destroy()
    return langs, prob


def predict(docs: DataFrame, pieces: Pieces, langs: list[str], prob: np.ndarray,
            keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score``, the posterior of the prediction under equal priors.

    ``und`` with score 0 if the text is NULL or has no letter, or if nothing was
    learned. Equal posteriors go to the first language in order.
    """
    shared = docs.sparkSession.sparkContext.broadcast((pieces, langs, prob))
    out = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{k}` {out.schema[k].dataType.simpleString()}" for k in keep) + f", {names[0]} string, {names[1]} double"

    def run(batches):
        pieces, langs, prob = shared.value
        known: dict[str, int] = {}
        table = np.zeros((0, len(langs)))
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                rows = [LETTERS.findall(t.lower()) if t else [] for t in part.column("text").to_pylist()]
                fresh = list(set().union(*rows).difference(known))
                if fresh and langs:
                    table = np.vstack([table, word_scores(fresh, pieces, prob)])
                known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
                pred, score = [], []
                for r in rows:
                    if not r or not langs:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    total = table[[known[w] for w in r]].sum(0)
                    best = int(total.argmax())
                    pred.append(langs[best])
                    score.append(float(1 / np.exp(total - total[best]).sum()))
                if len(known) > REMEMBERED_WORDS:
                    known, table = {}, table[:0]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(pred, pa.string()),
                                                  pa.array(score)], names=[*keep, *names])

    return out.mapInArrow(run, schema)


def read_pieces(path: str) -> Pieces:
    """The pieces of a public sentence-piece model, read on the driver; their number is fixed by the file."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Pieces([model.id_to_piece(i) for i in range(model.get_piece_size())])


def identify(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",),
             names: tuple[str, str, str] = ("held_out", "lang_pred", "score")) -> DataFrame:
    """Learn on documents whose crc32(doc_id as text) mod 4 is not 2, predict all: the columns ``keep`` and ``names``.

    NULL doc_ids are not learned from and count as not held out. Extra columns
    are ignored, equal rows get equal predictions, an empty table gives none.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    pieces = read_pieces(path)
    learn = docs.where(~held & F.col("doc_id").isNotNull())
    langs, prob = fit(learn, pieces)
    flagged = docs.withColumn(names[0], held)
    return predict(flagged, pieces, langs, prob, keep=(*keep, names[0]), names=names[1:]).select(*keep, *names)
