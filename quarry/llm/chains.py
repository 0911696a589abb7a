"""Substring deduplication by collinear chaining of shared seeds.

Seeds are the minimizers of the word k-mers of whole texts. Each place of a seed
is joined with its earliest occurrence in the corpus, in an earlier document or in
its own (one partner, however many others share it). The matches of a document and an earlier one are
chained: a chain rises in both texts, each match adds its words, and the words
between matches cost. Chains are found in one sweep with a Fenwick tree of best
scores. Each chain is then aligned word by word, through and beyond its matches,
and cut where gaps are wide or equal words few, which gives its passages, their
places in both texts and their shares of equal words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import hashed_in, slices, sorted_groups, written
from quarry.llm.shingles import mix, shingle_hashes, word_hashes

#: Words of a seed, and k-mers of which the least is a seed: an equal run of SEED + WINDOW - 1 words shares one.
SEED, WINDOW = 8, 12
#: Score of a match and cost of each word between matches, in each text: what a chain bridges grows with its score.
MATCH, GAP = 8.0, 0.1
#: Matches of a document (with any others) no further apart than REACH words make a stretch; stretches shorter than
#: STRETCH_WORDS hold no passage: the outermost seeds of an equal run of 50 words span 28 or more. A passage bridges no
#: more than REACH unlike words at a time. Words around a chain that its alignment looks at.
REACH, STRETCH_WORDS, AROUND = 40, 20, 64
#: A passage has at least so many words in both texts and so large a share of equal ones.
PASSAGE_WORDS, IDENTITY = 50, 0.8


def seeds(docs: DataFrame) -> DataFrame:
    """(h, doc, pos, more, run) of the minimizers of all texts.

    Places less than PASSAGE_WORDS after one another are one row, as the text
    between repeats a unit shorter than a passage: the first place, the last one
    is ``run`` on. ``more`` is the same, but for the first row of a seed in a text
    it reaches to the last place of all.
    """
    def of_texts(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, first = word_hashes(part.column("text"))
                kmers = shingle_hashes(words, SEED)
                if not len(kmers):
                    continue
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                whole = row[:len(kmers)] == row[SEED - 1:]  # k-mers within one text
                order = np.where(whole, kmers, np.uint64(2 ** 64 - 1))
                padded = np.concatenate([order, np.full(WINDOW - 1, 2 ** 64 - 1, np.uint64)])
                at = np.unique(np.arange(len(kmers)) + sliding_window_view(padded, WINDOW).argmin(1))
                at = at[whole[at]]
                if not len(at):
                    continue
                with np.errstate(over="ignore"):  # one key for each seed of each text
                    key = kmers[at] ^ mix(row[at].astype(np.uint64) + np.uint64(1))
                order = np.argsort(key, kind="stable")
                key, at = key[order], at[order]
                first_one = np.r_[True, key[1:] != key[:-1]]
                begin = np.flatnonzero(first_one | np.r_[True, at[1:] - at[:-1] >= PASSAGE_WORDS])
                run = at[np.r_[begin[1:], len(at)] - 1] - at[begin]
                ends = at[np.r_[np.flatnonzero(first_one)[1:], len(at)] - 1]
                more = np.where(first_one[begin], ends[np.cumsum(first_one)[begin] - 1] - at[begin], run)
                at = at[begin]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict({
                    "h": pa.array(kmers[at].astype(np.int64)), "doc": pa.array(ids[row[at]], pa.int64()),
                    "pos": pa.array((at - first[row[at]]).astype(np.int32)), "more": pa.array(more.astype(np.int32)),
                    "run": pa.array(run.astype(np.int32))})

    return docs.select("doc_id", "text").mapInArrow(of_texts, "h long, doc long, pos int, more int, run int")


def chain(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Best chains of the matches (x, y), sorted by x then y: index arrays that rise in both, none used twice."""
    n = len(x)
    rank = np.unique(y, return_inverse=True)[1] + 1
    size = int(rank.max())
    best, who = [-1e18] * (size + 1), [-1] * (size + 1)
    score, back = np.zeros(n), np.full(n, -1)
    xs, ys, rs = x.tolist(), y.tolist(), rank.tolist()
    pending: list[int] = []
    for i in range(n):
        if pending and xs[pending[0]] < xs[i]:  # matches at one x do not precede one another
            for j in pending:
                value, r = score[j] + GAP * (xs[j] + ys[j]), rs[j]
                while r <= size:
                    if value > best[r]:
                        best[r], who[r] = value, j
                    r += r & -r
            pending = []
        r, top, j = rs[i] - 1, -1e18, -1
        while r > 0:
            if best[r] > top:
                top, j = best[r], who[r]
            r -= r & -r
        gain = top - GAP * (xs[i] + ys[i]) if j >= 0 else 0.0
        score[i] = MATCH + max(gain, 0.0)
        back[i] = j if gain > 0 else -1
        pending.append(i)
    used, out = np.zeros(n, bool), []
    for i in np.argsort(-score, kind="stable"):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        if path:
            out.append(np.array(path[::-1]))
    return out


def chains(matches: DataFrame) -> DataFrame:
    """(doc, src, xs, ys, more, again, run): chains of the matches that stand in long enough stretches of a document.

    The seed that comes again furthest on is number ``again``, for ``run`` words.
    """
    def run(batches):
        for g in sorted_groups(batches, ["doc"]):
            doc, pos = g["doc"], g["pos"]
            new = np.ones(len(pos), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > REACH)
            begin = np.flatnonzero(new)
            span = pos[np.r_[begin[1:] - 1, len(pos) - 1]] + SEED - pos[begin]
            span = np.maximum(span, np.maximum.reduceat(g["more"], begin) + SEED)  # seeds that come again in a text
            keep = np.repeat(span >= STRETCH_WORDS, np.diff(np.r_[begin, len(pos)]))
            doc, src, x, y, more, again = (g[c][keep] for c in ("doc", "src", "pos", "src_pos", "more", "run"))
            order = np.lexsort((y, x, src, doc))
            doc, src, x, y, more, again = (v[order] for v in (doc, src, x, y, more, again))
            cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (src[1:] != src[:-1])) + 1
            rows = []
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(doc)]) if len(doc) else ():
                for c in chain(x[lo:hi], y[lo:hi]):
                    c = c + lo
                    k = int(np.argmax(np.where(again[c] > 0, x[c] + again[c], -1)))
                    rows.append((doc[lo], src[lo], x[c], y[c], more[c].max(), k, again[c[k]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                 pa.array([r[3] for r in rows], pa.list_(pa.int32())),
                 *(pa.array([r[k] for r in rows], pa.int32()) for k in (4, 5, 6))],
                names=["doc", "src", "xs", "ys", "more", "again", "run"])

    return (matches.repartition("doc").sortWithinPartitions("doc", "pos")
            .mapInArrow(run, "doc long, src long, xs array<int>, ys array<int>, more int, again int, run int"))


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n, at, size = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at:min(at + size, n)] != b[at:min(at + size, n)])
        if len(differ):
            return at + int(differ[0])
        at, size = at + size, 2 * size
    return n


def _extend(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Equal runs (start in a, start in b, words) from the beginning on, bridged over up to three odd words."""
    i = j = 0
    out = []
    while True:
        n = _run(a[i:], b[j:])
        if n:
            out.append((i, j, n))
        i, j = i + n, j + n
        for dx, dy in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (3, 3)):
            if _run(a[i + dx:i + dx + 4], b[j + dy:j + dy + 4]) == 4:
                i, j = i + dx, j + dy
                break
        else:
            return out


def _before(a: np.ndarray, b: np.ndarray, i: int, j: int, x: int, y: int) -> list[tuple[int, int, int]]:
    """The same from (x, y) back to (i, j) at most."""
    return [(x - dx - n, y - dy - n, n) for dx, dy, n in reversed(_extend(a[i:x][::-1], b[j:y][::-1]))]


def _common(a: list, b: list) -> int:
    """Most equal words in order (longest common subsequence) of two short stretches."""
    row = [0] * (len(b) + 1)
    for x in a:
        prior = 0
        for j, y in enumerate(b, 1):
            prior, row[j] = row[j], prior + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def align(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Equal runs of the words a and b through the matches (xs, ys), and beyond them.

    A row for each run: its start in a, its start in b, its words, and the words
    that may be equal in the gap before it (0 if that is wider than REACH).
    """
    i, j = int(xs[0]), int(ys[0])
    runs = [(*r, 0) for r in _before(a, b, 0, 0, i, j)]
    for x, y in zip(xs.tolist(), ys.tolist()):
        if x < i or y < j:  # overlaps what is aligned already
            continue
        ahead = [(i + dx, j + dy, n, 0) for dx, dy, n in _extend(a[i:x], b[j:y])]
        if ahead:
            i, j = ahead[-1][0] + ahead[-1][2], ahead[-1][1] + ahead[-1][2]
        behind = [*_before(a, b, i, j, x, y), (x, y, _run(a[x:], b[y:]))]
        p, q = behind[0][:2]
        same = min(p - i, q - j) if max(p - i, q - j) <= REACH else 0
        runs += ahead + [(*r, 0 if k else same) for k, r in enumerate(behind)]
        i, j = x + behind[-1][2], y + behind[-1][2]
    return np.array(runs + [(i + dx, j + dy, n, 0) for dx, dy, n in _extend(a[i:], b[j:])])


def judged(runs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(start, end, src_start, src_end, equal words) of the passages that the runs of an alignment hold.

    No passage bridges a gap of more than REACH words. If the runs between two
    such gaps fail as a whole, they are covered by their longest parts that pass.
    """
    runs = runs[runs[:, 2] > 0]
    gap = np.maximum(*(runs[1:, c] - runs[:-1, c] - runs[:-1, 2] for c in (0, 1))) if len(runs) else []
    out = []
    for part in np.split(runs, np.flatnonzero(gap > REACH) + 1) if len(runs) else ():
        x, y, n, same = part.T
        total = np.cumsum(n + same)  # up to the end of each run
        before = total - n

        def passing(lo):
            words, src_words = x[lo:] + n[lo:] - x[lo], y[lo:] + n[lo:] - y[lo]
            return np.flatnonzero((np.minimum(words, src_words) >= PASSAGE_WORDS)
                                  & (total[lo:] - before[lo] >= IDENTITY * np.maximum(words, src_words))) + lo

        def add(lo, hi):
            out.append((int(x[lo]), int(x[hi] + n[hi]), int(y[lo]), int(y[hi] + n[hi]), int(total[hi] - before[lo])))

        i, end, top, size = 0, -1, (-1, -1), len(part)
        if size - 1 in passing(0):
            add(0, size - 1)
            continue
        while end < size - 1:  # of the parts from the first run not covered or before, the one that goes furthest
            while i <= end + 1:
                top = max(top, (int(max(passing(i), default=-1)), -i))
                i += 1
            if top[0] > end:
                add(-top[1], top[0])
            end = max(end + 1, top[0])
    return out


def found_in(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The passages through the matches (xs, ys). Gaps are compared only where their words could make a passage."""
    runs = align(a, b, xs, ys)
    if not judged(runs):
        return []
    ends = runs[:-1, :2] + runs[:-1, 2:3]
    for k in np.flatnonzero(runs[1:, 3]) + 1:
        (i, j), (x, y) = ends[k - 1], runs[k, :2]
        runs[k, 3] = _common(a[i:x].tolist(), b[j:y].tolist())
    return judged(runs)


def repeated(a: np.ndarray, b: np.ndarray, x: int, y: int, run: int, found: list[tuple]) -> list[tuple]:
    """Passages from the further places, up to ``run`` words on, of the seed at (x, y), where those found do not reach."""
    places = np.flatnonzero((sliding_window_view(a[x:x + run + SEED], SEED) == b[y:y + SEED]).all(1))[1:] + x
    found, out, reach = sorted(found), [], 0
    for p in places.tolist():
        while found and found[0][0] <= p:
            reach = max(reach, found.pop(0)[1])
        if p + SEED > reach:
            new = found_in(a, b, np.array([p]), np.array([y]))
            out += new
            reach = max([reach, *(r[1] for r in new if r[0] <= p)])
    return out


def passages(docs: DataFrame) -> DataFrame:
    """Passages of documents that repeat in an earlier document or earlier in their own, exactly or nearly.

    ``docs`` has ``doc_id`` (unique) and ``text``; other columns are ignored.
    Rows ``doc_id, start, end, src_doc_id, src_start, src_end, identity``: the
    words from start to end (exclusive, counted from 0) stand in the document
    of the smaller or same id src_doc_id too, with that share of equal words (of the
    longer side). Passages have PASSAGE_WORDS words or more on both sides. Each
    place in a document has its row, also where the document itself has the first
    one (src_doc_id is doc_id then, and src_start is less than start); a unit of
    fewer words that repeats on end is not a copy of itself. A document
    without passages has no row, so have NULL, empty and short texts,
    rows without doc_id and rows that repeat a document under its own id. An
    empty table gives an empty result.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    found = written(seeds(docs), "seeds")
    first = (found.groupBy("h").agg(F.min(F.struct("doc", "pos")).alias("f"), F.max(F.struct("doc", "pos")).alias("last"))
             .where("f < last").select("h", F.col("f.doc").alias("src"), F.col("f.pos").alias("src_pos")))
    matches = found.join(first, "h").where("doc > src or doc = src and pos > src_pos").select("doc", "src", "pos", "src_pos", "more", "run")
    linked = written(chains(matches), "chains")
    wanted = linked.select(F.explode(F.array("doc", "src")).alias("d")).select(F.xxhash64("d").alias("h"))

    def words_of(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, at = word_hashes(part.column("text"))
                short = pa.array((words >> np.uint64(32)).astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), short)],
                    names=["d", "w"])

    words = hashed_in(docs.withColumn("h", F.xxhash64(F.col("doc_id").cast("long"))), "h", wanted).mapInArrow(
        words_of, "d long, w array<int>")

    def window(values, name):
        lo = F.greatest(F.element_at(values, 1) - AROUND, F.lit(0))
        return [lo.alias(f"{name}_lo"), F.slice(name, lo + 1, F.element_at(values, -1) + F.col("more") + SEED + AROUND - lo).alias(name)]

    left = linked.join(words.select(F.col("d").alias("doc"), F.col("w").alias("a")), "doc").select(
        "doc", "src", "xs", "ys", "more", "again", "run", *window(F.col("xs"), "a"))
    both = left.join(words.select(F.col("d").alias("src"), F.col("w").alias("b")), "src").select(
        "doc", "src", "xs", "ys", "again", "run", "a_lo", "a", *window(F.col("ys"), "b"))

    def aligned(batches):
        for batch in batches:
            rows = []
            c = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                a, b, xs, ys = (c[n][i].values.to_numpy() for n in ("a", "b", "xs", "ys"))
                lo, src_lo = c["a_lo"][i].as_py(), c["b_lo"][i].as_py()
                found = found_in(a, b, xs - lo, ys - src_lo)
                if run := c["run"][i].as_py():
                    k = c["again"][i].as_py()
                    found += repeated(a, b, int(xs[k]) - lo, int(ys[k]) - src_lo, run, found)
                for s, e, t, u, same in found:
                    rows.append((c["doc"][i].as_py(), s + lo, e + lo, c["src"][i].as_py(), t + src_lo, u + src_lo,
                                 same / max(e - s, u - t)))
            yield pa.RecordBatch.from_pylist([dict(zip(OUT.names, r)) for r in rows], schema=OUT)

    found = both.mapInArrow(aligned, "doc_id long, start long, end long, src_doc_id long, src_start long, src_end long, "
                                 "identity double")
    # a passage inside of another one of the document says nothing more
    before = W.partitionBy("doc_id").orderBy("start", F.desc("end"), "src_doc_id", "src_start", "src_end")
    reach = F.max("end").over(before.rowsBetween(W.unboundedPreceding, -1))
    return found.withColumn("reach", reach).where("reach is null or end > reach").drop("reach")


OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("src_doc_id", pa.int64()),
                 ("src_start", pa.int64()), ("src_end", pa.int64()), ("identity", pa.float64())])
