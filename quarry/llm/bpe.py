"""Byte-level BPE by corpus-level merge replay, and its inverse.

The distinct words of a stretch of the corpus are laid out as one array of byte
tokens. An inverted index leads from a merge's rank to the positions where its
token pair stands; merges are applied in rank order to all words at once, and
after each only the touched positions and their left neighbours are looked up
again. Words and their ids are then put back in text order.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarry.llm.common import slices

#: Bytes of text whose words are encoded together, and words whose ids a task remembers; both only bound memory.
STRETCH_BYTES = 2 << 20
REMEMBERED_WORDS = 200_000

NONE = np.int64(1 << 40)


class MergeTable:
    """Tokens by id, and the rank of each pair of tokens that merges.

    A pair merges when its joined bytes are a token; the rank is that token's id.
    """

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        ids = {t: i for i, t in enumerate(tokens) if t is not None}
        self.byte_id = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ids[t[:k]], ids[t[k:]], i) for t, i in ids.items() for k in range(1, len(t))
                 if t[:k] in ids and t[k:] in ids]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        key = left << 32 | right
        order = np.argsort(key)
        self.key, self.rank = key[order], rank[order]
        #: merges after which a pair of lower rank can appear beside the new token
        self.turns_back = np.zeros(len(tokens), bool)
        self.turns_back[left[rank < left]] = True
        self.turns_back[right[rank < right]] = True

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)


def read_table(path: str, pattern: str) -> MergeTable:
    """Read a rank file (base64 token and id per line), on the driver; its size is fixed by the vocabulary."""
    with open(path, "rb") as f:
        entries = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]
    tokens: list = [None] * (max(i for _, i in entries) + 1)
    for token, i in entries:
        tokens[i] = token
    return MergeTable(tokens, pattern)


def replay(words: list[bytes], table: MergeTable) -> list[bytes]:
    """Ids (little-endian uint32) of each word, every word encoded on its own."""
    lengths = np.array([len(w) for w in words], np.int64)
    token = table.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    n = len(token)
    word = np.repeat(np.arange(len(words)), lengths)
    after = np.arange(1, n + 1)
    after[np.cumsum(lengths)[lengths > 0] - 1] = -1
    before = np.arange(-1, n - 1)
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = -1
    alive = np.ones(n, bool)
    here = np.full(n, NONE)  # rank of the pair that starts here
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(at: np.ndarray) -> None:
        follow = after[at]
        rank = np.where(follow >= 0, table.ranks_of(token[at], token[follow]), NONE)
        here[at] = rank
        at, rank = at[rank < NONE], rank[rank < NONE]
        if len(at):
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.r_[0, cut]].tolist(), np.split(at, cut)):
                if r not in index:
                    index[r] = []
                    heapq.heappush(queue, r)
                index[r].append(part)

    enter(np.flatnonzero(after >= 0))
    while queue:
        r = heapq.heappop(queue)
        at = np.unique(np.concatenate(index.pop(r)))
        at = at[here[at] == r]
        if not len(at):
            continue
        if table.turns_back[r]:  # one merge a word, as a pair of lower rank may come next
            _, leading = np.unique(word[at], return_index=True)
            if len(leading) < len(at):
                index[r] = [np.delete(at, leading)]
                heapq.heappush(queue, r)
            at = at[leading]
        else:  # of overlapping pairs in a row, every other one from the left
            step = np.arange(len(at))
            joined = np.r_[False, after[at[:-1]] == at[1:]]
            at = at[(step - np.maximum.accumulate(np.where(joined, 0, step))) % 2 == 0]
        gone = after[at]
        token[at] = r
        alive[gone] = False
        here[gone] = NONE
        after[at] = after[gone]
        inner = after[at] >= 0
        before[after[at][inner]] = at[inner]
        prior = before[at]
        enter(np.unique(np.concatenate([at, prior[prior >= 0]])))
    ids = token[alive].astype("<u4").tobytes()
    ends = np.cumsum(np.bincount(word[alive], minlength=len(words))) * 4
    return [ids[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]


def _encoded(batches, text: str, table: MergeTable):
    """(part of a batch, ids of each of its rows) of all batches."""
    split = regex.compile(table.pattern).findall
    whole = {t: np.uint32(i).tobytes() for i, t in enumerate(table.tokens) if t is not None}
    known: dict[str, bytes] = {}
    for batch in batches:
        for part in slices(batch, text, STRETCH_BYTES):
            rows = [split(t) if t else [] for t in part.column(text).to_pylist()]
            fresh = list(set().union(*rows).difference(known))
            raw = [w.encode() for w in fresh]
            ids = [whole.get(w) for w in raw]
            open_ = [i for i, x in enumerate(ids) if x is None]
            if open_:
                for i, x in zip(open_, replay([raw[i] for i in open_], table)):
                    ids[i] = x
            known.update(zip(fresh, ids))
            find = known.__getitem__
            yield part, [b"".join(map(find, r)) for r in rows]
            if len(known) > REMEMBERED_WORDS:
                known.clear()


def decoded(ids: bytes, table: MergeTable) -> bytes:
    """The bytes that little-endian uint32 ids stand for."""
    return b"".join(map(table.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _map(docs: DataFrame, table: MergeTable, column: str, keep: tuple[str, ...], added: str, work) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(table)
    out = docs.select(*keep, column)
    schema = ", ".join(f"`{k}` {out.schema[k].dataType.simpleString()}" for k in keep) + f", {added}"

    def run(batches):
        for part, *columns in work(batches, shared.value):
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *columns],
                                             names=[*keep, *(a.split()[0] for a in added.split(", "))])

    return out.mapInArrow(run, schema)


def encode(docs: DataFrame, table: MergeTable, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, ``ids`` (little-endian uint32) of each whole text.

    NULL counts as the empty text, which has no tokens. No special tokens are
    read or added. Each row stands alone: equal texts get equal ids, and the
    order and number of rows do not matter.
    """
    def work(batches, table):
        for part, ids in _encoded(batches, text, table):
            yield part, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())

    return _map(docs, table, text, keep, "n_tokens long, ids binary", work)


def decode(encoded: DataFrame, table: MergeTable, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``decoded``, the bytes that the ids of each row stand for (NULL ids: none)."""
    def work(batches, table):
        for batch in batches:
            for part in slices(batch, "ids", STRETCH_BYTES):
                yield part, pa.array([decoded(x or b"", table) for x in part.column("ids").to_pylist()], pa.binary())

    return _map(encoded, table, "ids", keep, "decoded binary", work)


def digests(docs: DataFrame, table: MergeTable, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode in one pass, keeping counts and digests only: ``n_tokens, ids_sha256, decoded_sha256``."""
    def work(batches, table):
        for part, ids in _encoded(batches, text, table):
            yield (part, pa.array([len(x) // 4 for x in ids], pa.int64()),
                   pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                   pa.array([hashlib.sha256(decoded(x, table)).hexdigest() for x in ids]))

    return _map(docs, table, text, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)
