"""SentencePiece BPE by a table of last tokens, and its inverse.

A BPE encoding has the prefix property: the encoding of a text without its last
token is the encoding of the shorter text. So every prefix of a text has one
last token, and a table of them holds the whole encoding. The table is filled
from left to right: an automaton of all pieces gives those that end at a place,
and a piece is the last token there if it is *compatible* with the last token of
the prefix before it, that is, if no merge ever crosses the border of the two.
The ids are then read backwards from the end.

Two pieces are compatible when, of the symbols beside their border, no pair
merges before one of the two symbols has been merged into its own piece. The
order of these events is the order of the pieces' scores, equal scores from the
left. Characters outside of the vocabulary never merge and become byte tokens.
"""

from __future__ import annotations

import hashlib
import math
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import slices

MARK = "▁"
#: Bytes of text that are encoded together, and units and pairs a task remembers; they only bound memory. Units that
#: are met again among the next ``REMEMBERED_UNITS`` stay.
STRETCH_BYTES = 2 << 20
REMEMBERED_UNITS, REMEMBERED_PAIRS = 200_000, 2_000_000
NORMAL, BYTE = 1, 6  # piece types of the model file


class PieceTable:
    """The pieces of a BPE model with their scores, how each is merged, and what follows from it."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int], dummy_prefix: bool):
        self.rank = {p: -score for _, p, score in pieces}
        self.id = {p: i for i, p, _ in pieces}
        self.name = {i: p for i, p, _ in pieces}
        self.byte_ids, self.byte_of = byte_ids, {i: b for b, i in enumerate(byte_ids)}
        self.dummy_prefix = dummy_prefix
        # without pieces that have a mark after another character, no merge crosses the start of a run of marks
        words = all(MARK not in p.lstrip(MARK) for p in self.rank)
        self.units = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if words else r"(?s).+")
        self._derive()
        self._automaton = None

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces of a short text by plain merging, and the last pair merged."""
        parts, last = list(text), None
        while True:
            best, at = math.inf, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                return parts, last
            last = parts[at], parts[at + 1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _derive(self) -> None:
        """Edges of each piece: the symbols at its right and left end while it is merged, and when each is used up.

        Pieces that merging never gives are left out. A piece is *ordered* if each of its merges comes after those it
        is made of; the others (such as runs of marks, which share one score) are tested by merging.
        """
        self.right: dict[str, tuple] = {}
        self.left: dict[str, tuple] = {}
        split = {}
        for p in sorted(self.rank, key=len):
            if len(p) == 1:
                self.right[p] = self.left[p] = ((p, math.inf),)
                continue
            parts, last = self.merged(p)
            if len(parts) != 1:
                continue
            split[p] = last
            r = self.rank[p]
            chains = []
            for side, half in ((self.right, last[1]), (self.left, last[0])):
                inner = side.get(half) if len(half) > 1 else ((half, math.inf),)
                ordered = inner and all(len(x) == 1 or (self.rank[x] < r and self._ordered(x)) for x in last)
                chains.append((*inner[:-1], (half, r), (p, math.inf)) if ordered else ())
            self.right[p], self.left[p] = chains

    def _ordered(self, piece: str) -> bool:
        return bool(self.right.get(piece)) and bool(self.left.get(piece))

    def compatible(self, u: str, t: str) -> bool:
        """Whether the text u + t is encoded as these two pieces."""
        right, left, rank = self.right[u], self.left[t], self.rank
        if not right or not left:
            return self.merged(u + t)[0] == [u, t]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = right[i], left[j]
            across = rank.get(x + y)
            # of equal scores the leftmost merge comes first
            if across is not None and across < x_ends and across <= y_ends:
                return False
            if x_ends <= y_ends:
                if x_ends == math.inf:
                    return True
                i += 1
            else:
                j += 1

    @property
    def automaton(self):
        """Of all pieces, made once a process; each stands with its length, id and which pieces may follow it."""
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for p in self.right:
                a.add_word(p, (p, len(p), self.id[p], {}))
            a.make_automaton()
            self._automaton, self._tested = a, 0
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def _last(self, unit: str) -> list[tuple | None]:
        last = [None] * len(unit)
        for end, piece in self.automaton.iter(unit):
            if last[end] is not None:
                continue
            t, n, _, _ = piece
            start = end - n
            if start >= 0:
                before = last[start]
                if before is not None:
                    fits = before[3]
                    ok = fits.get(t)
                    if ok is None:
                        ok = fits[t] = self.compatible(before[0], t)
                        self._tested += 1
                    if not ok:
                        continue
            last[end] = piece
        if self._tested > REMEMBERED_PAIRS:
            for _, _, _, fits in self.automaton.values():
                fits.clear()
            self._tested = 0
        return last

    def last_tokens(self, unit: str) -> list[str | None]:
        """The last token of each prefix of a text, by the prefix's last character; None for a byte-coded one."""
        return [piece and piece[0] for piece in self._last(unit)]

    def encode(self, unit: str) -> list[int]:
        """Ids of a text, read backwards from the table of last tokens."""
        last, ids, at = self._last(unit), [], len(unit) - 1
        while at >= 0:
            piece = last[at]
            if piece is None:
                ids += [self.byte_ids[b] for b in reversed(unit[at].encode())]
                at -= 1
            else:
                ids.append(piece[2])
                at -= piece[1]
        ids.reverse()
        return ids

    def pieces_text(self, ids: list[int]) -> str:
        """The characters that ids stand for, marks as spaces; stray bytes become U+FFFD."""
        try:
            return "".join([self.name[i] for i in ids]).replace(MARK, " ")
        except KeyError:  # bytes, or ids that are no pieces
            out, held = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(_characters(held))
                held = bytearray()
            out.append(self.name.get(i, " ⁇ " if i == 0 else ""))
        if held:
            out.append(_characters(held))
        return "".join(out).replace(MARK, " ")

    def normalized(self, text: str | None) -> str:
        """Spaces become marks, one mark is put in front; the empty text stays empty."""
        if not text:
            return ""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    def decode(self, ids: list[int]) -> str:
        text = self.pieces_text(ids)
        return text[1:] if self.dummy_prefix and text.startswith(" ") and ids[0] else text


def _characters(raw: bytearray) -> str:
    """UTF-8 to text, each byte that belongs to no character as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at:at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def read_model(path: str) -> PieceTable:
    """Read a BPE model with byte fallback and no normalisation, on the driver; its size is fixed by the vocabulary."""
    from sentencepiece import sentencepiece_model_pb2 as proto
    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    if (train.model_type != train.BPE or not train.byte_fallback or norm.precompiled_charsmap or train.treat_whitespace_as_suffix
            or norm.remove_extra_whitespaces or not norm.escape_whitespaces
            or any(p.type not in (NORMAL, BYTE, 2, 3) for p in model.pieces)):
        raise ValueError(f"{path}: only BPE models with byte fallback, normal pieces and without normalisation are read")
    normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL]
    byte_ids = [0] * 256
    for i, p in enumerate(model.pieces):
        if p.type == BYTE:
            byte_ids[int(p.piece[1:-1], 16)] = i
    return PieceTable(normal, byte_ids, norm.add_dummy_prefix)


def _encoded(batches, text: str, table: PieceTable, store):
    """(part of a batch, its rows as lists of units, by unit what ``store`` makes of the unit and its ids, the same of
    units met before) of all batches.

    The rows' units are in the first dictionary: what is met again moves on from the second, and the rest goes with it."""
    known, before = {}, {}
    for batch in batches:
        for part in slices(batch, text, STRETCH_BYTES):
            rows = [table.units.findall(table.normalized(t)) for t in part.column(text).to_pylist()]
            for unit in set().union(*rows).difference(known):
                kept = before.get(unit)
                known[unit] = store(unit, table.encode(unit)) if kept is None else kept
            yield part, rows, known, before
            if len(known) > REMEMBERED_UNITS:
                known, before = {}, known


def _map(docs: DataFrame, table: PieceTable, column: str, keep: tuple[str, ...], added: str, work) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(table)
    out = docs.select(*keep, column)
    schema = ", ".join(f"`{k}` {out.schema[k].dataType.simpleString()}" for k in keep) + f", {added}"

    def run(batches):
        for part, *columns in work(batches, shared.value):
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *columns],
                                             names=[*keep, *(a.split()[0] for a in added.split(", "))])

    return out.mapInArrow(run, schema)


def encode(docs: DataFrame, table: PieceTable, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids`` (array of int) of each whole text.

    NULL counts as the empty text, which has no ids. No begin or end ids are
    added; strings that look like control or byte pieces are ordinary text. Each
    row stands alone: equal texts get equal ids, and the order and number of rows
    do not matter. Other columns are ignored, an empty table gives an empty result.
    """
    def work(batches, table):
        for part, rows, known, _ in _encoded(batches, text, table, lambda unit, ids: tuple(ids)):
            yield part, pa.array([[i for unit in r for i in known[unit]] for r in rows], pa.list_(pa.int32()))

    return _map(docs, table, text, keep, "ids array<int>", work)


def decode(encoded: DataFrame, table: PieceTable, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``decoded``, the text that the ids of each row stand for (NULL ids: the empty text)."""
    def work(batches, table):
        for batch in batches:
            yield batch, pa.array([table.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())

    return _map(encoded, table, "ids", keep, "decoded string", work)


def digests(docs: DataFrame, table: PieceTable, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode in one pass, keeping counts and digests only: ``n_tokens, ids_sha256, decoded_sha256``.

    The ids are hashed as decimal numbers joined by commas. No unit starts inside of a character, so the texts of a
    row's units are decoded apart and joined; a unit's text is kept only if it is not the unit itself with spaces for
    marks.
    """
    def work(batches, table):
        other: dict[str, str] = {}

        def decimal(unit, ids):
            decoded = table.pieces_text(ids)
            if decoded != unit.replace(MARK, " "):
                other[unit] = decoded
            return ",".join(map(str, ids))

        for part, rows, known, before in _encoded(batches, text, table, decimal):
            ids = [",".join(map(known.__getitem__, r)) for r in rows]
            texts = ["".join(r).replace(MARK, " ") if other.keys().isdisjoint(r) else
                     "".join([other[u] if u in other else u.replace(MARK, " ") for u in r]) for r in rows]
            if table.dummy_prefix:
                texts = [t[1:] if t.startswith(" ") else t for t in texts]
            yield (part, pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()),
                   pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids], pa.string()),
                   pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()))
            if len(other) > 3 * REMEMBERED_UNITS:
                for u in [u for u in other if u not in known and u not in before]:
                    del other[u]

    return _map(docs, table, text, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)
