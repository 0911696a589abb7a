"""Spelling variants, SentencePiece by prefix table and hard negatives, against brute force and the library."""
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from conftest import SF001
from quarry.llm import catalog, prefix_table, spelling, vertical_scan

PIECES = public_tokenizers.path("piece_bpe_32k.model")


# ---- spelling variants ---------------------------------------------------

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_forms(n, times):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def word_frame(spark, n):
    return spark.createDataFrame([(w, c, "x", 1) for w, c in n.items()], "word string, n int, root string, below int")


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_acceptor_accepts_its_words_and_is_minimal():
    words = sorted({"".join(p) for k in range(6) for p in itertools.product("ab", repeat=k)})
    a = spelling.Acceptor(words)
    assert len([s for s in {0, *(q for arcs in a.next for q in arcs.values())}]) >= 6
    got, stack, used = [], [(0, "")], set()
    while stack:
        s, w = stack.pop()
        used.add(s)
        if a.final[s]:
            got.append(w)
        stack += [(q, w + c) for c, q in a.next[s].items()]
    assert sorted(got) == words and len(used) == 6
    pairs = list(a.pairs(100))
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(x, y) for x in words for y in words if one_edit(x, y) and (len(x), x) < (len(y), y)}


@pytest.mark.parametrize("part_words", [4, 4096])
def test_forms_brute_force(spark, monkeypatch, part_words):
    monkeypatch.setattr(spelling, "PART_WORDS", part_words)
    rng = random.Random(part_words)
    n = {}
    while len(n) < 250:  # few letters: many neighbours, runs of equal letters, parts that must be split
        n["".join(rng.choice("aabé") for _ in range(rng.randrange(1, 9)))] = rng.choice([1, 2, 3, 20, 20, 300, 5000])
    n |= {"": 7, "𝔘": 3, "𝔘a": 40, "x" * 3000: 2, "x" * 2999: 30, "x" * 2990 + "y" * 9: 5, "y" + "x" * 2999: 400}
    assert rows(spelling.forms(word_frame(spark, n), 0, 10)) == brute_forms(n, 10)


def test_least_length_deals_longer_beginnings(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART_WORDS", 8)
    rng = random.Random(3)
    n = {"".join(rng.choice("ab") for _ in range(rng.randrange(7, 11))): rng.choice([1, 10, 100]) for _ in range(300)}
    assert rows(spelling.forms(word_frame(spark, n), 7, 10)) == brute_forms(n, 10)


def test_forms_odd_inputs(spark):
    assert spelling.forms(word_frame(spark, {})).count() == 0
    alone = spark.createDataFrame([("word", 3), (None, 9)], "word string, n long")
    assert rows(spelling.forms(alone)) == {("word", None, "word", 3, 0, None)}
    # equal counts: the first in code-point order, and chains
    n = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaaac": 10, "aaaaabc": 100, "aaaabbc": 999}
    assert rows(spelling.forms(word_frame(spark, n), 7, 10)) == brute_forms(n, 10)


def test_runs_of_letters(spark):
    docs = spark.createDataFrame([(1, "ÀBCdefg_hij×klmn ÀÉÎÕÜÝÞ abcdef"), (2, None), (3, ""), (None, "Abcdefgh"), (1, "ABCDEFGH" * 9000)],
                                 "doc_id long, text string")
    got = sorted(((r.doc_id, r.run) for r in spelling.occurrences(docs, "doc_id", "text", 7).collect()), key=str)
    want = [(1, "Àbcdefg"), (1, "hij×klmn"), (1, "ÀÉÎÕÜÝÞ"), (None, "abcdefgh"), (1, "abcdefgh" * 9000)]
    assert got == sorted(want, key=str)


def test_query_deletes_by_hash(spark):
    import re
    from pyspark.sql import types as T
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    n = {}
    for r in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] = n.get(run, 0) + 1
    n = {w: c for w, c in n.items() if c >= 2}
    got = catalog.QUERIES["op11_spelling_forms"](spark, SF001)
    assert [f.dataType for f in got.schema] == [T.StringType()] * 3 + [T.LongType()] * 3
    assert rows(got.select("word", "n")) == set(n.items())


# ---- SentencePiece by prefix table ---------------------------------------

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def table():
    return prefix_table.read_model(PIECES)


def odd_texts():
    rng = random.Random(12)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = ["", " ", "a", "  ", " " * 15, " " * 40 + "x", " " * 17 + "a" + " " * 31, "<s> <0x41> </s> <unk>", "▁a b", "a　b",
           "日本語 𝔘𝔘", "é", "\x00a", "ﬁ ½ ①", "\t\n\r\x0b", "aaaaaaa" * 300, "x" * 50_000, "word " * 20_000]
    out += ["".join(rng.choice("ab ▁\n.éß日本x0") for _ in range(rng.randrange(60))) for _ in range(300)]
    return out + ["".join(model.id_to_piece(rng.randrange(259, 32_000)) for _ in range(8)) for _ in range(300)]


def test_encode_and_decode_equal_the_library(spark, library, table):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "n", "i") for i, t in enumerate([None, *texts, *texts[:3]])],
                                 "doc_id long, text string, n_tokens string, ids string")
    encoded = prefix_table.encode(docs, table)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {i: library.encode(t or "") for i, t in enumerate([None, *texts, *texts[:3]])}
    back = {r.doc_id: r.decoded for r in prefix_table.decode(encoded, table).collect()}
    assert back == {i: library.decode(ids) for i, ids in got.items()}
    for r in prefix_table.digests(docs, table).collect():
        ids = got[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert prefix_table.digests(docs.limit(0), table).count() == 0


def test_stray_bytes_and_foreign_ids_decode(library, table):
    byte = table.byte_ids
    for ids in ([byte[0xE2], byte[0x81]], [byte[0xE2], byte[0x28], byte[0xFF], 300], [], [0, 300], [1, 300, 2], [300, 0]):
        assert table.decode(ids) == library.decode(ids)


def test_frequent_units_are_encoded_once_and_every_text_is_decoded(library, table, monkeypatch):
    texts = [f" again again x{i} y{i * 7}" for i in range(300)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t]}) for i, t in enumerate(texts)]
    monkeypatch.setattr(prefix_table, "REMEMBERED_UNITS", 10)
    monkeypatch.setattr(prefix_table, "_map", lambda docs, table, column, keep, added, work: work)
    met, kept = [], table.encode
    monkeypatch.setattr(table, "encode", lambda unit: met.append(unit) or kept(unit))
    # a model whose ids stand for other text than the unit
    plain = table.pieces_text
    monkeypatch.setattr(table, "pieces_text", lambda ids: plain(ids).replace("again", "AGAIN").replace("x", "X"))
    rows = [r for _, *r in prefix_table.digests(None, table)(iter(batches), table)]
    assert met.count("▁again") == 1 and len(met) > 600
    for t, (n, ids, texts_hash) in zip(texts, rows):
        want = library.encode(t)
        assert n[0].as_py() == len(want)
        assert ids[0].as_py() == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        shown = library.decode(want).replace("again", "AGAIN").replace("x", "X")
        assert texts_hash[0].as_py() == hashlib.sha256(shown.encode()).hexdigest()


def test_last_tokens_are_those_of_every_prefix(library, table):
    for text in odd_texts()[:200]:
        for unit in table.units.findall(table.normalized(text[:60])):
            assert [x for x in table.last_tokens(unit) if x is not None] == [
                t for t in (table.merged(unit[:i + 1])[0][-1] for i in range(len(unit))) if t in table.rank]


def test_compatibility_equals_merging(table):
    rng = random.Random(5)
    names = list(table.right)
    for _ in range(20_000):
        u, t = rng.choice(names), rng.choice(names)
        assert table.compatible(u, t) == (table.merged(u + t)[0] == [u, t])


def test_models_that_cannot_be_read_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto
    model = proto.ModelProto()
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    path = tmp_path / "m.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="only BPE"):
        prefix_table.read_model(str(path))


def test_query_of_pieces(spark, library):
    got = {r.doc_id: r for r in catalog.QUERIES["op12_prefix_table"](spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text)
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# ---- hard negatives ------------------------------------------------------

def brute_negatives(data, positives=5, negatives=5):
    """data: (id, label, integer vector, anchor) with unique ids."""
    out = set()
    def score(a, b):
        return sum(x * y for x, y in zip(a, b))
    for i, label, v, anchor in data:
        if not anchor:
            continue
        every = sorted((-score(v, w), j, m) for j, m, w, _ in data if j != i)
        mine = [(-s, j) for s, j, m in every if m == label][:positives]
        for p, j in mine:
            found = [(-s, k) for s, k, m in every if m != label and 80 * p <= 100 * -s <= 100 * p][:negatives]
            out |= {(i, j, r, k, p, s) for r, (s, k) in enumerate(found, 1)}
    return out


def vector_frame(spark, data):
    return spark.createDataFrame([(i, m, [int(x) for x in v], a, "w", 1) for i, m, v, a in data],
                                 "id long, label long, v array<long>, anchor boolean, w string, block int")


@pytest.mark.parametrize("rows_a_block", [16, 8192])
def test_mine_brute_force(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(vertical_scan, "BLOCK_ROWS", rows_a_block)
    monkeypatch.setattr(vertical_scan, "BLOCK_ANCHORS", rows_a_block)
    monkeypatch.setattr(vertical_scan, "BUNDLE", 4 if rows_a_block == 16 else 256)
    rng = np.random.default_rng(rows_a_block)
    v = rng.integers(-30, 40, (260, 12))
    v[100:140] = v[99]  # equal vectors: ties
    v[150:160] = 0
    label = np.where(rng.random(260) < 0.4, 1, rng.integers(-4, 60, 260))  # one hot label, many with few rows
    data = [(int(i), int(label[i]), v[i].tolist(), bool(i % 9 == 0)) for i in range(260)]
    data += [(1000, 7, [], True), (1001, 7, [5], True), (1002, 7, [5] * 12, True), (1003, 3, [1 << 28] * 12, False),
             (1004, 7, [1 << 28] * 12, True)]
    got = rows(vertical_scan.mine(vector_frame(spark, data)))
    assert got == brute_negatives(data) and len(got) > 100


def test_scan_keeps_the_best_of_every_window():
    rng = np.random.default_rng(1)
    columns = rng.integers(-50, 50, (16, 500))
    for _ in range(50):
        q = rng.integers(-50, 50, 16) * (rng.random(16) < 0.5)
        exact = q @ columns
        alive = rng.random(500) < 0.7
        lo, hi = sorted(rng.integers(-20_000, 20_000, 2).tolist())
        windows = np.array([[lo, hi], [hi, vertical_scan.FAR]])
        at, score = vertical_scan.scan(q, columns, columns.min(1), columns.max(1), alive, windows, 5)
        assert (score == exact[at]).all() and alive[at].all()
        for a, b in windows:
            want = sorted(-s for s in exact[alive & (exact >= a) & (exact <= b)])[:5]
            assert sorted(-s for s in score[(score >= a) & (score <= b)])[:5] == want


def test_scan_prunes():
    rng = np.random.default_rng(2)
    columns = rng.integers(-50, 50, (64, 4000))
    columns[:8] *= 20
    q = rng.integers(-5, 5, 64)
    q[:8] = 50
    at, _ = vertical_scan.scan(q, columns, columns.min(1), columns.max(1), np.ones(4000, bool),
                               np.array([[-vertical_scan.FAR, vertical_scan.FAR]]), 5)
    assert len(at) < 400


def test_prepared_leaves_out_what_has_no_score(spark):
    df = spark.createDataFrame(
        [(1, 1, [0.5, -0.001]), (2, None, [1.0]), (3, 1, None), (4, 1, [None, 1.0]), (5, 1, [float("nan")]),
         (6, 1, [float("inf")]), (None, 1, [1.0]), (7, 1, [])], "vec_id long, label int, embedding array<double>")
    got = vertical_scan.prepared(df, "vec_id", F.col("label"), "embedding", F.col("vec_id") == 1)
    assert sorted((r.id, r.v, r.anchor) for r in got.collect()) == [(1, [128, -1], True), (7, [], False)]
    assert vertical_scan.mine(got).count() == 0
    assert vertical_scan.mine(got.where("false")).count() == 0


def test_repeated_ids(spark):
    data = [(1, 1, [3, 1], True), (1, 1, [3, 1], True), (2, 1, [2, 2], False), (2, 1, [2, 2], False), (3, 2, [2, 1], False),
            (3, 2, [2, 1], False)]
    got = sorted(tuple(r) for r in vertical_scan.mine(vector_frame(spark, data)).collect())
    assert got == sorted([(1, 2, 1, 3, 8, 7), (1, 2, 2, 3, 8, 7)] * 2)
