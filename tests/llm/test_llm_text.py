"""Text operators against brute force, and their edge cases."""
import hashlib
import itertools
import math
import random
import re
import string

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quarry.llm import bpe, chains, langid, line_dedup, mixing, ngram_join, pii
from quarry.llm import shingles as shingles_of
from quarry.llm.shingles import shingle_set, word_hashes

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Rows (doc_id, text) with columns whose names clash with inner ones."""
    rows = [(i, t, i, "x", 1.0, "k") for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, h string, size double, key string")


def closure(ids, links):
    label = {i: i for i in ids}
    while True:
        new = dict(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


# ---- n-gram Jaccard join -------------------------------------------------

def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    if not words:
        return set()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


def test_word_hashes_agree_with_words():
    import pyarrow as pa
    texts = ["Ab cäß　x\x1cy", None, "", "  ", "ab\x0bAB\tab", "x" * 3000 + " y", "é", "a", "b"]
    h, first = word_hashes(pa.array(texts))
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
             for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in words]
    flat = sum(words, [])
    seen = {}
    assert all(seen.setdefault(w, x) == x for w, x in zip(flat, h.tolist())) and len(set(h.tolist())) == len(set(flat))


@pytest.mark.parametrize("size,num", [(4, 85), (5, 80)])
def test_jaccard_groups_brute_force(spark, size, num):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 90))] for _ in range(14)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if i % 3 == 0:
            w += base[0][:25]
        rows.append((i, " ".join(w).upper() if i % 2 else " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \t"), (503, "one two"), (504, "ONE two"), (505, "one"), (506, "w1 " * 5000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(frame(spark, rows), size, num).collect()}
    sets = {i: shingles(t, size) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    assert len(links) > 50
    label = closure(sets, links)
    assert got == {i: (len(sets[i]), label[i]) for i in sets}


def test_jaccard_groups_empty(spark):
    out = ngram_join.jaccard_groups(frame(spark, []))
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.count() == 0


def test_shingles_of_many_rows_are_those_of_each():
    texts = ["a b c d a b c d a", None, "", "a b", "a", " \n", "x y z w\n" * 70, "one two three four five", "a b c"]
    for size in (1, 4, 5):
        words, first = word_hashes(pa.array(texts, pa.string()))
        sets, start = shingles_of.shingle_sets(words, first, size)
        every, at = shingles_of.row_shingles(words, first, size)
        for i, text in enumerate(texts):
            own = words[first[i]:first[i + 1]]
            assert sets[start[i]:start[i + 1]].tolist() == shingle_set(own, size).tolist()
            n = len((text or "").split())
            assert at[i + 1] - at[i] == (max(n - size + 1, 1) if n else 0)
            assert set(every[at[i]:at[i + 1]].tolist()) == set(sets[start[i]:start[i + 1]].tolist())


def test_leading_blocks_hold_the_rarest_shingles(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 40)))) for i in range(60)] + [(99, None)]
    docs = frame(spark, rows).select("doc_id", "text")
    counts = ngram_join.frequency_sketch(docs, 2)
    assert counts.sum() == sum(max(len(t.split()) - 1, min(len(t.split()), 1)) for _, t in rows if t)
    for r in ngram_join.incidence(docs, 2, 85, 100).collect():
        words, _ = word_hashes(pa.array([dict(rows)[r.doc_id]], pa.string()))
        want = shingle_set(words, 2)
        order = sorted(want.tolist(), key=lambda x: (int(counts[x >> 44]).bit_length(), x))
        assert r.n == len(want) and [x % 2 ** 64 for x in r.lead] == order[:ngram_join.leading_length(len(want), 85, 100)]
        bits = [sum((x >> 7) % 2048 == b for x in want.tolist()) % 2 for b in range(2048)]
        assert [x % 2 ** 64 for x in r.sig] == np.packbits(np.array(bits, np.uint8)).view(np.uint64).tolist()


def test_pairs_of_long_columns_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    rows, schema = [], "s long, d long, n long, i int, c long, " + ", ".join(f"g{j} long" for j in range(32))
    for s, k in ((1, 1200), (-5, 90), (7, 1)):
        for d in rng.sample(range(5000), k):
            n = rng.randint(80, 100)
            bits = rng.sample(range(2048), rng.randint(0, 9))
            sig = [sum(1 << (b % 64) for b in bits if b // 64 == j) for j in range(32)]
            rows.append((s, d, n, rng.randint(0, 14), d // 40, *(x - 2 ** 64 if x >= 2 ** 63 else x for x in sig)))
    out = ngram_join._shared_long_columns(spark.createDataFrame(rows, schema).repartition(3), 85, 100)
    got = sorted(map(tuple, out.select("a", "b", "na", "nb", "ia", "ib").collect()))
    want = []
    for s in (1, -5, 7):
        column = sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1]))
        for (_, a, na, ia, ca, *ga), (_, b, nb, ib, cb, *gb) in itertools.combinations(column, 2):
            need = math.ceil((na + nb) * 85 / 185)
            if ca != cb and 100 * na >= 85 * nb and ia <= na - need and ib <= nb - need:
                if sum(((x ^ y) % 2 ** 64).bit_count() for x, y in zip(ga, gb)) <= na + nb - 2 * need:
                    want.append((a, b, na, nb, ia, ib))
    assert len(want) > 1000 and got == sorted(want)


def test_shingle_set_of_short_text():
    w = np.arange(3, dtype=np.uint64)
    assert len(shingle_set(w, 4)) == 1 and len(shingle_set(w[:0], 4)) == 0


# ---- language ------------------------------------------------------------

def test_word_scores_sum_all_segmentations():
    pieces = langid.Pieces(["▁a", "ab", "b", "▁", "a", "▁ab", "ba", "bab", "X", "1"])
    assert "X" not in pieces.pieces and "1" not in pieces.pieces
    rng = np.random.default_rng(0)
    prob = rng.random((len(pieces.pieces), 2))
    prob /= prob.sum(0)
    number = {p: i for i, p in enumerate(pieces.pieces)}

    def total(s, j):
        if not s:
            return 1.0
        out = 0.0
        for k in range(1, len(s) + 1):
            p = prob[number[s[:k]], j] if s[:k] in number else (langid.UNKNOWN if k == 1 else 0.0)
            out += p * total(s[k:], j) if p else 0.0
        return out

    words = ["a", "b", "ab", "ba", "abab", "babab", "zab", "abcba", "a" * 20]
    got = np.exp(langid.word_scores(words, pieces, prob))
    want = np.array([[total("▁" + w, j) for j in range(2)] for w in words])
    assert np.allclose(got, want, rtol=1e-9)
    counts = langid.expected_counts(["ab"], np.ones((1, 2)), pieces, prob)
    # each segmentation's share of pieces, by enumeration
    segs = [["▁", "a", "b"], ["▁a", "b"], ["▁", "ab"], ["▁ab"]]
    for j in range(2):
        weight = [np.prod([prob[number[p], j] for p in s]) for s in segs]
        for p in ("▁", "a", "b", "ab", "▁a", "▁ab"):
            want = sum(w for w, s in zip(weight, segs) if p in s) / sum(weight)
            assert counts[number[p], j] == pytest.approx(want)


def test_language_edges_and_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    edge = spark.createDataFrame([(10 ** 6, None, "en", "s", 0), (10 ** 6 + 1, "", "en", "s", 0), (10 ** 6 + 2, "12 !?", "de", "s", 5),
                                  (None, "the and of", "en", "s", 3), (10 ** 6 + 3, "x" * 100_000, None, "s", 1),
                                  (10 ** 6 + 4, "the", "en", "s", 3), (10 ** 6 + 4, "the", "en", "s", 3)], DOC)
    out = langid.identify(docs.unionByName(edge), public_tokenizers.path("piece_bpe_32k.model"))
    rows = out.collect()
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and len(rows) == docs.count() + 7
    by = {r.doc_id: r for r in rows}
    assert all(by[10 ** 6 + i].lang_pred == "und" and by[10 ** 6 + i].score == 0 for i in range(3))
    assert by[None].lang_pred == "en" and not by[None].held_out and by[10 ** 6 + 3].lang_pred != "und"
    import zlib
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in lang]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_without_rows_or_labels(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert langid.identify(spark.createDataFrame([], DOC), path).count() == 0
    row = langid.identify(spark.createDataFrame([(1, "the", None, "s", 3)], DOC), path).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)


def test_letters_are_letters_only():
    import unicodedata
    assert langid.LETTERS.findall("a²b ½ ① Ⅷ 7 _x é 日本 ٣ aͅ") == ["a", "b", "x", "é", "日本", "a"]
    for c in map(chr, range(0x30000)):
        assert bool(langid.LETTERS.fullmatch(c)) == unicodedata.category(c).startswith("L"), c


def test_numerals_have_no_language(spark):
    rows = [(i, f"the whole text number {i} of some words", "en", "s", 3) for i in range(20)] + [(90, "² ½ ① Ⅷ", "en", "s", 3)]
    out = langid.identify(spark.createDataFrame(rows, DOC), public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}[90] == ("und", 0.0)


def test_long_words_are_scored_whole():
    pieces = langid.Pieces(["a", "b", "ab", "ba", "aba", langid.MARK, langid.MARK + "a"])
    rng = np.random.default_rng(3)
    prob = rng.random((len(pieces.pieces), 2)) / 4
    words = ["".join(rng.choice(list("abx"), n)) for n in (1, 5, 47, 48, 49, 200, 5000)] + ["ab", "ba"]
    got = langid.word_scores(words, pieces, prob)
    number = {p: i for i, p in enumerate(pieces.pieces)}
    for w, row in zip(words, got):
        s = langid.MARK + w
        for j in range(2):
            a, log = [1.0], 0.0
            for e in range(1, len(s) + 1):
                x = sum(a[b] * (prob[number[s[b:e]], j] if s[b:e] in number else langid.UNKNOWN if e - b == 1 else 0.0)
                        for b in range(max(0, e - 3), e))
                a.append(x)
                if x < 1e-60:
                    a, log = [0.0] * (len(a) - 3) + [v * 1e60 for v in a[-3:]], log - math.log(1e60)
            assert row[j] == pytest.approx(math.log(a[-1]) + log, rel=1e-9)


# ---- lines ---------------------------------------------------------------

def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_lines(rows, least=0):
    seen, gone, out = [], set(), {}
    for i, text in rows:
        if text is None:
            out[i] = (None, 0, 0)
            continue
        keep = []
        for line in text.split("\n"):
            if not line.strip(" \t\r\x0b\x0c"):
                keep.append(line)
                continue
            # a line goes for an earlier one that stays; one of fewer than ``least`` characters only for an equal one
            if line in gone or any(line == s or (min(len(line), len(s)) >= least and within_one(line, s)) for s in seen):
                gone.add(line)
            else:
                keep.append(line)
                seen.append(line)
        out[i] = ("\n".join(keep), len(text.split("\n")), len(keep))
    return out


@pytest.mark.parametrize("block,least", [(128, 0), (3, 0), (128, 12)])
def test_dedup_lines_brute_force(spark, monkeypatch, block, least):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(2)
    base = ["".join(rng.choices("ab é", k=rng.randint(0, 16))) for _ in range(40)]

    def change(s):
        s, k = list(s), rng.random()
        if s and k < .3:
            s[rng.randrange(len(s))] = rng.choice("abé")
        elif s and k < .5:
            del s[rng.randrange(len(s))]
        elif k < .7:
            s.insert(rng.randint(0, len(s)), rng.choice("ab"))
        return "".join(s)

    rows = [(i, None if i % 17 == 0 else "\n".join(change(rng.choice(base)) for _ in range(rng.randint(0, 6)))) for i in range(70)]
    rows += [(900, ""), (901, "z" * 5000 + "\n" + "y" * 40), (902, "z" * 4999 + "\n" + "y" * 41), (903, "\n\n")]
    out = line_dedup.dedup_lines(frame(spark, rows), least=least)
    assert out.columns == ["doc_id", "text", "n", "h", "size", "key", "n_lines", "n_kept"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in out.collect()} == brute_lines(rows, least)


def test_numbered_lines_stay_unless_a_kept_line_is_near(spark):
    rows = [(1, "\n".join(f"a numbered line {i}" for i in range(1000, 1200)))]
    kept = line_dedup.dedup_lines(frame(spark, rows)).first()
    assert kept.n_kept == brute_lines(rows)[1][2] == 20
    # a chain: every second line stays
    rows = [(i, "x" * (i + 1)) for i in range(12)]
    assert [r.text for r in line_dedup.dedup_lines(frame(spark, rows)).orderBy("doc_id").collect()] == [
        "x" * (i + 1) if i % 2 == 0 else "" for i in range(12)]


def test_long_lines_that_share_a_half_do_not_all_meet(spark):
    """Lines meet in a key only if they agree in all but one place."""
    rng = random.Random(8)
    half = "".join(rng.choices("abcdé", k=600))
    lines = [half + "".join(rng.choices("abcdé", k=600)) for _ in range(60)]
    lines += [x[:700] + "Z" + x[701:] for x in lines[:5]] + [x[:1000] + x[1001:] for x in lines[5:10]] + ["q" + x for x in lines[10:15]]
    rows = [(i, x) for i, x in enumerate(lines)]
    out = {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert out == brute_lines(rows) and sum(r[2] for r in out.values()) == 60
    line, n, faced = F.col("text"), F.length("text"), F.lit(15)
    keys = frame(spark, rows).select("doc_id", F.explode(line_dedup.variant_keys(line, n, faced)).alias("k"))
    met = keys.alias("a").join(keys.alias("b"), "k").where("a.doc_id < b.doc_id").select("a.doc_id", "b.doc_id").distinct()
    assert met.count() == 15


def test_exploded_line_keys_are_never_broadcast(spark, monkeypatch):
    links, settle = [], line_dedup.settled
    monkeypatch.setattr(line_dedup, "settled", lambda close: links.append(close) or settle(close))
    rows = [(1, "a line of some length\nanother line"), (2, "a line of some lengths\nsomething else")]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: "something else"}
    plan = links[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "BroadcastHashJoin" not in plan


def test_dedup_lines_edges(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    rows = line_dedup.dedup_lines(frame(spark, [(None, "same line"), (1, "same line"), (1, "same line"), (2, "same line")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == [(0, "same line"), (1, "same line"), (1, "same line"), (2, "")]


# ---- mixing --------------------------------------------------------------

def test_mix_edges(spark):
    rows = ([(i, "a", 10) for i in range(300)] + [(1000 + i, "b", 3) for i in range(40)] + [(2000, None, 5), (2001, "", 7)]
            + [(3000 + i, "c", 0) for i in range(3)] + [(None, "a", 10), (5, "a", 10)])
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, size long, target string, copies int")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and sorted(out, key=str) == sorted(mixing.mix(df).collect(), key=str)
    total = sum(r[2] for r in rows)
    assert sum(r.size * r.copies for r in out) <= total and all(0 <= r.copies <= 3 for r in out)
    # '' a b c None by code point: weights 5 2 1 5 2
    size = {"": 7, "a": 3020, "b": 120, "c": 0, None: 5}
    want = {"": 21.0, "b": 360.0, "c": 0.0, None: 15.0, "a": total - 396.0}
    assert {r.source_size: round(r.target, 6) for r in out} == {size[s]: want[s] for s in size}
    taken = {}
    for r in out:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.size * r.copies
    assert all(want[s] - 10 < taken[size[s]] <= want[s] + 1e-6 for s in size)
    assert mixing.mix(df.limit(0)).count() == 0


# ---- BPE -----------------------------------------------------------------

def test_bpe_equals_tiktoken_and_round_trips(spark):
    table = bpe.read_table(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks={t: i for i, t in enumerate(table.tokens)})
    rng = random.Random(1)
    alphabet = ["a", "b", " ", "\n", "\t", "\x1c", "\x85", "é", "漢", "1", "٣", "'s", "'", "!", "  ", "aaaaaaa", "　",
                "🙂", "the", "ing", "​", "0000", "<|endoftext|>"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(400)]
    texts += ["a" * 5000, "ab" * 3000, " " * 4000, "", None, "x " * 60_000]
    rows = list(enumerate(texts))
    df = frame(spark, rows + rows[:3])
    ids = bpe.encode(df, table)
    want = {i: own.encode_ordinary(t or "") for i, t in rows}
    got = ids.collect()
    assert len(got) == len(rows) + 3
    assert all(np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id] and r.n_tokens == len(want[r.doc_id]) for r in got)
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, table).collect()} == {i: (t or "").encode() for i, t in rows}
    for r in bpe.digests(df, table).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.digests(df.limit(0), table).count() == 0


# ---- passages ------------------------------------------------------------

def test_passages_planted(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]

    def words(n):
        return [rng.choice(vocab) for _ in range(n)]

    passages = [words(60) for _ in range(4)]
    rows, planted = [], {}
    for i in range(120):
        w = words(rng.randint(0, 200))
        if i % 4 == 1:
            k = i // 4 % 4
            p, at = passages[k], rng.randint(0, len(w))
            w = w[:at] + p + w[at:]
            planted.setdefault(k, []).append((i, at, at + 60))
        if i % 4 == 3:  # parts too short to count
            p = words(60) if i % 8 == 3 else passages[0]
            w = w + p[:rng.randint(20, 44)]
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " "), (903, "again " * 3000), (904, "again " * 3000), (905, "one two")]
    out = chains.passages(frame(spark, rows)).collect()
    got = {r.doc_id: r for r in out if r.doc_id < 900}
    later = {i: (s, e) for places in planted.values() for i, s, e in places[1:]}
    assert set(got) == set(later)
    assert all((got[i].start, got[i].end, got[i].identity) == (s, e, 1.0) for i, (s, e) in later.items())
    assert [(r.doc_id, r.src_doc_id, r.start, r.end) for r in out if r.doc_id > 900] == [(904, 903, 0, 3000)]
    assert chains.passages(frame(spark, [])).count() == 0


def test_fuzzy_passage_and_repeated_rows(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    other = list(base)
    for at in (30, 31, 70, 95):
        other[at] = "zz"
    del other[50]
    rows = [(1, "head " + " ".join(base)), (2, "x y " + " ".join(other) + " tail"), (2, "x y " + " ".join(other) + " tail"), (3, "free")]
    got = {r.doc_id: r for r in chains.passages(frame(spark, rows)).collect()}
    assert set(got) == {2} and (got[2].src_doc_id, got[2].start, got[2].end) == (1, 2, 121)
    assert got[2].identity == pytest.approx(115 / 120, abs=0.01)


def test_chain_matches_quadratic_search():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        x, y = rng.integers(0, 120, n), rng.integers(0, 120, n)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        best = np.zeros(n)
        for i in range(n):
            gain = [best[j] - chains.GAP * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
            best[i] = chains.MATCH + max([0.0, *gain])
        top = chains.chain(x, y)[0]
        score = chains.MATCH * len(top) - chains.GAP * ((x[top[-1]] - x[top[0]]) + (y[top[-1]] - y[top[0]]))
        assert score == pytest.approx(best.max())


def distinct_words(prefix, n):
    return [f"{prefix}{i}" for i in range(n)]


@pytest.mark.parametrize("gap", [30, 60, 250])
@pytest.mark.parametrize("second", [8, 60])
def test_passages_of_one_pair_over_a_gap(spark, gap, second):
    p, q = distinct_words("p", 60), distinct_words("q", second)
    rows = [(i, " ".join(distinct_words(f"h{i}x", 9) + p + distinct_words(f"g{i}x", gap) + q + distinct_words(f"t{i}x", 9)))
            for i in (1, 2)]
    got = sorted((r.doc_id, r.start, r.end, r.src_start, r.src_end, r.identity) for r in chains.passages(frame(spark, rows)).collect())
    want = [(2, 9, 69, 9, 69, 1.0)] + [(2, 69 + gap, 129 + gap, 69 + gap, 129 + gap, 1.0)] * (second == 60)
    if (gap, second) == (30, 60):  # 120 of 150 words
        want = [(2, 9, 159, 9, 159, 0.8)]
    assert got == want


def test_parts_of_an_alignment_that_fails_as_a_whole():
    # 26 + 3 odd + 26 words pass; the 4-word runs after them do not
    starts = [0, 29, *range(58, 200, 7)]
    runs = np.array([(x, x, 26 if x < 58 else 4, 0) for x in starts])
    out = chains.judged(runs)
    assert out[0][0] == 0 and out[0][1] >= 55 and all(same >= chains.IDENTITY * (e - s) for s, e, _, _, same in out)
    assert chains.judged(runs[2:]) == [] and chains.judged(runs[:0]) == []


def test_exact_passage_inside_a_longer_chain_that_fails(spark):
    a, p = distinct_words("a", 400), distinct_words("p", 80)
    # 14 words of each 34 of document 1, with the passage of document 2 between
    shared = [w for i in range(0, 400, 34) for w in a[i:i + 14] + distinct_words(f"o{i}x", 20)]
    text = shared[:200] + p + shared[200:]
    assert len(text) == 488
    rows = [(1, " ".join(a)), (2, " ".join(distinct_words("b", 50) + p)), (3, " ".join(text))]
    got = [(r.doc_id, r.start, r.end, r.src_doc_id, r.src_start, r.src_end) for r in chains.passages(frame(spark, rows)).collect()]
    assert got == [(3, 200, 280, 2, 50, 130)]


def test_passages_at_several_places_and_within_a_document(spark):
    p, q = distinct_words("p", 60), distinct_words("q", 70)
    rows = [(1, p), (2, p + distinct_words("x", 80) + p + distinct_words("y", 7) + p),  # two documents
            (3, distinct_words("z", 30) + q + distinct_words("u", 90) + q),  # one document
            (4, distinct_words("v", 60) * 4), (5, ["again"] * 3000), (6, ["begin"] + ["again"] * 7000),
            (7, ["thrice", "a", "day"] * 400)]
    out = chains.passages(frame(spark, [(i, " ".join(w)) for i, w in rows])).collect()
    texts = dict(rows)
    assert all(r.identity == 1 and texts[r.doc_id][r.start:r.end] == texts[r.src_doc_id][r.src_start:r.src_end]
               and (r.src_doc_id, r.src_start) < (r.doc_id, r.start) for r in out)
    got = {}
    for r in sorted(out):
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.src_doc_id))
    assert got[2] == [(0, 60, 1), (140, 200, 1), (207, 267, 1)] and got[3] == [(190, 260, 3)] and set(got) == {2, 3, 4, 6}
    for i, lo, hi in ((4, 60, 240), (6, 1, 7001)):  # repeats on end: covered from the second on
        assert set().union(*(range(s, e) for s, e, _ in got[i])) == set(range(lo, hi)) and len(got[i]) <= 4


# ---- personal data -------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if ((kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "phone" and not 9 <= len(d) <= 15)
                    or (kind == "card" and not (13 <= len(d) <= 19 and luhn(d)))):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_equals_plain_patterns(spark):
    rng = random.Random(3)
    parts = ["a", "@", "b.c", ".", "_", "%", "1", "22", "+", " ", "-", "(", ")", "é", "🙂", "255", "256", "4111111111111111", "\n", "0"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 40)))) for i in range(1500)]
    rows += [(9000, None), (9001, ""), (9002, "1" * 3000 + " " + "a.b@" * 1000 + "1.1." * 1000), (9003, "a" * 2000 + " 1 2-" * 4000),
             (9004, "card: 4111 1111 1111 1111, tel +1 (607) 555-1595. a@b.c_d@e.f 0001.002.3.255")]
    got = pii.personal_data(frame(spark, rows + rows[-1:])).collect()
    assert len(got) == len(rows) + 1
    texts = dict(rows)
    for r in got:
        base = plain_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in base) for k in PLAIN]
        assert set(base) <= set(filter(None, r.spans.split(",")))


def test_pii_bootstrap_adds_what_trusted_words_lead_to(spark):
    rows = [(i, f"xx contact: u{i}@x.com yy") for i in range(6)] + [(6, "zz Contact: jane@localhost qq call: 555-1234"),
                                                                    (7, "see version: 1234567"), (8, "contact: nobody")]
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, rows)).collect()}
    assert got[6].spans == "email:12:26" and got[6].n_email == 0
    assert got[7].spans == got[8].spans == "" and got[0].spans == "email:12:20"
    assert pii.personal_data(frame(spark, [])).count() == 0
