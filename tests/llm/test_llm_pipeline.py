"""The pipeline against a brute-force version, and its stages on odd rows."""
import hashlib
import itertools
import math
import os
import random
import sys

import duckdb
import pandas as pd
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from quarry.llm import bpe, langid, line_dedup, mixing  # noqa: E402
from test_llm_text import DOC, brute_lines, closure, shingles  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def documents():
    """Two languages of syllables, near and exact copies, shared lines, rows without letters or text."""
    rng = random.Random(11)
    syllables = {"en": ["the", "ing", "on", "wh", "er"], "fr": ["eau", "que", "oi", "le", "tion"]}

    def line(lang):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(6, 14)))

    shared = {lang: line(lang) for lang in syllables}
    rows = []
    for i in range(90):
        lang = "en" if i % 3 else "fr"
        text = "\n".join([shared[lang]] * (i % 4 == 0) + [line(lang) for _ in range(rng.randint(1, 4))])
        rows.append((i, text, lang, f"s{i % 4}" if i % 9 else None, len(text)))
    for i in range(90, 110):  # one word of each line changed, or nothing
        text = rows[i - 60][1]
        if i % 2:
            text = "\n".join(x + " eaueau" for x in text.split("\n"))
        rows.append((i, text, rows[i - 60][2], "s1", len(text)))
    return rows + [(200, None, "en", "s0", 0), (201, "", "en", "s0", 0), (202, "12 34 !", "fr", None, 7)]


def log_scores(text, pieces, prob):
    number = {p: i for i, p in enumerate(pieces.pieces)}
    total = [0.0] * prob.shape[1]
    for word in langid.LETTERS.findall((text or "").lower()):
        s = langid.MARK + word
        for j in range(prob.shape[1]):
            a = [1.0] + [0.0] * len(s)
            for e in range(1, len(s) + 1):
                for b in range(max(0, e - pieces.longest), e):
                    n = number.get(s[b:e])
                    a[e] += a[b] * (prob[n, j] if n is not None else langid.UNKNOWN if e - b == 1 else 0.0)
            total[j] += math.log(a[-1])
    return total


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = documents()
    df = spark.createDataFrame(rows, DOC)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select(
        "doc_id", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256").collect())

    import zlib
    pieces = langid.read_pieces(PIECES)
    langs, prob = langid.fit(df.where(df.doc_id.isin([r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2])), pieces)
    kept = []
    for r in rows:
        s = log_scores(r[1], pieces, prob)
        if langid.LETTERS.search(r[1] or "") and 1 / sum(math.exp(x - max(s)) for x in s) >= corpus_pipeline.LEAST_SCORE:
            kept.append(r)
    assert len(kept) >= 105 and not {200, 201, 202} & {r[0] for r in kept}

    lines = brute_lines([(r[0], r[1]) for r in kept])
    kept = [(r[0], lines[r[0]][0], *r[2:4]) for r in kept if lines[r[0]][0].strip()]
    sets = {r[0]: shingles(r[1], corpus_pipeline.SHINGLE_WORDS) for r in kept}
    num, den = corpus_pipeline.SIMILARITY
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    label = closure(sets, links)
    kept = [r for r in kept if label[r[0]] == r[0]]

    docs = pd.DataFrame(kept, columns=["doc_id", "text", "lang", "source"])  # noqa: F841 - read by name
    copies = dict(duckdb.sql(f"WITH {mixing.mix_sql('docs')} SELECT doc_id, copies FROM mixed").fetchall())
    table = bpe.read_table(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks={t: i for i, t in enumerate(table.tokens)})
    want = []
    for i, text, *_ in kept:
        ids = own.encode_ordinary(text)
        digest = hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        want += [(i, len(text), len(ids), digest, hashlib.sha256(text.encode()).hexdigest())] * copies[i]
    assert got == sorted(want) and len(got) > 50


ODD = [(1, None, None, None, None), (2, "", "en", "", 0), (3, "the thing on\nthe thing on", None, None, 9),
       (3, "the thing on\nthe thing on", None, None, 9), (4, "er ing " * 9000, "en", "s", 5), (None, "le que oi", "fr", "s", 1)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_and_empty_tables(spark, name, stage):
    df = spark.createDataFrame(ODD, DOC)
    for docs in (df, df.limit(0), df.selectExpr("*", "1 AS n", "'x' AS copies", "'y' AS h")):
        out = stage(spark, docs, "")
        rows = out.collect()
        if name != "byte_bpe":
            assert out.columns == docs.columns
        if docs.limit(1).count() == 0:
            assert not rows
        elif name == "language_id":  # nothing to learn from or letters: only rows 3, 4 and the one without id can stay
            assert {r.doc_id for r in rows} <= {3, 4, None}
        elif name == "line_dedup":
            want = [(1, None), (2, ""), (3, "the thing on"), (3, "the thing on"), (4, ODD[4][1]), (0, "le que oi")]
            assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((i, t or "") for i, t in want)
        elif name == "ngram_jaccard":
            assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 2, 3, 3, 4]
        elif name == "mix_sources":
            assert {r.doc_id for r in rows} <= {3, 4, None} and rows
        else:
            assert len(rows) == docs.count() and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_line_dedup_stage_sends_no_keys_by_the_driver(spark, monkeypatch):
    links, settle = [], line_dedup.settled
    monkeypatch.setattr(line_dedup, "settled", lambda close: links.append(close) or settle(close))
    rows = [(1, "a line of some length\nanother line", "en", "s", 34), (2, "a line of some lengths\nmore", "en", "s", 27)]
    out = corpus_pipeline.line_dedup_stage(spark, spark.createDataFrame(rows, DOC), None).collect()
    assert {r.doc_id: r.text for r in out} == {1: rows[0][1], 2: "more"}
    assert "Broadcast" not in links[0]._jdf.queryExecution().executedPlan().toString()
