"""Queries over ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quarry.llm import bpe, chains, langid, line_dedup, mixing, ngram_join, pii, prefix_table, spelling
from quarry.llm.common import load
from quarry.llm.registry import query

#: Documents, their distinct word 4-grams, links at 85 % and the closure of the links.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""


@query("op2_ngram_jaccard", OP2_SQL)
def op2_ngram_jaccard(spark, sf_dir):
    return ngram_join.jaccard_groups(load(spark, sf_dir, "documents"))


@query("op7_byte_bpe")
def op7_byte_bpe(spark, sf_dir):
    return token_digests(load(spark, sf_dir, "documents"))


def token_digests(docs):
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes of every whole text."""
    table = bpe.read_table(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(docs, table)


OP6_SQL = ("WITH " + mixing.mix_sql("documents")
           + " SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed")


@query("op6_fair_queue_mix", OP6_SQL)
def op6_fair_queue_mix(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


# no DuckDB twin: sums over all segmentations; the tests compare with enumerated segmentations and held-out labels
@query("op4_piece_language")
def op4_piece_language(spark, sf_dir):
    return langid.identify(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


# no DuckDB twin: all pairs of lines by edit distance are too slow there on whole tables; the tests compare with them
@query("op5_deletion_lines")
def op5_deletion_lines(spark, sf_dir):
    out = line_dedup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("kept_sha256"))


# no DuckDB twin: it has no places of matches; the tests compare the base spans with Python's re
@query("op10_context_pii")
def op10_context_pii(spark, sf_dir):
    return pii.personal_data(load(spark, sf_dir, "documents"))


# no DuckDB twin: chains and alignments; the tests compare with planted passages and longest common runs
@query("op9_chained_passages")
def op9_chained_passages(spark, sf_dir):
    return chains.passages(load(spark, sf_dir, "documents"))


# no DuckDB twin: merges in rank order; the tests compare with the sentencepiece library
@query("op12_prefix_table")
def op12_prefix_table(spark, sf_dir):
    table = prefix_table.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return prefix_table.digests(load(spark, sf_dir, "documents"), table)


#: CRC-32 of the UTF-8 bytes of ``<doc_id>:<run>`` by its usual table, the words, pairs at one edit, and the chain of forms.
OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT [list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
          lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS t),
o AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS c FROM o GROUP BY 1, 2),
b AS (SELECT run, c, list_prepend(4294967295, flatten([CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
             ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END
             FOR x IN string_split(CAST(doc_id AS VARCHAR) || ':' || run, '')])) AS bytes FROM d),
h AS (SELECT run, c, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM b, t),
m AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2)
             ELSE run END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM m WHERE length(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2),
v AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
k AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS k FROM v),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM k a JOIN k b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM k a JOIN w b ON a.k = b.word
      UNION SELECT b.word, a.word, a.n FROM k a JOIN w b ON a.k = b.word),
q AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) AS r FROM p),
s AS (SELECT word, CAST(count(*) AS BIGINT) AS n_near, max(m) AS m, max(other) FILTER (r = 1) AS other FROM q GROUP BY 1),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form,
             CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN s USING (word)),
g AS (SELECT word, word AS at FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, g.at AS root, f.n, f.n_near, f.form_n FROM f JOIN g ON g.word = f.word
JOIN f e ON e.word = g.at AND e.form IS NULL
"""


@query("op11_spelling_forms", OP11_SQL)
def op11_spelling_forms(spark, sf_dir):
    """Runs of letters, one of 31 (by the hash of document and run) without one of its characters, by their forms."""
    docs = load(spark, sf_dir, "documents")
    runs = spelling.occurrences(docs, "doc_id", "text", 7)
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return spelling.forms(spelling.vocabulary(words, 7, 2), 7, 10)
