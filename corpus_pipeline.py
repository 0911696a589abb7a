"""Training-data pipeline over ``documents``: five stages, each written and read again.

Every stage function takes (spark, docs, sf_dir) and works on all rows that the
stage before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quarry.llm import bpe, langid, line_dedup, mixing, ngram_join
from quarry.llm.common import bound_batches, load, written

#: Documents whose language is uncertain by this posterior go, as do those without letters.
LEAST_SCORE = 0.5
#: Near duplicates: shared runs of five words, Jaccard similarity of 80 %.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)


def language_id(spark, docs, sf_dir):
    """Keep the documents that have a language: a learned one, predicted with LEAST_SCORE or more.

    Texts that are NULL or without letters have none. Rows without doc_id are judged too."""
    bound_batches(spark)
    out = langid.identify(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=tuple(docs.columns),
                          names=("__held", "__lang", "__score"))
    return out.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup_stage(spark, docs, sf_dir):
    """Drop repeated lines, and documents of which nothing but white space is left.

    NULL, empty and blank texts and rows without doc_id stay as they are."""
    out = line_dedup.dedup_lines(docs, names=("__n_lines", "__n_kept"))
    emptied = (F.col("__n_kept") < F.col("__n_lines")) & (F.trim(F.regexp_replace("text", r"\s", " ")) == "")
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def ngram_jaccard(spark, docs, sf_dir):
    """Keep the first document, by doc_id, of each group of near duplicates.

    Texts without words are in no group and stay, as do rows without doc_id; rows that repeat a kept doc_id stay."""
    bound_batches(spark)
    groups = ngram_join.jaccard_groups(docs, SHINGLE_WORDS, *SIMILARITY)
    first = groups.where("doc_id = component_id").select("doc_id").distinct().withColumn("__first", F.lit(True))
    return docs.join(first, "doc_id", "left").where("__first or doc_id is null").select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    """Use each document as often as the mix takes it: not at all, once, or in several rows.

    Texts without words are never taken; rows that repeat a doc_id are taken alike."""
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    used = (mixing.mix(sized).where("copies > 0").groupBy(F.col("doc_id").alias("__id"))
            .agg(F.max("copies").cast("int").alias("__copies")))
    out = docs.join(used, F.col("doc_id").eqNullSafe(F.col("__id"))).withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.select(*docs.columns)


def byte_bpe(spark, docs, sf_dir):
    """Encode every whole text, decode the ids; counts and digests, one row per input row. NULL counts as ''."""
    bound_batches(spark)
    table = bpe.read_table(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(docs, table, keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("ngram_jaccard", ngram_jaccard),
          ("mix_sources", mix_sources), ("byte_bpe", byte_bpe)]

#: Language scores, edit distances and merges have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``; each is written as Parquet and read as the next one's input."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
