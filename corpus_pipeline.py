"""Pipeline over ``documents``: five stages, each written before the next one reads it.

All stages: an empty table gives no rows, columns beyond those of ``documents`` are left
out, very long texts are read whole, and rows that repeat one another are treated as
each stage says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm import bpe, decontam, langid, line_dedup, near_dup
from tessellum.llm._common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: no letters, or no language with more than half of the posterior.

    Null and empty texts go. Ties go to the language that sorts first, and a tie of two
    has no more than half, so it goes too. Repeated rows fare alike. Null ids, sources and
    languages stay as they are. Where no row has a language, nothing can be told and all go.
    """
    model = langid.fit(langid.sample(docs, per_lang=400))
    found = langid.predict(docs, model, keep=["text", "lang", "source", "n_chars"])
    return found.where("lang_pred <> 'und' and score > 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that an earlier line equals or resembles; documents of which nothing is left go.

    Order is by ``doc_id``, text and place. Of rows that repeat an id and its text one stays.
    Rows without an id and texts without words are left alone.
    """
    cut = line_dedup.dedup(docs.select(*COLUMNS))
    return cut.where("n_removed = 0 or text <> ''").withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group.

    Rows that share an id are one document and stay or go together; rows without an id
    and texts without words are linked with nothing and stay.
    """
    gone = near_dup.near_duplicates(docs, width=5).where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, to a tenth of its characters edited.

    Null texts hold none. Repeated rows fare alike; an empty benchmark drops nothing.
    """
    return decontam.without_matches(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes; null texts count as empty, repeated rows stay."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["lang", "source"], digests=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("byte_bpe", encode_bytes),
]

#: The stages have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
