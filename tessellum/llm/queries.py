"""Queries ``opN_<name>`` of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, hilbert, html_text, langid, line_dedup, near_dup, rollup, toxicity, wavelet
from ._common import crc_mod, shared_dir, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True, warm=True)


@query
def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = wavelet.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return wavelet.read_shards(spark, path)


def _held_out(docs: DataFrame, n: int, rest: int) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", n) == rest, F.lit(False)))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _held_out(table(spark, sf_dir, "documents"), 4, 2)
    model = langid.fit(langid.sample(docs.where("not held_out"), per_lang=400))
    return langid.predict(docs, model, keep=["held_out"])


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _held_out(table(spark, sf_dir, "documents"), 5, 0)
    model = toxicity.learn(docs.where("not held_out"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=["held_out"])


@query
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


#: Tokenizers whose tokens are rolled up, by the version that the totals carry.
ROLLED_UP = {"word_bpe_49k-1": "word_bpe_49k.json"}


@query
def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive with estimated counts and no language, are recounted by the tokenizer, and those whose text a smaller ``doc_id`` has too are deleted; one batch is sent twice."""
    docs, root = table(spark, sf_dir, "documents"), shared_dir(spark, "token-rollup")
    guess = F.ceil(F.coalesce(F.char_length("text"), F.lit(0)) / 5).cast("bigint")
    arrived = docs.select("source", F.lit(None).cast("string").alias("lang"), F.explode(F.array(*map(F.lit, ROLLED_UP))).alias("tokenizer_version"), guess.alias("n_tokens"))
    rollup.commit(spark, root, "0-load", rollup.inserted(arrived))
    counts = stored(rollup.count(docs, {v: public_tokenizers.path(f) for v, f in ROLLED_UP.items()}), "token-counts")
    was = docs.select("source", F.explode(F.array(*map(F.lit, ROLLED_UP))).alias("tokenizer_version"), guess.alias("n_tokens"))
    rollup.commit(spark, root, "1-recount", rollup.deleted(was.withColumn("lang", F.lit(None).cast("string"))).unionByName(rollup.inserted(counts)))
    rollup.commit(spark, root, "0-load", rollup.inserted(arrived))
    # The smallest id of each text is told by partial sums; nothing but ids and digests is shuffled.
    digests = docs.where("doc_id is not null").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    again = counts.where("doc_id is not null").join(first, "doc_id", "left_anti")
    rollup.commit(spark, root, "2-purge", rollup.deleted(again))
    return rollup.totals(spark, root)


@query
def op3_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(table(spark, sf_dir, "embeddings"))


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query
def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
