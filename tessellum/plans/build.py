"""Index builds: only what changed is chunked, annotated, linked and embedded; the result equals a full build."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import IndexConfig
from ..functions.normalise import parsed
from ..functions.tokens import index_text, tokens
from ..operators import bm25, chunker, dependency, incremental
from ..providers import Embedder, TextModel, annotate, ask, embed
from ..sources import publish
from ..storage import delete, stored


def manifest_of(config: IndexConfig, annotator: TextModel, grapher: TextModel, embedder: Embedder) -> dict:
    return {
        "chunk_size": config.chunk_size, "chunk_overlap": config.chunk_overlap, "annotation_prompt_version": f"{config.annotation_version}/{annotator.version}",
        "dependency_prompt_version": f"{config.dependency_version}/{grapher.version}", "embedding_model": embedder.model, "dependency_vector_enabled": config.dependency_vectors,
    }


def build(spark: SparkSession, docs: DataFrame, root: str, config: IndexConfig, annotator: TextModel, grapher: TextModel, embedder: Embedder) -> str:
    """Brings the index in ``root`` up to ``docs(doc_key, doc_id, content_hash, text, ...)`` and publishes it; returns the version's folder.

    Steps are written below ``root/work`` while the build runs. Answers of the annotator
    outlive it in ``root/annotations``, by hash of the text and version of the model, so
    that a build that failed or a text that returns asks for nothing twice.
    """
    work = f"{root}/work/{uuid.uuid4().hex}"
    try:
        return _build(spark, docs, root, work, config, annotator, grapher, embedder)
    finally:
        delete(spark, work)


def aggregation_prompts(chunks: DataFrame, summary_chars: int = 800) -> DataFrame:
    """``doc_key, prompt``: JSON of a document's chunks in order, with what a model needs to relate them."""
    node = F.struct("chunk_index", "node_id", "heading_path", "summary", "dependency_topics", F.substring("text", 1, summary_chars).alias("text"))
    lists = chunks.groupBy("doc_key").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    bare = F.transform("nodes", lambda x: F.struct(x.node_id.alias("node_id"), x.heading_path.alias("heading_path"), x.summary.alias("summary"), x.dependency_topics.alias("dependency_topics"), x.text.alias("text")))
    return lists.select("doc_key", F.to_json(F.struct(F.col("doc_key").alias("document"), bare.alias("nodes"))).alias("prompt"))


def _build(spark: SparkSession, docs: DataFrame, root: str, work: str, config: IndexConfig, annotator: TextModel, grapher: TextModel, embedder: Embedder) -> str:
    facts, before = manifest_of(config, annotator, grapher, embedder), publish.read_manifest(spark, root)
    old = {n: spark.read.parquet(f"{publish.current(spark, root)}/{n}") for n in ("chunks", "cards", "vectors", "doc_state")} if before else {n: spark.createDataFrame([], s) for n, s in (("chunks", schemas.CHUNKS), ("cards", schemas.CARDS), ("vectors", schemas.VECTORS), ("doc_state", schemas.DOC_STATE))}

    def keep(name: str, df: DataFrame) -> DataFrame:
        return stored(df, name, f"{work}/{name}")

    decision = keep("decision", incremental.decide(incremental.diff(old["doc_state"], docs), incremental.Signals.of(before, facts)))
    live = decision.where("change <> 'deleted'").select("doc_key")
    again = decision.where("reannotate").select("doc_key")
    cut = chunker.chunk(docs.join(again, "doc_key", "left_semi"), config.chunk_size, config.chunk_overlap)
    fs, known = publish._fs(spark, f"{root}/annotations")
    cache = spark.read.schema(schemas.ANNOTATION_CACHE).parquet(f"{root}/annotations") if fs.exists(known) else None
    noted, answers = annotate(cut, annotator, cache, keep)
    answers.where("raw is not null").select("text_hash", "version", "raw").write.mode("append").parquet(f"{root}/annotations")
    fresh = keep("fresh", noted.select(*[f.name for f in spark.createDataFrame([], schemas.CHUNKS).schema.fields]))
    chunks = keep("chunks", old["chunks"].join(live, "doc_key", "left_semi").join(again, "doc_key", "left_anti").unionByName(fresh))

    linked = decision.where("redependency").select("doc_key")
    some = aggregation_prompts(chunks.join(linked, "doc_key", "left_semi"))
    raw = keep("graphs", ask(some, grapher, "doc_key", "prompt"))
    outputs = docs.join(linked, "doc_key", "left_semi").select("doc_key", F.col("content_hash").alias("doc_content_hash")).join(raw, "doc_key", "left").select("doc_key", "doc_content_hash", parsed(F.coalesce("raw", F.lit('{"node_dependencies":{}}'))).alias("raw"))
    new_cards = dependency.cards(outputs, chunks.join(linked, "doc_key", "left_semi").select("doc_key", "node_id"), grapher.version, config.dependency_version)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(dict(old["cards"].dtypes)["node_dependencies"].replace("map<string,", "array<", 1)))
    new_cards = new_cards.withColumn("node_dependencies", F.when(F.col("status") != "failed", F.coalesce("node_dependencies", empty)))
    cards = keep("cards", old["cards"].join(live, "doc_key", "left_semi").join(linked, "doc_key", "left_anti").unionByName(new_cards))
    edges = keep("edges", dependency.edges_of(cards))

    embedded = chunks.join(decision.where("reembed").select("doc_key"), "doc_key", "left_semi")
    parts = embed(embedded.select("node_id", "text"), embedder, "content").unionByName(embed(embedded.select("node_id", F.col("summary").alias("text")), embedder, "summary"))
    if config.dependency_vectors:
        parts = parts.unionByName(embed(dependency.vector_texts(edges, chunks), embedder, "dependency"))
    stay = old["vectors"].join(chunks.select("node_id"), "node_id", "left_semi").join(embedded.select("node_id"), "node_id", "left_anti").select("route", "node_id", "embedding", "embedding_model")
    if config.dependency_vectors:
        stay = stay.where("route <> 'dependency'").unionByName(embed(dependency.vector_texts(edges, chunks).join(embedded.select("node_id"), "node_id", "left_anti"), embedder, "dependency"))
    vectors = keep("vectors", stay.unionByName(parts).dropDuplicates(["route", "node_id"]))

    state = keep("doc_state", incremental.next_state(chunks, docs.select("doc_key", "content_hash")))
    # Ids that ascend along sorted ranges are the order of the corpus without a count over all of it.
    ordered = chunks.orderBy("doc_key", "chunk_index").withColumn("corpus_pos", F.monotonically_increasing_id())
    words = ordered.select("node_id", tokens(index_text(F.col("text"), F.col("summary"), F.col("keywords"), F.col("tags"))).alias("tokens"), "corpus_pos")
    keywords = bm25.build(keep("words", words))
    tables = {"documents": docs, "chunks": chunks, "edges": edges, "cards": cards, "vectors": vectors, "doc_state": state} | {f"keywords/{n}": getattr(keywords, n) for n in ("postings", "doc_stats", "term_stats", "corpus_stats")}
    checks = incremental.violations(state, chunks, keywords.doc_stats, cards, vectors)
    return publish.publish(spark, root, tables, facts, checks)
