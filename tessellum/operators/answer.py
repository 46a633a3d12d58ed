"""Answers without a model, references, and text renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_ANSWER = "No indexed passage supports an answer."
HEADER = "Most relevant passages:"


def excerpt(summary: Column, text: Column, most: int = 160) -> Column:
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.coalesce(F.when(F.trim(F.coalesce(summary, F.lit(""))) != "", F.trim(summary)), F.when(bare != "", F.substring(bare, 1, most)), F.lit("(no text)"))


def extractive(queries: DataFrame, context: DataFrame) -> DataFrame:
    """``query_id, answer, refs`` of every query. ``context``: ``query_id, context_pos, node_id, doc_id, heading_path, summary, text``."""
    line = F.concat(F.lit("- "), excerpt(F.col("summary"), F.col("text")), F.lit(" ["), F.col("node_id"), F.lit("]"))
    lists = context.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("context_pos", line.alias("line"), F.struct("node_id", "doc_id", "heading_path").alias("ref")))).alias("c"))
    body = F.array_join(F.concat(F.array(F.lit(HEADER)), F.transform("c", lambda x: x.line)), "\n")
    kind = "array<struct<node_id:string,doc_id:string,heading_path:string>>"
    refs = F.coalesce(F.transform("c", lambda x: x.ref).cast(kind), F.array().cast(kind))
    return queries.join(lists, "query_id", "left").select("query_id", F.when(F.col("c").isNull(), NO_ANSWER).otherwise(body).alias("answer"), refs.alias("refs"))


def prompts(queries: DataFrame, context: DataFrame, context_chars: int = 1200) -> DataFrame:
    """JSON prompts for an answering model."""
    item = F.struct("context_pos", "node_id", "heading_path", F.substring("text", 1, context_chars).alias("text"))
    lists = context.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("passages"))
    return queries.join(lists, "query_id").select("query_id", F.to_json(F.struct(F.col("query_text").alias("question"), "passages")).alias("prompt"))


def rendered(candidates: DataFrame) -> DataFrame:
    """A line of text per candidate: scores to four digits, each route once, in order of arrival."""
    routes = F.array_join(F.array_distinct(F.transform("hits", lambda h: h.route)), ", ")
    return candidates.select("query_id", "pos", F.format_string("%d. %s score=%.4f fused=%.4f routes=%s", "pos", "node_id", "final_score", "fused_score", routes).alias("line"))
