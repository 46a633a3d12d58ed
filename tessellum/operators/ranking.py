"""Hits to candidates: union of routes, fusion, model scores, limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import fused, reciprocal_rank

ROUTES = ("content", "dependency", "summary", "bm25", "dependency_graph", "neighbor_expand")


def union_hits(routes: list[tuple[str, bool, DataFrame]]) -> DataFrame:
    """Hits of all routes as one bag. ``hit_seq`` is the order of arrival: by route, wording and rank, without a window over all hits."""
    parts = []
    for n, (route, rewritten, hits) in enumerate(routes):
        parts.append(hits.select("query_id", (F.lit(n).cast("bigint") * 1_000_000_000 + F.col("rank")).alias("hit_seq"), "node_id", F.lit(route).alias("route"), "rank", "raw_score", F.lit(rewritten).alias("is_rewritten")))
    return reduce(DataFrame.unionByName, parts)


def aggregate_hits(hits: DataFrame) -> DataFrame:
    """One candidate per query and node, its hits in order of arrival. ``first_seq`` orders candidates."""
    h = F.struct("hit_seq", "route", "rank", "raw_score", "is_rewritten")
    return hits.groupBy("query_id", "node_id").agg(F.sort_array(F.collect_list(h)).alias("hits"), F.min("hit_seq").alias("first_seq"))


def with_metadata(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Left join, since a candidate without metadata stays."""
    return candidates.join(chunks, "node_id", "left")


def fuse(hits: DataFrame, marks: DataFrame) -> DataFrame:
    """``query_id, node_id, fused_score, first_seq`` straight from hits; ``marks``: ``query_id, node_id, coherence, is_neighbor``.

    Sums are partial before the shuffle and need no list of hits.
    """
    sums = hits.groupBy("query_id", "node_id").agg(
        F.sum(reciprocal_rank(F.col("rank"))).alias("rr"),
        F.size(F.collect_set("route")).alias("routes"),
        F.sum(F.col("is_rewritten").cast("int")).alias("rewritten"),
        F.min("hit_seq").alias("first_seq"),
    )
    joined = sums.join(marks, ["query_id", "node_id"], "left")
    score = fused(F.col("rr"), F.col("routes"), F.col("rewritten"), F.col("coherence"), F.coalesce("is_neighbor", F.lit(False)))
    return joined.select("query_id", "node_id", score.alias("fused_score"), "first_seq")


def score_candidates(candidates: DataFrame) -> DataFrame:
    """``fused_score`` and ``final_score`` of candidates that carry ``hits, coherence, is_neighbor``."""
    rr = F.aggregate(F.transform("hits", lambda h: reciprocal_rank(h.rank)), F.lit(0.0), lambda a, x: a + x)
    routes = F.size(F.array_distinct(F.transform("hits", lambda h: h.route)))
    rewritten = F.size(F.filter("hits", lambda h: h.is_rewritten))
    score = fused(rr, routes, rewritten, F.col("coherence"), F.coalesce("is_neighbor", F.lit(False)))
    return candidates.withColumn("fused_score", score).withColumn("final_score", F.col("fused_score"))


def placed(candidates: DataFrame, by: str = "final_score", name: str = "pos") -> DataFrame:
    """``name``: place in a query's list, best first; sums differ in the last bits, so equal to 12 digits is a tie, which keeps arrival order."""
    w = Window.partitionBy("query_id").orderBy(F.round(by, 12).desc(), "first_seq", "node_id")
    return candidates.withColumn(name, F.row_number().over(w))


def model_rerank(candidates: DataFrame, scores: DataFrame, head: int) -> DataFrame:
    """Second stage: the scored of the first ``head`` by a blend, then all others in coarse order.

    ``candidates`` carry ``pos``; ``scores``: ``query_id, node_id, llm_score``. A query
    without scores keeps its order.
    """
    joined = candidates.join(scores, ["query_id", "node_id"], "left")
    scored = (F.col("pos") <= head) & F.col("llm_score").isNotNull()
    joined = joined.withColumn("llm_score", F.when(scored, F.col("llm_score"))).withColumn("final_score", F.when(scored, 0.2 * F.col("fused_score") + 0.8 * F.col("llm_score")).otherwise(F.col("final_score")))
    w = Window.partitionBy("query_id").orderBy(scored.desc(), F.when(scored, F.round("final_score", 12)).desc_nulls_last(), "pos")
    return joined.withColumn("pos", F.row_number().over(w))


def top(candidates: DataFrame, n: int) -> DataFrame:
    return candidates.where(F.col("pos") <= n)
