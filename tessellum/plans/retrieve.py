"""Many questions at once: recall, fusion, expansion, reranking, context and answers, keyed by ``query_id``.

Hits, seeds, accepted dependencies, candidates and the context are read several times
each, so they are written once and read back; a plan that held them all would repeat
recall at every use and double with every step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import QueryConfig
from ..functions.normalise import rerank_scores, rewrites
from ..functions.scores import route_decision
from ..functions.tokens import tokens
from ..operators import answer, bm25, dependency, neighbours, ranking, vector
from ..providers import Embedder, TextModel, ask, embed
from ..sources import publish
from ..storage import discard, stored


@dataclass
class Index:
    chunks: DataFrame
    edges: DataFrame
    vectors: DataFrame
    keywords: bm25.KeywordIndex

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index:
        read = lambda n: spark.read.parquet(f"{folder}/{n}")
        return cls(read("chunks"), read("edges"), read("vectors"), bm25.KeywordIndex.load(spark, f"{folder}/keywords"))


@dataclass
class Response:
    """Parts of the answers, each keyed by ``query_id``."""

    rewrites: DataFrame
    candidates: DataFrame
    context: DataFrame
    answers: DataFrame


@dataclass
class QueryService:
    index: Index
    embedder: Embedder
    config: QueryConfig = QueryConfig()
    rewriter: TextModel | None = None
    reranker: TextModel | None = None
    router: TextModel | None = None
    answerer: TextModel | None = None
    dependency_vectors: bool = False

    @classmethod
    def open(cls, spark: SparkSession, root: str, embedder: Embedder, **more) -> QueryService:
        return cls(Index.load(spark, publish.current(spark, root, embedder.model)), embedder, **more)

    def _routes(self, questions: DataFrame, sizes: tuple[int, int, int], rewritten: bool) -> list[tuple[str, bool, DataFrame]]:
        """Hits of the routes for ``questions(query_id, ask_id, query_text)``; a limit of 0 means the route's default."""
        c = self.config
        content, summary, keyword = (a or b for a, b in zip(sizes, (c.content_top_k, c.summary_top_k, c.bm25_top_k), strict=True))
        asked = embed(questions.select(F.col("ask_id").cast("string").alias("node_id"), F.col("query_text").alias("text")), self.embedder, "query").select(F.col("node_id").cast("bigint").alias("query_id"), "embedding")
        of = lambda r: self.index.vectors.where(F.col("route") == r).select("node_id", "embedding")
        found = [("content", vector.search(of("content"), asked, content))]
        if self.dependency_vectors:
            found.append(("dependency", vector.search(of("dependency"), asked, min(content, 4))))
        found.append(("summary", vector.search(of("summary"), asked, summary)))
        found.append(("bm25", bm25.search(self.index.keywords, questions.select(F.col("ask_id").alias("query_id"), tokens(F.col("query_text")).alias("tokens")), keyword)))
        names = questions.select("query_id", F.col("ask_id").alias("a"))
        return [(r, rewritten, h.withColumnRenamed("query_id", "a").join(names, "a").drop("a")) for r, h in found]

    def answer(self, queries: DataFrame) -> Response:
        """``queries``: ``query_id bigint, query_text string``."""
        c, spark = self.config, queries.sparkSession
        routes = self._routes(queries.withColumn("ask_id", F.col("query_id")), (0, 0, 0), False)
        if self.rewriter is not None:
            raw = ask(queries, self.rewriter, "query_id", "query_text").select(F.col("query_id").cast("bigint").alias("query_id"), "raw")
            other = stored(raw.select("query_id", F.posexplode(rewrites(F.col("raw"), c.rewrite_limit)).alias("n", "query_text")), "rewrites")
            for n in range(c.rewrite_limit):
                routes += self._routes(other.where(F.col("n") == n).withColumn("ask_id", F.col("query_id")), (c.rewrite_content_top_k, c.rewrite_summary_top_k, c.rewrite_bm25_top_k), True)
        else:
            other = spark.createDataFrame([], "query_id bigint, n int, query_text string")
        hits = stored(ranking.union_hits(routes), "hits")
        chunks = self.index.chunks
        found = ranking.with_metadata(ranking.aggregate_hits(hits), chunks).withColumns({"is_neighbor": F.lit(False), "center_node_id": F.lit(None).cast("string")})
        coarse = ranking.placed(ranking.score_candidates(found))
        wanted = stored(self._wanted(queries), "wanted")
        seeds = stored(dependency.seeds(coarse.join(wanted, "query_id", "left_semi"), c.capability_weight, c.seed_score_ratio, c.max_seeds), "seeds")
        accepted = stored(dependency.expand(seeds, self.index.edges, chunks, c.min_confidence, c.edges_per_seed, c.dependency_total)[0], "accepted")
        extra = accepted.groupBy("query_id", F.col("target_id").alias("node_id"), "seed_rank").agg(F.max("confidence").alias("raw_score")).select(
            "query_id", (F.lit(900_000_000_000) + F.col("seed_rank")).alias("hit_seq"), "node_id", F.lit("dependency_graph").alias("route"), F.col("seed_rank").alias("rank"), "raw_score", F.lit(False).alias("is_rewritten"))
        wider = stored(hits.unionByName(extra), "wider-hits")
        base = ranking.placed(ranking.score_candidates(ranking.with_metadata(ranking.aggregate_hits(wider), chunks).withColumn("is_neighbor", F.lit(False))))
        near = stored(neighbours.expand(base, chunks, c.neighbour_radius, c.neighbour_centres), "neighbours")
        beside = near.select("query_id", (F.lit(990_000_000_000) + F.col("rank")).alias("hit_seq"), "node_id", F.lit("neighbor_expand").alias("route"), "rank", F.lit(0.0).alias("raw_score"), F.lit(False).alias("is_rewritten"))
        marks = near.select("query_id", "node_id", "center_node_id")
        every = ranking.with_metadata(ranking.aggregate_hits(wider.unionByName(beside)), chunks).join(marks, ["query_id", "node_id"], "left").withColumn("is_neighbor", F.col("center_node_id").isNotNull())
        final = stored(ranking.placed(ranking.score_candidates(every)), "candidates")
        spent = [hits, wider, near]
        if self.reranker is not None:
            spent.append(final)
            final = stored(ranking.model_rerank(final, self._scores(queries, final), c.llm_top_n), "reranked")
        picked = dependency.assemble(final, seeds, accepted, c.final_top_n, c.max_forced)
        plain = ranking.top(final.join(wanted, "query_id", "left_anti"), c.final_top_n).select("query_id", "node_id", F.lit(2).alias("part"), F.col("pos").alias("context_pos"))
        context = stored(picked.join(wanted, "query_id", "left_semi").unionByName(plain).join(chunks, "node_id"), "context")
        discard(*spent, seeds, accepted, wanted)
        return Response(other, final, context, self._answers(queries, context))

    def _wanted(self, queries: DataFrame) -> DataFrame:
        """Queries that ask for dependencies; a router model is asked where the rules are silent, and its failure means no."""
        ruled = queries.select("query_id", "query_text", route_decision(F.col("query_text")).alias("d"))
        sure = ruled.where("d.use_dependencies").select("query_id")
        if self.router is None:
            return sure
        raw = ask(ruled.where("d.confidence < 1"), self.router, "query_id", "query_text")
        yes = raw.where(F.try_variant_get(F.try_parse_json("raw"), "$.use_dependencies", "boolean")).select(F.col("query_id").cast("bigint").alias("query_id"))
        return sure.unionByName(yes)

    def _scores(self, queries: DataFrame, final: DataFrame) -> DataFrame:
        head = ranking.top(final, self.config.llm_top_n)
        item = F.struct("pos", "node_id", F.substring("text", 1, 400).alias("text"))
        lists = head.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("passages")).join(queries, "query_id")
        raw = ask(lists.select("query_id", F.to_json(F.struct(F.col("query_text").alias("question"), "passages")).alias("p")), self.reranker, "query_id", "p")
        return raw.select(F.col("query_id").cast("bigint").alias("query_id"), F.explode(rerank_scores(F.col("raw"))).alias("node_id", "llm_score"))

    def _answers(self, queries: DataFrame, context: DataFrame) -> DataFrame:
        plain = answer.extractive(queries, context)
        if self.answerer is None:
            return plain
        said = ask(answer.prompts(queries, context, self.config.context_chars), self.answerer, "query_id", "prompt").select(F.col("query_id").cast("bigint").alias("query_id"), F.col("raw").alias("said"))
        better = F.coalesce(F.when(F.trim("said") != "", F.col("said")), F.col("answer"))
        return plain.join(said, "query_id", "left").select("query_id", better.alias("answer"), "refs")
