"""Dependency graph: validation, seeds, budgeted expansion, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalise import edge
from ..functions.scores import capability
from ..functions.tokens import tokens


def raw_edges(outputs: DataFrame) -> DataFrame:
    """``doc_key, source_id, edge_pos, edge`` of ``outputs(doc_key, raw variant)``: one row for each listed edge; a source whose value is no list gives one row with ``edge_pos`` -1."""
    at = F.try_variant_get("raw", "$.node_dependencies", "map<string,variant>")
    sources = outputs.select("doc_key", F.explode(at).alias("source_id", "listed")).select("doc_key", "source_id", F.try_variant_get("listed", "$", "array<variant>").alias("edges"))
    some = sources.select("doc_key", "source_id", F.posexplode_outer("edges").alias("edge_pos", "v"), F.col("edges").isNull().alias("bad"))
    return some.select("doc_key", "source_id", F.when(F.col("bad"), -1).otherwise(F.col("edge_pos")).alias("edge_pos"), F.when(F.col("v").isNotNull(), edge(F.col("v"))).alias("edge"))


def valid_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are different chunks of the document (``nodes``: ``doc_key, node_id``), the first of each pair."""
    known = raw.where("edge is not null").join(nodes.select("doc_key", F.col("node_id").alias("source_id")), ["doc_key", "source_id"], "left_semi")
    flat = known.select("doc_key", "source_id", "edge_pos", F.col("edge.node_id").alias("target_id"), "edge.relation_type", "edge.required", "edge.confidence", "edge.reason", "edge.topic")
    flat = flat.where("source_id <> target_id").join(nodes.select("doc_key", F.col("node_id").alias("target_id")), ["doc_key", "target_id"], "left_semi")
    first = Window.partitionBy("doc_key", "source_id", "target_id").orderBy("edge_pos")
    return flat.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").select("doc_key", "source_id", "edge_pos", "target_id", "relation_type", "required", "confidence", "reason", "topic")


def cards(outputs: DataFrame, nodes: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """A card per document (``outputs``: ``doc_key, doc_content_hash, raw``): status, counts, discarded edges, edges by source.

    An output without an object of dependencies fails; one that lacks a chunk as a key is partial.
    """
    parts = outputs.select("doc_key", "doc_content_hash", "raw", F.try_variant_get("raw", "$.node_dependencies", "map<string,variant>").alias("deps"))
    raw, expected = raw_edges(outputs), nodes.groupBy("doc_key").agg(F.count("*").cast("int").alias("expected_node_count"))
    kept = valid_edges(raw, nodes)
    known = raw.join(nodes.select("doc_key", F.col("node_id").alias("source_id")), ["doc_key", "source_id"], "left_semi")
    unknown = raw.join(nodes.select("doc_key", F.col("node_id").alias("source_id")), ["doc_key", "source_id"], "left_anti").groupBy("doc_key").agg(F.countDistinct("source_id").alias("unknown"))
    listed = known.where("edge_pos is not null").groupBy("doc_key").agg(F.count("*").alias("listed"))
    keys = parts.select("doc_key", F.explode(F.map_keys("deps")).alias("node_id")).join(nodes.select("doc_key", "node_id"), ["doc_key", "node_id"], "left_semi").groupBy("doc_key").agg(F.countDistinct("node_id").cast("int").alias("processed"))
    item = F.struct(F.col("target_id").alias("node_id"), "relation_type", "required", "confidence", "reason", "topic")
    lists = kept.groupBy("doc_key", "source_id").agg(F.sort_array(F.collect_list(F.struct("edge_pos", item.alias("e")))).alias("es"))
    by_source = nodes.select("doc_key", F.col("node_id").alias("source_id")).join(lists, ["doc_key", "source_id"], "left")
    entry = F.struct("source_id", F.coalesce(F.transform("es", lambda x: x.e), F.array().cast("array<struct<node_id:string,relation_type:string,required:boolean,confidence:double,reason:string,topic:string>>")))
    maps = by_source.groupBy("doc_key").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("node_dependencies"))
    kept_n = kept.groupBy("doc_key").agg(F.count("*").alias("kept"))
    j = parts.join(expected, "doc_key", "left").join(keys, "doc_key", "left").join(maps, "doc_key", "left").join(kept_n, "doc_key", "left").join(listed, "doc_key", "left").join(unknown, "doc_key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    failed = F.col("deps").isNull()
    status = F.when(failed, "failed").when(zero("processed") == zero("expected_node_count"), "success").otherwise("partial")
    return j.select(
        "doc_key", status.alias("status"), "doc_content_hash", zero("expected_node_count").cast("int").alias("expected_node_count"), F.when(failed, 0).otherwise(zero("processed")).cast("int").alias("processed_node_count"),
        F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"),
        F.when(failed, "no object of dependencies").when(status == "partial", "not every chunk is covered").alias("error"),
        F.when(failed, 0).otherwise(zero("listed") - zero("kept") + zero("unknown")).cast("int").alias("discarded_edge_count"),
        F.when(~failed, F.col("node_dependencies")).alias("node_dependencies"),
    )


def publishable(cards_: DataFrame) -> DataFrame:
    n = F.size("node_dependencies")
    return cards_.where((F.col("status") == "success") & (F.col("expected_node_count") == F.col("processed_node_count")) & (n == F.col("expected_node_count")))


def edges_of(cards_: DataFrame) -> DataFrame:
    """Publishable cards as an edge table."""
    by_source = publishable(cards_).select("doc_key", F.explode("node_dependencies").alias("source_id", "edges"))
    return by_source.select("doc_key", "source_id", F.posexplode("edges").alias("edge_pos", "e")).select("doc_key", "source_id", "edge_pos", F.col("e.node_id").alias("target_id"), "e.relation_type", "e.required", "e.confidence", "e.reason", "e.topic")


def required_edges(edges: DataFrame, min_confidence: float, limit: int) -> DataFrame:
    """Required edges of enough confidence, the surest of each source; ``edge_rank`` from 1."""
    w = Window.partitionBy("source_id").orderBy(F.col("confidence").desc(), "edge_pos")
    return edges.where(F.col("required") & (F.col("confidence") >= min_confidence)).withColumn("edge_rank", F.row_number().over(w)).where(F.col("edge_rank") <= max(limit, 0))


def seeds(candidates: DataFrame, weight: float, ratio: float, most: int) -> DataFrame:
    """``query_id, node_id, seed_score, seed_rank``. ``candidates`` carry ``pos, final_score, is_neighbor, hits`` and chunk metadata.

    Scores fall along the list, so stopping at the first below the best's share is a filter.
    """
    expanded = F.exists("hits", lambda h: h.route.isin("neighbor_expand", "dependency_graph"))
    fit = candidates.where(~F.coalesce("is_neighbor", F.lit(False)) & ~expanded)
    able = capability(F.size(F.coalesce("dependency_topics", F.array().cast("array<string>"))), F.col("heading_path"), F.col("type"))
    scored = fit.select("query_id", "node_id", "pos", (F.col("final_score") * (1 - weight) + able * weight).alias("seed_score"))
    return pick_seeds(scored, ratio, most)


def pick_seeds(scored: DataFrame, ratio: float, most: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("seed_score", 12).desc(), "pos")
    ranked = scored.withColumn("seed_rank", F.row_number().over(w)).withColumn("best", F.first("seed_score").over(w))
    return ranked.where(((F.col("seed_rank") == 1) | (F.round("seed_score", 12) >= F.round(F.col("best") * max(0.0, ratio), 12))) & (F.col("seed_rank") <= most)).select("query_id", "node_id", "seed_score", "seed_rank")


def fallback_targets(missing: DataFrame, chunks: DataFrame) -> DataFrame:
    """Another chunk of the source's document for edges whose target is gone: most tokens shared with the reason, a tenth for the topic, then the smaller id.

    ``missing``: ``source_id, edge_pos, reason, topic``. Tokens are joined, not documents squared.
    """
    text = F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("heading_path", F.lit("")), F.array_join("keywords", " "), "text")
    side = missing.join(chunks.select(F.col("node_id").alias("source_id"), "doc_id"), "source_id").where("doc_id <> ''")
    asked = side.select("source_id", "edge_pos", "topic", "doc_id", F.explode(tokens(F.col("reason"))).alias("token"))
    there = chunks.join(side.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "node_id", "dependency_topics", F.explode(tokens(text)).alias("token"))
    shared = asked.join(there, ["doc_id", "token"]).where("node_id <> source_id").groupBy("source_id", "edge_pos", "node_id").agg(F.count("*").alias("n"), F.first("topic").alias("topic"), F.first("dependency_topics").alias("topics"))
    bonus = F.when((F.coalesce("topic", F.lit("")) != "") & F.coalesce(F.array_contains("topics", F.col("topic")), F.lit(False)), 0.1).otherwise(0.0)
    w = Window.partitionBy("source_id", "edge_pos").orderBy((F.col("n") + bonus).desc(), "node_id")
    return shared.withColumn("r", F.row_number().over(w)).where("r = 1").select("source_id", "edge_pos", F.col("node_id").alias("target_id"))


def admit(pending: DataFrame, seeds_: DataFrame, total: int) -> DataFrame:
    """Which pending edges fit the budget: ``pending`` plus ``ord`` and ``accepted``.

    ``pending``: ``query_id, target_id, confidence, seed_rank, edge_rank``. Surest first;
    a target counts once, and seeds among the targets are free.
    """
    by = Window.partitionBy("query_id").orderBy(F.col("confidence").desc(), "seed_rank", "edge_rank")
    own = seeds_.select("query_id", F.col("node_id").alias("target_id"), F.lit(True).alias("is_seed"))
    n = seeds_.groupBy("query_id").agg(F.count("*").alias("n_seeds"))
    ranked = pending.withColumn("ord", F.row_number().over(by)).join(own, ["query_id", "target_id"], "left").join(n, "query_id")
    ranked = ranked.withColumn("first_ord", F.min("ord").over(Window.partitionBy("query_id", "target_id")))
    slot = F.dense_rank().over(Window.partitionBy("query_id", F.coalesce("is_seed", F.lit(False))).orderBy("first_ord"))
    ranked = ranked.withColumn("slot", slot)
    return ranked.withColumn("accepted", F.coalesce("is_seed", F.lit(False)) | (F.col("slot") <= total - F.col("n_seeds"))).drop("is_seed", "n_seeds", "first_ord", "slot")


def expand(seeds_: DataFrame, edges: DataFrame, chunks: DataFrame, min_confidence: float, per_seed: int, total: int) -> tuple[DataFrame, DataFrame]:
    """Accepted dependency rows, and per query the numbers of ``missing`` and ``truncated`` ones."""
    chosen = required_edges(edges, min_confidence, per_seed)
    rows = seeds_.select("query_id", "seed_rank", F.col("node_id").alias("source_id")).join(chosen.drop("doc_key"), "source_id")
    there = chunks.select(F.col("node_id").alias("target_id"), F.lit(True).alias("there"))
    marked = rows.join(there, "target_id", "left")
    lost = marked.where("there is null")
    other = fallback_targets(lost.select("source_id", "edge_pos", "reason", "topic").distinct(), chunks)
    moved = lost.drop("target_id", "there").join(other, ["source_id", "edge_pos"], "left")
    pending = marked.where("there").drop("there").unionByName(moved)
    judged = admit(pending.where("target_id is not null"), seeds_, total)
    counts = judged.groupBy("query_id").agg(F.sum((~F.col("accepted")).cast("int")).alias("truncated"))
    missing = pending.where("target_id is null").groupBy("query_id").agg(F.count("*").alias("missing"))
    return judged.where("accepted"), counts.join(missing, "query_id", "full").na.fill(0)


def assemble(candidates: DataFrame, seeds_: DataFrame, accepted: DataFrame, final_top_n: int, max_forced: int) -> DataFrame:
    """Context ``query_id, node_id, part, context_pos``: leading seeds, the best others, then forced dependencies.

    ``candidates`` carry ``pos``.
    """
    here = candidates.select("query_id", "node_id", "pos")
    lead = seeds_.where(F.col("seed_rank") <= final_top_n).join(here, ["query_id", "node_id"]).select("query_id", "node_id", F.lit(1).alias("part"), F.col("seed_rank").cast("bigint").alias("o"))
    rest = here.join(lead.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("pos")
    best = rest.withColumn("o", F.row_number().over(w)).where(F.col("o") <= final_top_n).select("query_id", "node_id", F.lit(2).alias("part"), F.col("o").cast("bigint").alias("o"))
    head = lead.unionByName(best)
    order = accepted.groupBy("query_id", "target_id").agg(F.min(F.struct("seed_rank", "ord")).alias("k")).withColumnRenamed("target_id", "node_id")
    deps = order.join(here, ["query_id", "node_id"], "left_semi").join(head.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("k")
    forced = deps.withColumn("o", F.row_number().over(w)).where(F.col("o") <= max_forced).select("query_id", "node_id", F.lit(3).alias("part"), F.col("o").cast("bigint").alias("o"))
    w = Window.partitionBy("query_id").orderBy("part", "o")
    return head.unionByName(forced).withColumn("context_pos", F.row_number().over(w)).drop("o")


def vector_texts(edges: DataFrame, chunks: DataFrame, labels: tuple[str, str, str, str] = ("当前内容：", "章节：", "依赖主题：", "相关依赖内容：")) -> DataFrame:
    """``node_id, text`` to embed for each chunk with edges: itself, its heading, the topics, and what it depends on and why."""
    target = chunks.select(F.col("node_id").alias("target_id"), F.col("summary").alias("target_summary"))
    filled = edges.join(target, "target_id", "left")
    lists = filled.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("edge_pos", F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("target_summary", F.lit("")).alias("s"), "reason"))).alias("es"))
    some = lambda c: F.filter(c, lambda x: x != "")
    take = lambda f: F.transform("es", f)
    own = F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise(F.col("text"))
    text: Column = F.concat_ws(
        "\n", F.concat(F.lit(labels[0]), own), F.concat(F.lit(labels[1]), F.coalesce("heading_path", F.lit(""))),
        F.concat(F.lit(labels[2]), F.array_join(some(take(lambda e: e.topic)), "、")),
        F.concat(F.lit(labels[3]), F.array_join(some(F.concat(take(lambda e: e.s), take(lambda e: e.reason))), "；")),
    )
    return chunks.join(lists, chunks["node_id"] == lists["source_id"]).select("node_id", text.alias("text"))
