"""What changed since the last build, and tables brought up to date without rebuilding the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``doc_key, change`` (added, changed, deleted, unchanged) of two states ``doc_key, content_hash``."""
    p, c = previous.select("doc_key", F.col("content_hash").alias("old")), current.select("doc_key", F.col("content_hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return p.join(c, "doc_key", "full_outer").select("doc_key", change.alias("change"))


@dataclass(frozen=True)
class Signals:
    """Changes that concern all documents."""

    chunking: bool = False
    annotation: bool = False
    dependency: bool = False
    schema: bool = False
    model: bool = False

    @classmethod
    def of(cls, previous: dict | None, now: dict, schema: bool = False) -> Signals:
        """From two manifests. Versions and models count only against an earlier value, chunking on a first run too; a prompt's hash where versions agree."""
        p = previous or {}
        chunking = any(p.get(k) != now.get(k) for k in ("chunk_size", "chunk_overlap"))

        def prompt(name: str) -> bool:
            version, digest = f"{name}_prompt_version", f"{name}_prompt_hash"
            if p.get(version) and p[version] != now.get(version):
                return True
            return bool(p.get(digest)) and p[digest] != now.get(digest)

        return cls(chunking, prompt("annotation"), prompt("dependency"), schema, bool(p.get("embedding_model")) and p["embedding_model"] != now.get("embedding_model"))


def decide(changes: DataFrame, s: Signals) -> DataFrame:
    """``changes`` plus what each current document needs: ``rechunk, reannotate, redependency, reembed`` and a reason."""
    live, content = F.col("change") != "deleted", F.col("change").isin("added", "changed")
    need = lambda *all_: live & (content | F.lit(any(all_)))
    reason = F.concat_ws(",", F.when(content, "content"), *(F.lit(n) for n in ("chunking", "annotation", "dependency", "schema", "model") if getattr(s, n)))
    again = s.chunking or s.annotation
    return changes.select(
        "doc_key", "change", need(s.chunking).alias("rechunk"), need(again).alias("reannotate"), need(again, s.dependency, s.schema).alias("redependency"),
        need(again, s.model).alias("reembed"), F.when(live, reason).otherwise("deleted").alias("reason"),
    )


def path_of(decision: DataFrame) -> str:
    """``none``, ``dependency``, ``embedding`` or ``full``, from one row of counts."""
    n = decision.agg(*(F.sum(F.col(c).cast("int")).alias(c) for c in ("reannotate", "redependency", "reembed"))).first()
    if n["reannotate"]:
        return "full"
    return "dependency" if n["redependency"] else "embedding" if n["reembed"] else "none"


def upsert(old: DataFrame, new: DataFrame, keys: list[str], gone: DataFrame | None = None) -> DataFrame:
    """``old`` less what ``new`` or ``gone`` names, and ``new``."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    if gone is not None:
        kept = kept.join(gone.select(*[c for c in keys if c in gone.columns]).distinct(), [c for c in keys if c in gone.columns], "left_anti")
    return kept.unionByName(new)


def next_state(chunks: DataFrame, current: DataFrame) -> DataFrame:
    """``doc_key, content_hash, node_ids, node_count`` of all current documents, those without chunks too."""
    ids = chunks.groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "node_id"))).alias("c"))
    names: Column = F.coalesce(F.transform("c", lambda x: x.node_id), F.array().cast("array<string>"))
    return current.join(ids, "doc_key", "left").select("doc_key", "content_hash", names.alias("node_ids"), F.size(names).alias("node_count"))


def stale_nodes(state: DataFrame, decision: DataFrame) -> DataFrame:
    """Ids to delete: those of deleted documents and of those chunked anew."""
    return state.join(decision.where("change = 'deleted' or rechunk"), "doc_key", "left_semi").select(F.explode("node_ids").alias("node_id")).distinct()


def violations(state: DataFrame, chunks: DataFrame, doc_stats: DataFrame, cards: DataFrame, vectors: DataFrame) -> DataFrame:
    """``rule, key`` of whatever breaks an index's integrity; empty when it may be published."""
    nodes = state.select("doc_key", F.explode("node_ids").alias("node_id"))

    def apart(rule: str, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
        left = a.select(F.col(key).cast("string").alias("key")).exceptAll(b.select(F.col(key).cast("string").alias("key")))
        return left.select(F.lit(rule).alias("rule"), "key")

    content = vectors.where("route = 'content'")
    rules = [
        apart("document without card", state, cards, "doc_key"), apart("card without document", cards, state, "doc_key"),
        apart("node without chunk", nodes, chunks, "node_id"), apart("chunk without node", chunks, nodes, "node_id"),
        apart("chunk not in keyword index", chunks, doc_stats, "node_id"), apart("keyword index beyond chunks", doc_stats, chunks, "node_id"),
        apart("chunk without content vector", chunks, content, "node_id"), apart("content vector without chunk", content, chunks, "node_id"),
        cards.join(state.select("doc_key", "content_hash"), "doc_key").where("status <> 'success' or doc_content_hash <> content_hash").select(F.lit("card out of date").alias("rule"), F.col("doc_key").alias("key")),
        state.where("node_count <> size(node_ids)").select(F.lit("node count").alias("rule"), F.col("doc_key").alias("key")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out
