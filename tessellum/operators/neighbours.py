"""Chunks beside the best ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand(candidates: DataFrame, chunks: DataFrame, radius: int, centres: int) -> DataFrame:
    """New neighbours of the first ``centres`` candidates (with ``pos``): ``query_id, node_id, center_node_id, rank``.

    Offsets are exploded, so that the band becomes an equi-join on document and index;
    a gap in the indices means no neighbour. The first centre to reach a chunk keeps
    it, nearer offsets before farther, the previous before the next.
    """
    place = chunks.select("doc_id", "chunk_index", "node_id")
    of = candidates.where(F.col("pos") <= centres).select("query_id", F.col("pos").alias("rank"), F.col("node_id").alias("center_node_id"))
    centre = of.join(place.withColumnRenamed("node_id", "center_node_id"), "center_node_id")
    offsets = [o for r in range(1, radius + 1) for o in (-r, r)]
    if not offsets:
        return of.select("query_id", F.col("center_node_id").alias("node_id"), "center_node_id", "rank").limit(0)
    wanted = centre.select("query_id", "rank", "center_node_id", "doc_id", "chunk_index", F.posexplode(F.array(*map(F.lit, offsets))).alias("turn", "off"))
    found = wanted.select("query_id", "rank", "turn", "center_node_id", "doc_id", (F.col("chunk_index") + F.col("off")).alias("chunk_index")).join(place, ["doc_id", "chunk_index"])
    new = found.join(candidates.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    first = Window.partitionBy("query_id", "node_id").orderBy("rank", "turn")
    return new.withColumn("n", F.row_number().over(first)).where("n = 1").select("query_id", "node_id", "center_node_id", "rank")
