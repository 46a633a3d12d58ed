"""Exact nearest vectors of a set of queries, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vector bytes of queries that may be sent to every task; more are taken in further scans.
QUERY_BYTES = 32_000_000


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, node_id, rank, raw_score`` (less the squared distance) of the ``k`` nearest of ``vectors(node_id, embedding)``.

    Queries (``query_id, embedding``) travel in groups of bounded size. Of every 4,096
    vectors the ``k`` best of each query are sent on. Vectors of another length than the query's, and null or empty
    ones, don't count; ties go to the smaller ``node_id``.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["node_id"]
    schema = f"query_id bigint, node_id {kind}, raw_score double"
    parts, group, held = [], [], 0
    rows = queries.where("size(embedding) > 0").select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).toLocalIterator()
    for r in rows:
        group.append((r["query_id"], r["embedding"]))
        held += 8 * len(r["embedding"])
        if held > QUERY_BYTES:
            parts.append(_scan(vectors, group, k, schema))
            group, held = [], 0
    if group:
        parts.append(_scan(vectors, group, k, schema))
    if not parts:
        return spark.createDataFrame([], f"query_id bigint, node_id {kind}, rank int, raw_score double")
    near = parts[0]
    for p in parts[1:]:
        near = near.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.col("raw_score").desc(), "node_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "node_id", "rank", "raw_score")


def _scan(vectors: DataFrame, group: list, k: int, schema: str) -> DataFrame:
    sizes = sorted({len(v) for _, v in group})
    sets = [(np.array([q for q, v in group if len(v) == d]), np.array([v for _, v in group if len(v) == d], dtype=np.float64)) for d in sizes]
    shared = vectors.sparkSession.sparkContext.broadcast(sets)

    def nearest(ids: list, x: np.ndarray, names: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Distances by norms and one product choose; those that could be among the ``k`` best are then measured by differences."""
        norms = (x**2).sum(axis=1)
        for a in range(0, len(q), 64):
            part = q[a : a + 64]
            d = (part**2).sum(axis=1)[:, None] + norms[None, :] - 2 * (part @ x.T)
            cut = np.partition(d, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
            slack = 1e-9 * (norms.max() + (part**2).sum(axis=1))
            i, j = np.nonzero(d <= (cut + slack)[:, None])
            exact = np.concatenate([((part[i[z : z + 4096]] - x[j[z : z + 4096]]) ** 2).sum(axis=1) for z in range(0, len(i), 4096)])
            order = np.lexsort((j, exact, i))
            i, j, exact = i[order], j[order], exact[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield pa.RecordBatch.from_arrays([pa.array(names[a + i[keep]]), pa.array([ids[z] for z in j[keep]]), pa.array(-exact[keep])], names=["query_id", "node_id", "raw_score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                lists = b.column("embedding")
                sizes = np.array(pc.fill_null(pc.list_value_length(lists), 0))
                holes = np.zeros(len(sizes), bool)
                if lists.flatten().null_count:
                    holes = np.array([v is not None and None in v for v in lists.to_pylist()])
                for names, q in shared.value:
                    own = np.flatnonzero((sizes == q.shape[1]) & ~holes)
                    if not len(own):
                        continue
                    ids = b.column("node_id").take(pa.array(own)).to_pylist()
                    by_id = sorted(range(len(ids)), key=ids.__getitem__)
                    x = lists.take(pa.array(own[by_id])).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                    yield from nearest([ids[i] for i in by_id], x, names, q)

    return vectors.select("node_id", "embedding").mapInArrow(run, schema)
