"""Operator 3: nearest neighbours by shifted Hilbert curves.

Equal vectors are one class from the start. Each curve projects the classes on a few
random orthogonal directions, shifts the grid and orders the cells along a Hilbert
curve. A class is sent once for each curve, as its key and its components in bytes, to
the key range that it falls in. Sorted ranges are cut into windows of ``block`` rows,
and a query meets its own window and the two beside it: ``3 * block * curves`` rows at
most, however many there are. The nearest of all windows merge and are reranked by
inner products of the original vectors.

That number is fixed and so the recall depends on the data: it stays where neighbours
are much nearer than the rest, and falls with the size of the table where they are not
(README has figures). ``curves`` and ``block`` raise it. Curves keep together what is
close in distance: where norms differ widely, the largest inner products may be those of
long vectors elsewhere, which are found less surely.

Edge cases: vectors that are null, zero, of another length than most (of the shorter, if
two lengths are as frequent), or hold null or non-finite components take no part; null
ids neither; rows that repeat a ``vec_id`` count once, by their best score; ties go to
the smaller id; fewer candidates than ``k`` are all returned; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_batches, release, stored, tidied


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of cells of a grid (Skilling's transform, vectorised over rows)."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, swap)
            if i:
                x[:, i] ^= swap
            else:
                x[:, 0] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


@dataclass
class Index:
    """Curves, and the key ranges of each; all of it bounded by the parameters of ``fit``."""

    size: int
    bits: int
    axes: np.ndarray  # curve, component, direction
    low: np.ndarray
    scale: np.ndarray
    bounds: np.ndarray  # of each curve the upper keys of its ranges but the last

    def keys(self, x: np.ndarray, ids: np.ndarray, c: int) -> np.ndarray:
        """Keys on a curve; bits of the id tell rows of one cell apart, so that a crowded cell is cut like any other."""
        cells = np.clip((x @ self.axes[c] - self.low[c]) * self.scale[c], 0, (1 << self.bits) - 1).astype(np.int64)
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        return hilbert_keys(cells, self.bits) << 16 | mixed.astype(np.int64)


def fit(sample: np.ndarray, ids: np.ndarray, ranges: int, curves: int, dims: int, bits: int, seed: int) -> Index:
    rng = np.random.default_rng(seed)
    size = sample.shape[1]
    axes = np.stack([np.linalg.qr(rng.normal(size=(size, min(dims, size))))[0] for _ in range(curves)])
    low, scale = [], []
    for a in axes:
        p = sample @ a
        span = np.maximum(np.ptp(p, axis=0), 1e-12)
        low.append(p.min(axis=0) - span * rng.uniform(0, 0.25, len(span)))
        scale.append((1 << bits) / (span * 1.25))
    index = Index(size, bits, axes, np.stack(low), np.stack(scale), np.zeros((curves, 0), np.int64))
    at = [len(sample) * i // ranges for i in range(1, ranges)]
    index.bounds = np.stack([np.sort(index.keys(sample, ids, c))[at] for c in range(curves)])
    return index


def windows(codes: np.ndarray, asked: np.ndarray, ids: np.ndarray, block: int, most: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and score of the ``most`` best of each query of the windows from ``first`` to before ``last``, among theirs and the two beside them."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for w in range(first, last):
        q = np.flatnonzero(asked[w * block : (w + 1) * block]) + w * block
        if not len(q):
            continue
        lo, hi = max(0, (w - 1) * block), min(len(ids), (w + 2) * block)
        s = codes[q] @ codes[lo:hi].T
        n = min(most, hi - lo)
        at = np.argpartition(-s, n - 1, axis=1)[:, :n]
        out.append((np.repeat(ids[q], n), ids[lo:hi][at].ravel(), np.take_along_axis(s, at, axis=1).ravel()))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size)


def search(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20,
    curves: int = 48, dims: int = 12, bits: int = 2, block: int = 256, range_rows: int = 50_000, sample: int = 20_000, seed: int = 5,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose id is divisible by ``every``.

    ``sample`` bounds the rows that the index is fitted on; every row is indexed.
    ``range_rows``: about the rows of a key range, of which there are 400 a curve at most.
    """
    spark = rows.sparkSession
    nothing = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and size(v) > 0").where(good)
    common = usable.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if common is None:
        return nothing
    size = common["size"]
    rows = usable.where(F.size("v") == size).select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(seed)).alias("h2"))
    of_id = F.col("id") % every == 0
    classes = stored(rows.groupBy("h1", "h2").agg(F.min("v").alias("v"), F.max(of_id).alias("asked")).withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    # Of a class, no query needs more than its k + 1 smallest ids. The rank is limited before the shuffle.
    named = rows.select("id", "h1", "h2").distinct().join(classes.select("h1", "h2", "cid"), ["h1", "h2"]).select("cid", "id")
    members = named.withColumn("n", F.row_number().over(Window.partitionBy("cid").orderBy("id"))).where(F.col("n") <= k + 1).select("cid", "id")
    asking = named.where(of_id)
    n = classes.count()
    share = int(np.ceil(1e6 * min(1.0, sample / n)))
    drawn = classes.where(F.pmod(F.xxhash64("cid", F.lit(seed)), F.lit(1_000_000)) < share).select("cid", "v").toArrow() if n > 1000 else classes.select("cid", "v").toArrow()
    ranges = min(400, n // range_rows + 1) if drawn.num_rows >= 400 else 1
    index = fit(_matrix(drawn.column("v"), size), drawn.column("cid").to_numpy(), ranges, curves, dims, bits, seed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                x, ids = _matrix(b.column("v"), size), b.column("cid").to_numpy()
                top = np.abs(x).max(axis=1, keepdims=True)
                codes = np.round(x / top * 127).astype(np.int8)
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(ids), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
                for c in range(curves):
                    keys = index.keys(x, ids, c)
                    at = np.searchsorted(index.bounds[c], keys, side="right") + c * ranges
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(keys), pa.array(ids), b.column("asked"), pa.array((top[:, 0] / 127).astype(np.float32)), flat], names=["range", "key", "cid", "asked", "unit", "code"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted ranges in runs of windows; a run takes the last two windows of the one before along."""
        held: list[pa.RecordBatch] = []
        rows_held, at, inner = 0, None, False  # the range at hand, and whether windows of it have been searched

        def run(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows_held, inner
            t = pa.Table.from_batches(held)
            code = t.column("code").combine_chunks()
            code = code.chunk(0) if isinstance(code, pa.ChunkedArray) else code
            begin = int(np.frombuffer(code.buffers()[1], np.int32)[code.offset])
            codes = np.frombuffer(code.buffers()[2], np.int8)[begin : begin + len(code) * size].reshape(len(code), size).astype(np.float32) * t.column("unit").to_numpy()[:, None]
            ids = t.column("cid").to_numpy()
            count = -(-len(ids) // block)
            last = count if whole else max(1, len(ids) // block - 1)  # the window behind must be there
            q, c, s = windows(codes, t.column("asked").to_numpy(zero_copy_only=False), ids, block, 2 * k + 2, 1 if inner else 0, last)
            inner = not whole
            rest = t.slice((last - 1) * block) if not whole else t.slice(0, 0)
            held, rows_held = rest.combine_chunks().to_batches(), rest.num_rows
            for a in range(0, len(q), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(q[a : a + 50_000]), pa.array(c[a : a + 50_000]), pa.array(s[a : a + 50_000])], names=["q", "c", "s"])

        for b in batches:
            marks = b.column("range").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if at is not None and marks[lo] != at and held:
                    yield from run(True)
                    inner = False
                at = marks[lo]
                held.append(b.slice(lo, hi - lo))
                rows_held += hi - lo
                if rows_held >= 40 * block:
                    yield from run(False)
        if held:
            yield from run(True)

    dealt = map_batches(classes, ["cid", "v", "asked"], deal, "range int, key bigint, cid bigint, asked boolean, unit float, code binary")
    found = dealt.repartition("range").sortWithinPartitions("range", "key", "cid").mapInArrow(tidied(merge), "q bigint, c bigint, s float")
    best = found.groupBy("q", "c").agg(F.max("s").alias("s"))
    lists = best.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("d"), "c"))), 1, 2 * k + 2).alias("all"))  # 2 k + 2 a curve at most
    near = stored(lists.select("q", F.explode(F.transform("all", lambda x: x.c)).alias("c")), "near-classes")
    release(spark)
    vectors = classes.select("cid", "v")
    pairs = near.join(vectors.select(F.col("cid").alias("q"), F.col("v").alias("qv")).hint("merge"), "q").join(vectors.select(F.col("cid").alias("c"), F.col("v").alias("cv")).hint("merge"), "c")
    exact = pairs.select("q", "c", F.aggregate(F.zip_with("qv", "cv", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("s"))
    scored = exact.join(members.withColumnRenamed("cid", "c").hint("merge"), "c").groupBy("q", F.col("id").alias("vec_id")).agg(F.max("s").alias("s"))
    top = scored.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("d"), "vec_id"))), 1, k + 1).alias("all"))  # (2 k + 2) (k + 1) at most
    mine = asking.select(F.col("cid").alias("q"), F.col("id").alias("query_id")).join(top.hint("merge"), "q")
    own = mine.select("query_id", F.explode(F.filter("all", lambda x: x.vec_id != F.col("query_id"))).alias("x"))
    once = own.groupBy("query_id", F.col("x.vec_id").alias("vec_id")).agg(F.min("x.d").alias("d"))  # an id may have several vectors
    ranked = once.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "vec_id"))), 1, k).alias("all"))
    out = ranked.select("query_id", F.posexplode("all").alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.d")).alias("score"))
