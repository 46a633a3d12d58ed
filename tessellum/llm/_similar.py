"""What the similarity joins share: blocks of hot groups, exact verification, connected components.

Groups (buckets of candidates, clusters to verify) can hold any share of the rows. A
group of more than a block's rows is dealt out over pairs of blocks, so that a task
gets two blocks at most and every pair of members still meets once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, stored


def in_blocks(rows: DataFrame, key: str, block: int, share: int = 16) -> DataFrame:
    """``rows`` (with ``id``) plus ``bi``, ``bj`` and ``blk``: each pair of blocks of a key is a group, ``blk`` the member's own block.

    Hot keys are told by the members with one in ``share`` of all ids, so that no full
    count is shuffled; that decides on the dealing alone, never on the result. Their
    table is written, so that its size decides whether Spark may broadcast it. Without a
    hot key no column is added.
    """
    seen = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(share)) == 0).groupBy(key).agg((F.count("*") * share).alias("members"))
    hot = stored(seen.where(F.col("members") > block), "hot-keys")
    if hot.isEmpty():
        return rows
    dealt = rows.join(hot, key, "left").withColumn("nb", F.ceil(F.coalesce(F.col("members"), F.lit(1)) / block).cast("int"))
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("id", F.lit(3)), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return dealt.select(*rows.columns, F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk")


def grouped(rows: DataFrame, key: str) -> DataFrame:
    """Groups side by side within partitions; AQE's advisory size must not matter for results, only for the number of tasks."""
    keys = [key, *(c for c in ("bi", "bj") if c in rows.columns)]
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def blocks_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``blk``, ``bi`` and ``bj`` of every row; all 0 where groups are whole."""
    if "blk" not in table.column_names:
        return (np.zeros(table.num_rows, np.int32),) * 3
    return tuple(table.column(c).to_numpy() for c in ("blk", "bi", "bj"))


def each_group(batches: Iterator[pa.RecordBatch], key: str, least: int = 1) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Sorted batches as tables of whole groups, with the starts and sizes of their groups. ``least``: rows to gather first."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table, whole: bool):
        n = table.num_rows
        if not n:
            return None, table
        k, (_, i, j) = table.column(key).to_numpy(), blocks_of(table)
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        starts = np.flatnonzero(new)
        end = n if whole else starts[-1]
        if not end:
            return None, table
        starts = starts[starts < end]
        return (table.slice(0, end), starts, np.diff(np.append(starts, end))), table.slice(end)

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < least:
            continue
        done, rest = cut(pa.Table.from_batches(held), False)
        held = rest.combine_chunks().to_batches() if rest.num_rows else []
        if done:
            yield done
    if held:
        done, _ = cut(pa.Table.from_batches(held), True)
        if done:
            yield done


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def edges_of(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """A star for each component of a boolean matrix of links, as pairs of ids."""
    f = Forest(len(ids))
    for a, b in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        f.join(a, b)
    return [(int(ids[r]), int(ids[x])) for x in range(len(ids)) if (r := f.root(x)) != x and ids[r] != ids[x]]


def overlaps(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Intersection sizes of all pairs of sets; set i is ``values[offsets[i]:offsets[i + 1]]`` without repeats."""
    m = len(offsets) - 1
    sizes = np.diff(offsets)
    if m == 2:
        both = np.intersect1d(values[offsets[0] : offsets[1]], values[offsets[1] : offsets[2]], assume_unique=True).size
        return np.array([[sizes[0], both], [both, sizes[1]]], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(values[offsets[0] : offsets[-1]], kind="stable")
    v, owner = values[offsets[0] : offsets[-1]][order], owner[order]
    new = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1) > 1 if len(v) else np.zeros(0, bool)
    pick = shared[column] if len(v) else np.zeros(0, bool)
    column = (np.cumsum(shared) - 1)[column[pick]]
    owner, width = owner[pick], int(shared.sum())
    total = np.zeros((m, m), np.float64)
    step = max(256, 4_000_000 // m)
    for a in range(0, width, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        part = np.zeros((m, min(step, width - a)), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        total += part @ part.T
    out = total.astype(np.int64)
    out[np.arange(m), np.arange(m)] = sizes
    return out


def linked_pairs(values: np.ndarray, offsets: np.ndarray, blk: np.ndarray, same: bool, num: int, den: int) -> np.ndarray:
    """Upper triangle of pairs with ``den * |A & B| >= num * |A | B|``; of two blocks only the pairs across."""
    both = overlaps(values, offsets)
    sizes = np.diff(offsets)
    union = sizes[:, None] + sizes[None, :] - both
    ok = (den * both >= num * union) & (both > 0)
    if not same:
        ok &= blk[:, None] != blk[None, :]
    return ok


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of edges, each reduced to stars: the smallest member of each component of the batch, and every other one."""
    for b in batches:
        a, z = b.column("a").to_numpy(), b.column("b").to_numpy()
        ids, at = np.unique(np.concatenate([a, z]), return_inverse=True)
        f = Forest(len(ids))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            f.join(x, y)
        stars = [(r, x) for x in range(len(ids)) if (r := f.root(x)) != x]
        yield pa.RecordBatch.from_pydict({"a": ids[[r for r, _ in stars]], "b": ids[[x for _, x in stars]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (its smallest member) of every node of ``edges(a, b)``.

    Tasks that find edges reduce them by ``forest`` first. Until no edge is left, every node moves to its smallest neighbour, pointers are shortened and edges
    contracted. Sums are partial before shuffles and joins are left to AQE's splitting
    of skewed partitions, so a hub's edges never meet in one task; each round is
    written, so that a lost executor costs no more than its own tasks.
    """

    now = stored(edges.distinct(), "edges")
    labels: DataFrame | None = None
    while not now.isEmpty():
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        first = stored(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "parents")
        up = first
        for _ in range(2):
            hop = up.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            up = up.join(hop, "p").select("u", F.col("pp").alias("p"))
        up = stored(up, "parents")
        a, b = (up.select(F.col("u").alias(c), F.col("p").alias(f"{c}_up")) for c in ("a", "b"))
        moved = now.join(a, "a").join(b, "b").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
        before, known = now, labels
        now = stored(moved.where("a <> b").distinct(), "edges")
        if labels is None:
            labels = up.select(F.col("u").alias("id"), F.col("p").alias("component"))
        else:
            hop = up.select(F.col("u").alias("component"), F.col("p").alias("further"))
            labels = labels.join(hop, "component", "left").select("id", F.coalesce("further", "component").alias("component"))
        labels = stored(labels, "labels")
        discard(first, up, before, known)
    discard(now)
    return labels if labels is not None else edges.sparkSession.createDataFrame([], "id bigint, component bigint")
