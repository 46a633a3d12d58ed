"""Operator 9: near duplicates by a multi-index join of b-bit MinHash signatures.

A document's set holds its distinct word shingles. Of each set, ``chunks * slots``
minima are kept, 16 bits of each. The signature is split into chunks; by pigeonhole,
two signatures that differ in at most ``chunks * (errors + 1) - 1`` places have a chunk
that differs in ``errors`` places at most, so every way of leaving ``errors`` places out
of a chunk is enumerated as a key, and all such pairs share one. (Pairs further apart
are found too unless every chunk has more errors: at a similarity of exactly 0.8 and
the parameters below, about 1 in 10 million is missed, and none of 100,000 such pairs
of random sets in a test.) Pairs under a key whose 4-bit slots differ in too many
places are left out: 17 of 32, five deviations beyond a similarity of 0.8. The rest
join clusters, whose full sets are compared exactly.

Equal sets are one class from the start. Classes that share a hot key become candidates
by a star, large clusters are verified against pivots before pairs (``exact_links``), and
neither pairs nor links are ever all listed: each task emits a spanning forest.

Edge cases: a null, empty or blank text has an empty set and is linked with nothing;
a text of fewer words than a shingle is one shingle; rows that share a ``doc_id`` are
one document, through which their classes are linked; a row without ``doc_id`` is linked with nothing and gets null
``component_id`` and ``kept``; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, map_batches, release, stored, tidied
from ._similar import blocks_of, components, each_group, edges_of, forest, grouped, in_blocks, linked_pairs
from ._words import joined, mix

CHUNKS, SLOTS, ERRORS = 12, 5, 1
FILTER_SLOTS, FILTER_ERRORS = 32, 17
BLOCK = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sets of 64-bit shingle hashes of texts. A-Z are lower-cased; words are runs without space and \\t to \\r."""
    h, _, sizes = joined([t.encode().lower() if t else b"" for t in texts])
    total, s = len(h), h.copy()
    for k in range(1, width):
        s[: max(0, total - k)] = mix(s[: max(0, total - k)] * _ODD + h[k:])
    out, at = [], 0
    for n in sizes.tolist():
        if n >= width:
            out.append(np.unique(s[at : at + n - width + 1]))
        elif n:
            whole = h[at : at + 1] + np.uint64(n)
            for x in h[at + 1 : at + n]:
                whole = mix(whole * _ODD + x)
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _multipliers() -> np.ndarray:
    return np.random.default_rng(9).integers(0, 2**63, CHUNKS * SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, by: np.ndarray) -> np.ndarray:
    """16 bits of the minimum under each multiplier."""
    least = np.full(len(by), 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), 4096):
        part = shingles[a : a + 4096]
        least = np.minimum(least, (part[None, :] * by[:, None]).min(axis=1))
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def probe_keys(sigs: np.ndarray) -> np.ndarray:
    """Keys of every chunk under every choice of ``ERRORS`` places left out: rows by probes."""
    keys = []
    x = sigs.astype(np.uint64).reshape(len(sigs), CHUNKS, SLOTS)
    for c in range(CHUNKS):
        for n, kept in enumerate(itertools.combinations(range(SLOTS), SLOTS - ERRORS)):
            k = np.full(len(sigs), c * 1000 + n, np.uint64)
            for s in kept:
                k = mix(k * _ODD + x[:, c, s])
            keys.append(k)
    return np.stack(keys, axis=1).view(np.int64)


def pack_filter(sigs: np.ndarray) -> np.ndarray:
    """4 bits of each of the first 32 slots, in two words."""
    low = (sigs[:, :FILTER_SLOTS] & 15).astype(np.uint64).reshape(len(sigs), 2, 16)
    return (low << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def slot_errors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slots in which packed filters differ."""
    x = a ^ b
    x = x | (x >> np.uint64(1))
    x = (x | (x >> np.uint64(2))) & np.uint64(0x1111111111111111)
    return np.bitwise_count(x)


def classes(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, set_hash, sig`` of every row, stored; null hash and signature for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _multipliers()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = shingle_hashes(b.column("text").to_pylist(), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s, by).astype("<u2").tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_hash", "sig"],
                )

    return stored(map_batches(docs, ["doc_id", "text"], run, "doc_id bigint, n_shingles bigint, set_hash binary, sig binary"), "signatures")


def candidates(reps: DataFrame) -> DataFrame:
    """Edges ``a, b`` whose components hold every pair under the signature distance. ``reps``: ``id, sig``."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(b.num_rows, -1)
                keys, packed = probe_keys(sigs), pack_filter(sigs)
                n = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel(), np.repeat(b.column("id").to_numpy(), n), np.repeat(packed[:, 0], n), np.repeat(packed[:, 1], n))], names=["key", "id", "s1", "s2"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, sizes in each_group(batches, "key", least=50_000):
            ids = table.column("id").to_numpy()
            s1, s2 = (table.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2"))
            two = starts[sizes == 2]
            near = slot_errors(s1[two], s1[two + 1]) + slot_errors(s2[two], s2[two + 1]) <= FILTER_ERRORS
            out = list(zip(ids[two[near]].tolist(), ids[two[near] + 1].tolist(), strict=True))
            for a, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                z = a + m
                ok = np.empty((m, m), bool)
                for x in range(a, z, 128):  # a few rows at a time: what is compared takes many times the memory of the answer
                    y = min(z, x + 128)
                    ok[x - a : y - a] = slot_errors(s1[x:y, None], s1[None, a:z]) + slot_errors(s2[x:y, None], s2[None, a:z]) <= FILTER_ERRORS
                out += edges_of(np.triu(ok, 1), ids[a:z])
            if out:
                x = np.array(sorted({(min(p), max(p)) for p in out if p[0] != p[1]}), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    probes = reps.select("id", "sig").mapInArrow(tidied(probe), "key bigint, id bigint, s1 bigint, s2 bigint")
    # A sixteenth of the classes tells hot keys. All that share one become candidates of each other, by a star: a superset, for which no pairs are compared.
    seen = probes.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(16)) == 0).groupBy("key").agg((F.count("*") * 16).alias("members"))
    hot = stored(seen.where(F.col("members") > 4 * BLOCK).select("key"), "hot-keys")
    if hot.isEmpty():
        return grouped(probes, "key").mapInArrow(tidied(lambda batches: forest(pairs(batches))), "a bigint, b bigint")
    # Merge joins: the hot keys may grow with the documents.
    rest = probes.join(hot.hint("merge"), "key", "left_anti")
    many = probes.select("key", "id").join(hot.hint("merge"), "key")
    stars = many.join(many.groupBy("key").agg(F.min("id").alias("a")), "key").where("a <> id").select("a", F.col("id").alias("b"))
    return grouped(rest, "key").mapInArrow(tidied(lambda batches: forest(pairs(batches))), "a bigint, b bigint").unionByName(stars)


def verified(dealt: DataFrame, num: int, den: int) -> DataFrame:
    """Spanning forests ``a, b`` of the links within each group of ``dealt``; of two blocks only pairs across count."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, sizes in each_group(batches, "cluster"):
            ids, (blk, bi, bj) = table.column("id").to_numpy(), blocks_of(table)
            lists = table.column("tokens").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            out: list[tuple[int, int]] = []
            for a, m in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                ok = linked_pairs(values, offsets[a : a + m + 1], blk[a : a + m], bi[a] == bj[a], num, den)
                out += edges_of(np.triu(ok, 1), ids[a : a + m])
            if out:
                x = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    return grouped(dealt, "cluster").mapInArrow(tidied(lambda batches: forest(verify(batches))), "a bigint, b bigint")


LINKED, NEAR, FAR = 0, 1, 2


def by_pivot(rest: DataFrame, num: int, den: int) -> DataFrame:
    """``cluster, id, tokens, nb, pivot, kind`` of every member against the first of its cluster, stored. ``rest`` has ``nb``, the blocks of the cluster."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                kinds = []
                for x, y in zip(b.column("tokens"), b.column("ptokens"), strict=True):
                    x, y = x.values.to_numpy(), y.values.to_numpy()
                    both = np.intersect1d(x, y, assume_unique=True).size
                    union = len(x) + len(y) - both
                    kinds.append(LINKED if den * both >= num * union and both else NEAR if den * both >= (2 * num - den) * union else FAR)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("cluster", "id", "tokens", "nb", "pivot")), pa.array(kinds, pa.int32())], names=["cluster", "id", "tokens", "nb", "pivot", "kind"])

    # Members are salted by as many parts as their cluster has blocks, and its one pivot goes to each part.
    first = rest.groupBy("cluster").agg(F.min("id").alias("id"))
    pivots = rest.join(first, ["cluster", "id"]).select("cluster", F.col("id").alias("pivot"), F.col("tokens").alias("ptokens"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("salt"))
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(11)), F.col("nb")).cast("int"))
    met = salted.join(pivots.hint("merge"), ["cluster", "salt"]).select("cluster", "id", "tokens", "nb", "pivot", "ptokens")
    return stored(met.mapInArrow(tidied(judge), "cluster bigint, id bigint, tokens array<bigint>, nb int, pivot bigint, kind int"), "judged")


def across(judged: DataFrame) -> DataFrame:
    """The near members of each cluster and the linked ones in blocks, so that each near one meets each linked one once."""
    sizes = judged.groupBy("cluster").agg(*(F.ceil(F.count(F.when(F.col("kind") == k, 1)) / BLOCK).cast("int").alias(n) for k, n in ((NEAR, "nn"), (LINKED, "nl")))).where("nn > 0 and nl > 0")
    both = judged.where(F.col("kind") != FAR).join(sizes.hint("merge"), "cluster")
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    near = F.col("kind") == NEAR
    dealt = both.select("cluster", "id", "tokens", F.col("kind").alias("blk"), F.explode(F.when(near, F.transform(every("nl"), lambda j: F.struct(own("nn").alias("bi"), (-1 - j).alias("bj")))).otherwise(F.transform(every("nn"), lambda i: F.struct(i.alias("bi"), (-1 - own("nl")).alias("bj"))))).alias("at"))
    return dealt.select("cluster", "id", "tokens", "at.bi", "at.bj", "blk")


def exact_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Spanning forests ``a, b`` of the links within each cluster. ``sets``: ``cluster, id, tokens``, stored.

    In a large cluster all members are first held against one of them, which takes as
    many comparisons as it has members. The distance of Jaccard is a metric: what is
    further from that pivot than twice the threshold is linked with none that is linked
    with the pivot. So the linked ones, most of a group of copies, meet neither each other
    (they are connected) nor the far ones, but only the near ones. Two rounds of that,
    then what is left meets in pairs of blocks.
    """
    sizes = sets.groupBy("cluster").agg(F.count("*").alias("n"))
    large = stored(sizes.where(F.col("n") > 2 * BLOCK).select("cluster", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb")), "large-clusters")
    if large.isEmpty():
        return verified(in_blocks(sets, "cluster", BLOCK), num, den)
    edges = verified(sets.join(large.hint("merge"), "cluster", "left_anti"), num, den)
    rest = sets.join(large.hint("merge"), "cluster").select("cluster", "id", "tokens", "nb")
    for _ in range(2):
        judged = by_pivot(rest, num, den)
        edges = edges.unionByName(judged.where((F.col("kind") == LINKED) & (F.col("id") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("id").alias("b")))
        edges = edges.unionByName(verified(across(judged), num, den))
        rest = judged.where(F.col("kind") != LINKED).select("cluster", "id", "tokens", "nb")
    return edges.unionByName(verified(in_blocks(rest.drop("nb"), "cluster", BLOCK), num, den))


def shingle_sets(docs: DataFrame, clusters: DataFrame, width: int) -> DataFrame:
    """``cluster, id, tokens`` of the documents in ``clusters(id, component)``: sets are made again, not carried through the candidate search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = shingle_hashes(b.column("text").to_pylist(), width)
                yield pa.RecordBatch.from_arrays([b.column("component"), b.column("id"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["cluster", "id", "tokens"])

    # The clusters grow with the documents: a merge join at every size, never a broadcast. Stored, as dealing out reads them twice.
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(clusters.hint("merge"), "id")
    return stored(chosen.select("component", "id", "text").mapInArrow(tidied(run), "cluster bigint, id bigint, tokens array<bigint>"), "shingle-sets")


def shared_ids(live: DataFrame, reps: DataFrame) -> DataFrame | None:
    """Edges ``a, b`` between the classes of rows that share a ``doc_id``; None where none do."""
    repeated = stored(live.groupBy("doc_id").agg(F.min("set_hash").alias("x"), F.max("set_hash").alias("y")).where("x <> y").select("doc_id"), "shared-ids")
    if repeated.isEmpty():
        return None
    of_class = live.join(repeated, "doc_id", "left_semi").select("doc_id", "set_hash").distinct().join(reps.select("set_hash", "id").hint("merge"), "set_hash").select("doc_id", F.col("id").alias("b"))
    first = of_class.groupBy("doc_id").agg(F.min("b").alias("a"))
    return of_class.join(first, "doc_id").where("a <> b").select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row: components under ``den * intersection >= num * union``."""
    rows = classes(docs, width)
    live = rows.where("set_hash is not null and doc_id is not null")
    reps = stored(live.groupBy("set_hash").agg(F.min(F.struct("doc_id", "sig")).alias("r")).select("set_hash", F.col("r.doc_id").alias("id"), F.col("r.sig").alias("sig")), "classes")
    clusters = components(candidates(reps))
    release(docs.sparkSession)
    sets = shingle_sets(docs, clusters, width)
    found, same = exact_links(sets, num, den), shared_ids(live, reps)
    links = components(found if same is None else found.unionByName(same))
    discard(clusters, sets)
    release(docs.sparkSession)
    named = reps.select("set_hash", "id").join(links, "id", "left").select("set_hash", F.coalesce("component", "id").alias("component"))
    # Rows without a class get a key of their own, so that they don't meet in one task.
    keyed = rows.select("doc_id", "n_shingles", F.coalesce("set_hash", F.col("doc_id").cast("string").cast("binary")).alias("set_hash"))
    ids = keyed.join(named.hint("merge"), "set_hash", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return ids.withColumn("kept", F.col("doc_id") == F.col("component_id"))
