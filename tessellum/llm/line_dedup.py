"""Operator 2: near-duplicate lines by an exact set-similarity join.

A line's tokens are its distinct words, A-Z lower-cased, ordered by rarity: a sketch
of fixed size counts the words of all texts. Lines with equal sets are one class. A class
posts the prefix that any set with a Jaccard similarity of 0.8 must share a token of;
posts that meet pass filters of length, position and a 128-bit bitmap, all of them safe. What remains joins
clusters, whose full sets are compared exactly in blocks of bounded size. A line is
removed if a line before it (by ``doc_id``, then place) has an equal or similar set.

Edge cases: lines without words are kept and match nothing; a null text has no lines
and stays null; a text whose every line with words goes becomes empty; rows that
share a ``doc_id`` are ordered by their texts, and of those that repeat its text too one
keeps its lines and the others lose all that have words; rows without an id are left alone; an
empty table gives no rows; extra columns are kept as they
are, but for any named as those that this adds.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, map_batches, release, stored, tidied
from ._similar import blocks_of, components, each_group, edges_of, forest, grouped, in_blocks, linked_pairs
from ._words import word_hashes

#: Counters of the word sketch, a power of two: what the driver gets and broadcasts whatever the input.
COUNTERS = 1 << 18
PARTS = 64
#: Slots in which hot keys are marked, a power of two.
SLOTS = 1 << 20
#: Sets whose first lines a task remembers.
REMEMBERED = 200_000
BLOCK = 512
NUM, DEN = 80, 100
_BLANK = " \t\n\x0b\x0c\r"


def word_levels(docs: DataFrame) -> np.ndarray:
    """A level of frequency (eight to each doubling) for every counter of a sketch of all words of all texts.

    Words that share a counter share a level; levels only order tokens, so that
    changes no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                raw = "\n".join(t or "" for t in whole.column("text").slice(at, 256).to_pylist()).encode().lower()
                counts += np.bincount((word_hashes(raw)[0] % COUNTERS).astype(np.int64), minlength=COUNTERS)
        yield from rows(counts)

    def rows(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = counts.reshape(PARTS, -1)
        some = np.flatnonzero(cut.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([cut[i].astype("<i8").tobytes() for i in some], pa.binary())], names=["part", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, COUNTERS // PARTS), np.int64)
        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("counts"), strict=True):
                sums[part] += np.frombuffer(raw.as_py(), "<i8")
        yield from rows(sums)

    # A task sends PARTS rows, whatever it has read; each part of the sketch is summed by one task.
    sums = map_batches(docs, ["text"], run, "part int, counts binary").repartition("part").mapInArrow(tidied(total), "part int, counts binary").toLocalIterator()
    counts = np.zeros((PARTS, COUNTERS // PARTS), np.int64)
    for r in sums:  # PARTS rows
        counts[r["part"]] += np.frombuffer(r["counts"], "<i8")
    flat = counts.ravel()
    return np.where(flat > 0, np.minimum(255, np.round(8 * np.log2(np.maximum(1, flat)))), 0).astype(np.uint8)


def tokens(raw: bytes, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all lines of ``raw`` (lower-case), in order and without repeats, and the offsets of each line's.

    A token is the level of its word, then 56 bits of its hash.
    """
    h, starts = word_hashes(raw)
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    line = np.searchsorted(ends, starts)
    flat = levels[(h % COUNTERS).astype(np.int64)].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8)
    order = _by_line(flat, line)
    flat = flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (line[1:] != line[:-1])
    counts = np.bincount(line[new], minlength=len(ends) + 1)
    return flat[new], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _by_line(values: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Order by line, then value; ``line`` already ascends, and a stable sort of small integers is a radix sort."""
    order = np.argsort(values)
    return order[np.argsort(line[order].astype(np.uint16) if len(line) and line[-1] < 65536 else line[order], kind="stable")]


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Tokens of which two similar sets share one. Sets of fewer than four have none: only an equal set is similar."""
    return np.where(n > 3, n - -(-n * NUM // DEN) + 1, 0)


def least_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return -(-(n + m) * NUM // (DEN + NUM))


def bitmaps(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two words of 64 bits a line, a bit flipped by each token: two sets differ in as many tokens at least as their bitmaps in bits."""
    mixed = tokens * np.uint64(0x9E3779B97F4A7C15)
    bits = np.uint64(1) << (mixed >> np.uint64(58))
    second = (mixed >> np.uint64(57) & np.uint64(1)).astype(bool)
    out = np.zeros((2, len(offsets) - 1), np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[0, some] = np.bitwise_xor.reduceat(np.where(second, np.uint64(0), bits), offsets[some])
        out[1, some] = np.bitwise_xor.reduceat(np.where(second, bits, np.uint64(0)), offsets[some])
    return out


def numbered_lines(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """A stored row for each line with words: its document and place, hash of its set, and what its posts need.

    ``lead``: no line of the set that the task has seen, of those it still remembers,
    stands before it; others need not be sent to find the first of all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # COUNTERS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        least: dict[bytes, tuple[int, int, int]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts, ids, ties, places = [], [], [], []
                for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    if doc is None or not t:
                        continue
                    raw = t.encode()
                    texts.append(raw.lower())
                    size = raw.count(b"\n") + 1
                    ids += [doc] * size
                    ties += [xxhash.xxh3_64_intdigest(raw) >> 1] * size
                    places += range(size)
                if not texts:
                    continue
                flat, offsets = tokens(b"\n".join(texts), levels)
                n = np.diff(offsets)
                some = np.flatnonzero(n)
                view = memoryview(flat.tobytes())
                hashes = [xxhash.xxh3_128_digest(view[8 * a : 8 * z]) for a, z in zip(offsets[some].tolist(), offsets[some + 1].tolist(), strict=True)]
                p = prefix_size(n)[some]
                starts = np.concatenate([[0], np.cumsum(p)])
                which = np.repeat(offsets[some], p) + np.arange(p.sum()) - np.repeat(starts[:-1], p)
                short = memoryview(((flat[which] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype("<u4").tobytes())
                prefixes = [bytes(short[4 * a : 4 * z]) for a, z in pairwise(starts.tolist())]
                columns = [np.array(x, np.int64)[some] for x in (ids, ties, places)]
                lead = []
                for h, order in zip(hashes, zip(*(c.tolist() for c in columns), strict=True), strict=True):
                    known = least.get(h)
                    if fresh := known is None or order < known:
                        least[h] = order
                    lead.append(fresh)
                if len(least) > REMEMBERED:
                    least.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32)), pa.array(hashes, pa.binary()), pa.array(n[some].astype(np.int32)), *(pa.array(x[some].view(np.int64)) for x in bitmaps(flat, offsets)), pa.array(prefixes, pa.binary()), pa.array(lead)],
                    names=["doc_id", "tie", "line", "set_hash", "n", "bits", "bits2", "prefix", "lead"],
                )

    return stored(map_batches(docs, ["doc_id", "text"], run, "doc_id bigint, tie bigint, line int, set_hash binary, n int, bits bigint, bits2 bigint, prefix binary, lead boolean"), "lines")


POST = np.dtype([("key", "<u4"), ("id", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("bits", "<u8"), ("bits2", "<u8")])


def posts_of(b: pa.RecordBatch) -> np.ndarray:
    """A post for each token of the prefixes of classes."""
    raw = [x or b"" for x in b.column("prefix").to_pylist()]
    size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    out = np.empty(int(size.sum()), POST)
    out["key"] = np.frombuffer(b"".join(raw), "<u4")
    for c in ("id", "n", "bits", "bits2"):
        values = b.column(c).to_numpy()
        out[c] = np.repeat(values.view(np.uint64) if c.startswith("bits") else values, size)
    out["pos"] = np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size)
    return out


def meet(posts: dict[str, np.ndarray], starts: np.ndarray, sizes: np.ndarray, blk: np.ndarray, across: np.ndarray) -> pa.RecordBatch | None:
    """Edges between the members of each group of posts that the filters let pass; ``across``: of groups of two blocks only pairs across count."""
    ids, n, pos, bits, bits2 = (posts[c] for c in ("id", "n", "pos", "bits", "bits2"))
    n, pos = n.astype(np.int64), pos.astype(np.int64)

    rest = n - pos

    def long_enough(x, y):
        """The filters of length and position: what both have left, if this is their first token in common, reaches the least overlap."""
        return np.minimum(rest[x], rest[y]) * (DEN + NUM) >= (n[x] + n[y]) * NUM

    def near(x, y):
        """The filter of bitmaps."""
        a, b = n[x], n[y]
        differ = np.bitwise_count(bits[x] ^ bits[y]).astype(np.int64) + np.bitwise_count(bits2[x] ^ bits2[y])
        return a + b - differ >= 2 * least_overlap(a, b)

    out: list[tuple[int, int]] = []
    place = np.arange(len(ids)) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - place
    at = np.flatnonzero(np.repeat(sizes <= 64, sizes))
    for d in range(1, 64):  # all pairs of small groups at once, by their distance
        at = at[left[at] > d]
        if not len(at):
            break
        x = at[long_enough(at, at + d)]  # few of all pairs
        x = x[near(x, x + d)]
        x = x[~across[x] | (blk[x] != blk[x + d])]
        out += list(zip(ids[x].tolist(), ids[x + d].tolist(), strict=True))
    for a, m in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        at, z = np.arange(a, a + m), a + m
        ok = np.empty((m, m), bool)
        for x in range(a, z, 64):  # a few rows at a time: what is compared takes many times the memory of the answer
            some = at[x - a : x - a + 64, None], at[None, :]
            ok[x - a : x - a + 64] = long_enough(*some) & near(*some)
        if across[a]:
            ok &= blk[at][:, None] != blk[at][None, :]
        out += edges_of(np.triu(ok, 1), ids[at])
    x = np.array(sorted({(min(p), max(p)) for p in out if p[0] != p[1]}), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"]) if len(x) else None


def candidates(classes: DataFrame) -> DataFrame:
    """Edges ``a, b`` whose components hold every pair of similar classes (``id, n, bits, bits2, prefix``).

    Posts travel packed in buckets of keys, which grow in number with the classes. A
    hot key is one that a sixteenth of the classes tells to be in more than two blocks'
    worth of them; its slot in a table of fixed size is marked, and keys of marked
    slots go as rows that are dealt out in blocks.
    """
    spark, block = classes.sparkSession, 2 * BLOCK

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = np.ascontiguousarray(posts_of(b)["key"])
            yield pa.RecordBatch.from_arrays([pa.array((key % np.uint32(SLOTS)).astype(np.int32)), pa.array(key.view(np.int32))], names=["slot", "key"])

    some = classes.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(16)) == 0)
    counts = map_batches(some, ["id", "n", "bits", "bits2", "prefix"], keys, "slot int, key int").groupBy("slot", "key").count()
    hot = np.zeros(SLOTS, bool)
    hot[[r["slot"] for r in counts.where(F.col("count") * 16 > block).select("slot").distinct().toLocalIterator()]] = True  # SLOTS at most
    marked = np.packbits(hot)  # SLOTS / 8 bytes
    n_buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), classes.count() * 10 // 100_000)

    def is_hot(key: np.ndarray) -> np.ndarray:
        return np.unpackbits(marked).view(bool)[key % np.uint32(SLOTS)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            posts = posts_of(b)
            posts = posts[~is_hot(posts["key"])]
            bucket = posts["key"] % np.uint32(n_buckets)
            order = np.argsort(bucket, kind="stable")
            posts, bucket = posts[order], bucket[order]
            if not len(posts):
                continue
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            raw = memoryview(posts.tobytes())
            packed = [bytes(raw[POST.itemsize * a : POST.itemsize * z]) for a, z in pairwise([*starts.tolist(), len(posts)])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "posts"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, sizes in each_group(batches, "bucket"):
            raw = table.column("posts").to_pylist()
            for a, m in zip(starts.tolist(), sizes.tolist(), strict=True):
                posts = np.frombuffer(b"".join(raw[a : a + m]), POST)
                key = np.ascontiguousarray(posts["key"])
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                size = np.diff(np.append(first, len(posts)))
                order, size = order[np.repeat(size > 1, size)], size[size > 1]
                if len(order):
                    none = np.zeros(len(order), np.int8)
                    if (found := meet({c: posts[c][order] for c in POST.names}, np.cumsum(size) - size, size, none, none.view(bool))) is not None:
                        yield found

    def hot_posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            posts = posts_of(b)
            posts = posts[is_hot(posts["key"])]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(posts[c]).view(np.dtype(t))) for c, t in (("key", "i4"), ("id", "i8"), ("n", "i4"), ("pos", "i4"), ("bits", "i8"), ("bits2", "i8"))], names=list(POST.names))

    def hot_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, sizes in each_group(batches, "key", least=50_000):
            blk, bi, bj = blocks_of(table)
            columns = {c: table.column(c).to_numpy() for c in POST.names}
            columns |= {c: columns[c].view(np.uint64) for c in ("bits", "bits2")}
            if (found := meet(columns, starts, sizes, blk, bi != bj)) is not None:
                yield found

    needed = ["id", "n", "bits", "bits2", "prefix"]
    packed = map_batches(classes, needed, deal, "bucket int, posts binary").repartition("bucket").sortWithinPartitions("bucket")
    edges = packed.mapInArrow(tidied(lambda batches: forest(pairs(batches))), "a bigint, b bigint")
    if hot.any():
        rows = map_batches(classes, needed, hot_posts, "key int, id bigint, n int, pos int, bits bigint, bits2 bigint")
        edges = edges.unionByName(grouped(in_blocks(rows, "key", block), "key").mapInArrow(tidied(lambda batches: forest(hot_pairs(batches))), "a bigint, b bigint"))
    return edges


def similar_classes(docs: DataFrame, members: DataFrame, levels: np.ndarray) -> DataFrame:
    """``id, links, earlier`` of classes with a similar one. ``members``: ``cluster, id, doc_id, tie, line`` (the first occurrence)."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                lines, rows = [], []
                for doc, t, wanted in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                    raw = t.encode() if t else b""
                    cut, tie = raw.lower().split(b"\n"), xxhash.xxh3_64_intdigest(raw) >> 1
                    for w in wanted:
                        if w["tie"] == tie:
                            lines.append(cut[w["line"]])
                            rows.append((w["cluster"], w["id"], doc, tie, w["line"]))
                if rows:
                    flat, offsets = tokens(b"\n".join(lines), levels)
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))], names=["cluster", "id", "doc_id", "tie", "line", "tokens"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, sizes in each_group(batches, "cluster"):
            ids, doc, tie, line = (table.column(c).to_numpy() for c in ("id", "doc_id", "tie", "line"))
            blk, bi, bj = blocks_of(table)
            lists = table.column("tokens").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            out: list[tuple[int, int, bool]] = []
            for a, m in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                ok = linked_pairs(values, offsets[a : a + m + 1], blk[a : a + m], bi[a] == bj[a], NUM, DEN)
                np.fill_diagonal(ok, False)
                rank = np.empty(m, np.int64)
                rank[np.lexsort((line[a : a + m], tie[a : a + m], doc[a : a + m]))] = np.arange(m)
                links = ok.sum(axis=1)
                earlier = (ok & (rank[None, :] < rank[:, None])).any(axis=1)
                out += [(int(ids[a + i]), int(links[i]), bool(earlier[i])) for i in np.flatnonzero(links)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out]) for k in range(3)], names=["id", "links", "earlier"])

    wanted = members.groupBy("doc_id").agg(F.collect_list(F.struct("cluster", "id", "tie", "line")).alias("wanted"))  # at most a document's lines
    lines = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "wanted").mapInArrow(tidied(fetch), "cluster bigint, id bigint, doc_id bigint, tie bigint, line int, tokens array<bigint>")
    found = grouped(in_blocks(stored(lines, "line-sets"), "cluster", BLOCK), "cluster").mapInArrow(tidied(verify), "id bigint, links bigint, earlier boolean")
    return found.groupBy("id").agg(F.sum("links").alias("links"), F.max("earlier").alias("earlier"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less the removed lines, ``n_lines``, ``n_removed`` and ``n_links`` (similar classes, summed over the lines)."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_removed", "n_links")
    names = docs.columns
    marked, doc_key = (next(n for n in (f"{c}{'_' * k}" for k in itertools.count()) if n not in names) for c in ("_marks", "_doc"))
    levels = word_levels(docs)
    # What is joined below grows with the documents: merge joins at every size, never a broadcast.
    lines = numbered_lines(docs, levels)
    first = F.min(F.struct("doc_id", "tie", "line", "n", "bits", "bits2", "prefix")).alias("f")
    classes = stored(lines.where("lead").drop("lead").repartition("set_hash").groupBy("set_hash").agg(first).select("set_hash", "f.*").withColumn("id", F.monotonically_increasing_id()), "line-classes")
    release(spark)
    clusters = components(candidates(classes))
    release(spark)
    members = classes.join(clusters, "id").select(F.col("component").alias("cluster"), "id", "doc_id", "tie", "line")
    links = stored(similar_classes(docs, members, levels), "line-links")
    discard(clusters)
    release(spark)
    known = classes.select("set_hash", "id", F.struct("doc_id", "tie", "line").alias("first")).join(links, "id", "left")
    verdicts = known.select("set_hash", "first", F.coalesce("earlier", F.lit(False)).alias("earlier"), F.coalesce("links", F.lit(0)).alias("links"))
    judged = lines.select("doc_id", "tie", "line", "set_hash").join(verdicts.hint("merge"), "set_hash")
    gone = judged.withColumn("gone", F.col("earlier") | (F.col("first") != F.struct("doc_id", "tie", "line"))).where("gone or links > 0")
    repeated = stored(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).count().where("count > 1").select("doc_id"), "repeated-ids")
    copied = None
    if not repeated.isEmpty():  # rows that repeat a document and its text come with as many rows for each line
        of_line = lines.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "tie", "line").count().where("count > 1")
        copied = of_line.select("doc_id", "tie").distinct().select("doc_id", "tie", F.array().cast("array<int>").alias("gone"), F.lit(0).cast("bigint").alias("links"), F.lit(True).alias("copied"))
        gone = gone.dropDuplicates(["doc_id", "tie", "line"])
    marks = gone.groupBy("doc_id", "tie").agg(F.collect_list(F.when(F.col("gone"), F.col("line"))).alias("gone"), F.sum("links").alias("links")).withColumn("copied", F.lit(False))
    marks = stored(marks.unionByName(copied) if copied is not None else marks, "line-marks")
    discard(lines, classes, links, repeated)
    release(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # of documents that are repeated as a whole
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            texts, n, removed, links = [], [], [], []
            for doc, t, marks in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column(marked).to_pylist(), strict=True):
                pieces = t.split("\n") if t else []
                drop, found = set(), 0
                tie = xxhash.xxh3_64_intdigest(t.encode()) >> 1 if t else 0
                for m in marks or ():
                    if m["tie"] == tie:
                        drop.update(m["gone"])
                        found += m["links"]
                        if m["copied"]:
                            if (doc, tie) in seen:
                                drop.update(i for i, p in enumerate(pieces) if p.strip(_BLANK))
                            seen.add((doc, tie))
                kept = [p for i, p in enumerate(pieces) if i not in drop]
                texts.append("\n".join(kept if any(p.strip() for p in kept) or not drop else []) if t is not None else None)
                n.append(len(pieces))
                removed.append(len(drop))
                links.append(found)
            columns = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(links, pa.int64())], names=[*names, "n_lines", "n_removed", "n_links"])

    by_doc = marks.groupBy("doc_id").agg(F.collect_list(F.struct("tie", "gone", "links", "copied")).alias(marked)).withColumnRenamed("doc_id", doc_key)
    joined = docs.join(by_doc.hint("merge"), docs["doc_id"] == by_doc[doc_key], "left").select(*(docs[c] for c in docs.columns), marked)
    head = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    return joined.mapInArrow(tidied(cut), f"{head}, n_lines bigint, n_removed bigint, n_links bigint")
