"""Operator 8: byte-level BPE encoding and decoding by two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a whole pre-token that is
itself a vocabulary entry gets its id from one probe. Tier two merges the bytes of
the other pre-tokens with a heap of candidate pairs over a doubly linked list.

Edge cases: a null text counts as empty (no ids, digests of nothing); rows keep
their multiplicity; a null ``doc_id`` is passed through; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from ._common import Memo, map_batches

#: White space by Unicode's property, as the pre-token pattern understands ``\s``.
_SPACES = "\t\x0b\x0c\r\x85\xa0                　"
_DOUBLES = ("  ", " \n", "\n ", "\n\n")
_MARKS = frozenset(".,;:!?")


def _pairs(ranks: dict[bytes, int]) -> dict[int, int]:
    """The id that two ids merge into, by both of them in one number."""
    out = {}
    for token, r in ranks.items():
        for k in range(1, len(token)):
            a, z = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and z is not None:
                out[a << 20 | z] = r
    return out


class PerfectHash:
    """Minimal perfect hash of byte strings by hash, displace and compress.

    Keys fall into buckets; each bucket, largest first, tries displacements until its
    keys land on free slots. ``get`` compares the stored key, so that a string outside
    the set is reported as absent.
    """

    def __init__(self, items: dict[bytes, int]):
        keys = list(items)
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // 3)
        self.seeds = np.zeros(self.buckets, dtype=np.int64)
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        groups: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for k in keys:
            h = xxhash.xxh3_64_intdigest(k)
            groups[h % self.buckets].append((h, k))
        for b in sorted(range(self.buckets), key=lambda i: -len(groups[i])):
            if not groups[b]:
                break
            seed = 0
            while True:
                slots = [self._slot(h, seed) for h, _ in groups[b]]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                seed += 1
            self.seeds[b] = seed
            for s, (_, k) in zip(slots, groups[b], strict=True):
                self.keys[s], self.values[s] = k, items[k]
        self.seeds = self.seeds.tolist()

    def _slot(self, h: int, seed: int) -> int:
        h = ((h >> 17) ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (h ^ (h >> 29)) % self.n

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        s = self._slot(h, self.seeds[h % self.buckets])
        return self.values[s] if self.keys[s] == key else None


class ByteBPE:
    """Encoder and decoder for a file of ranks (base64 token, rank) and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 250_000):
        self.ranks = ranks
        self.hash = PerfectHash(ranks)
        self.vocab = {i: t for t, i in ranks.items()}
        self.names = {i: str(i) for i in self.vocab}
        self.bytes = [ranks[bytes([c])] for c in range(256)]
        self.pairs = _pairs(ranks)
        self.pattern = regex.compile(pattern)
        self.words = Memo(lambda w: self.token(w.encode()), memo // 5)
        self.memo = Memo(self._piece, memo // 10)
        self.spaced = Memo(self._spaced, memo)

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}, pattern)

    def token(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.hash.get(word)
        return [whole] if whole is not None else self.merge(word)

    def merge(self, word: bytes) -> list[int]:
        """Pairs wait in a heap by rank, then place; the bytes' ids stand in a doubly linked list.

        An entry of the heap is one number, rank before place. ``now`` has the rank that
        the pair beginning at a place has at present, so that entries of pairs that have
        been merged away are told by it.
        """
        get, pop, push = self.pairs.get, heapq.heappop, heapq.heappush
        ids = [self.bytes[c] for c in word]
        n = len(ids)
        b = n.bit_length()
        low = (1 << b) - 1
        now = [get(x << 20 | y, -1) for x, y in pairwise(ids)]
        heap = [r << b | i for i, r in enumerate(now) if r >= 0]
        if not heap:
            return ids
        now.append(-1)
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            x = pop(heap)
            i, r = x & low, x >> b
            if now[i] != r:
                continue
            j = after[i]
            end = after[i] = after[j]
            ids[i], ids[j], now[j] = r, -1, -1
            if end < n:
                before[end] = i
                now[i] = q = get(r << 20 | ids[end], -1)
                if q >= 0:
                    push(heap, q << b | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                now[h] = q = get(ids[h] << 20 | r, -1)
                if q >= 0:
                    push(heap, q << b | h)
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a run of non-space with or without a space before it. Letters only are one pre-token."""
        if piece.isalpha():
            return tuple(self.token(piece.encode()))
        return tuple(chain.from_iterable(map(self.words.__getitem__, self.pattern.findall(piece))))

    def _spaced(self, run: str) -> tuple[int, ...]:
        """The same for a run after a space; a mark behind letters is a pre-token of its own."""
        if run.isalpha():
            return tuple(self.token(f" {run}".encode()))
        stem = run[:-1]
        if run[-1:] in _MARKS and stem.isalpha():
            return self.spaced[stem] + self.memo[run[-1]]
        return self._piece(f" {run}")

    def encode(self, text: str) -> list[int]:
        """Ids of a text. The pattern never joins two runs of non-space, so runs are cached with their one leading space."""
        if not text:
            return []
        if any(d in text for d in _DOUBLES) or text[0] in " \n" or text[-1] in " \n" or any(c in text for c in _SPACES):
            return list(chain.from_iterable(self.token(w.encode()) for w in self.pattern.findall(text)))
        first, rest, out = self.memo, self.spaced, []
        newline = first["\n"]
        for line in text.split("\n"):
            words = line.split(" ")
            out.extend(first[words[0]])
            out.extend(chain.from_iterable(map(rest.__getitem__, words[1:])))
            out.extend(newline)
        return out[: len(out) - len(newline)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBPE:
    """One codec for each worker process."""
    return ByteBPE.load(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, digests: bool = False, warm: bool = False) -> DataFrame:
    """Ids of every text, and the bytes decoded from them.

    Returns ``doc_id``, the columns in ``keep``, then ``ids array<int>`` and
    ``decoded binary``; with ``digests`` ``n_tokens``, ``ids_sha256`` and
    ``decoded_sha256`` in their place, made in the same pass so that ids need not
    leave the worker. ``warm``: workers keep their caches (about 150 MB) for their next
    tasks. Narrow: no shuffle.
    """
    keep = keep or []
    kinds = dict(docs.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in ["doc_id", *keep])
    schema = head + (", n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else ", ids array<int>, decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids = [bpe.encode(t or "") for t in b.column("text").to_pylist()]
                back = [bpe.decode(x) for x in ids]
                columns = [b.column(c) for c in ["doc_id", *keep]]
                names = ["doc_id", *keep]
                if digests:
                    name = bpe.names.__getitem__
                    columns += [
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(" ".join(map(name, x)).encode()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                    ]
                    names += ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if not warm:  # the worker may serve other operators next
            for memo in (bpe.words, bpe.memo, bpe.spaced):
                memo.forget()

    columns = list(dict.fromkeys(["doc_id", *keep, "text"]))
    return map_batches(docs, columns, run, schema)
