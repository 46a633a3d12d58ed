"""Operator 6: token ids in wavelet-matrix shards.

Documents are range-partitioned by ``doc_id`` and each task cuts its sorted share
into shards. A shard is one self-contained file image: for every bit of an id, from
the highest, a compressed bit-plane with rank samples, each plane's bits standing in
the order that a stable sort by the bits before it leaves. That supports access,
counting and occurrence lookup without decoding the ids. Spark's own committer
stores the images (one row each), so retried or speculative tasks leave one copy and
any file system will do; ``WaveletMatrix.save`` writes an image as a plain file.

Edge cases: a null text is empty and yields the end id alone; repeated ``doc_id``
rows are kept next to each other, ordered by their text; null ids come first; an
empty table yields no shards and no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Memo, shared_dir, tidied

_MAGIC = b"WMX1"
_BLOCK = 4096  # bits between two rank samples
#: Marks that never join the letters before them; an apostrophe might.
_ASCII_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Python takes these for white space and Unicode doesn't, or versions of Unicode differ on them.
_ODD_SPACES = "\x1c\x1d\x1e\x1f᠎"


class WaveletMatrix:
    """Bit-planes of a sequence of ids below ``2 ** bits``."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[np.ndarray], samples: list[np.ndarray], doc_ids: np.ndarray, lengths: np.ndarray):
        self.n, self.bits, self.zeros, self.planes, self.samples = n, bits, zeros, planes, samples
        self.doc_ids, self.lengths = doc_ids, lengths

    @classmethod
    def build(cls, ids: np.ndarray, bits: int, doc_ids: np.ndarray | None = None, lengths: np.ndarray | None = None) -> WaveletMatrix:
        n, seq = len(ids), np.asarray(ids, dtype=np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, samples = [], [], []
        for level in range(bits - 1, -1, -1):
            ones = (seq & seq.dtype.type(1 << level)) != 0
            packed = np.packbits(ones, bitorder="little")
            planes.append(packed)
            samples.append(cls._sample(packed))
            low, high = seq.take(np.flatnonzero(~ones)), seq.take(np.flatnonzero(ones))  # places, not masks: bits like a coin's cost a mask four times as much
            zeros.append(len(low))
            seq = np.concatenate([low, high])
        doc_ids = np.zeros(0, np.int64) if doc_ids is None else np.asarray(doc_ids, np.int64)
        lengths = np.zeros(0, np.int64) if lengths is None else np.asarray(lengths, np.int64)
        return cls(n, bits, zeros, planes, samples, doc_ids, lengths)

    @staticmethod
    def _sample(packed: np.ndarray) -> np.ndarray:
        """Ones before each block."""
        step = _BLOCK // 8
        counts = np.add.reduceat(np.bitwise_count(packed).astype(np.uint64), np.arange(0, len(packed), step)) if len(packed) else np.zeros(0, np.uint64)
        return np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)

    # -- file image

    def to_bytes(self) -> bytes:
        press = zstandard.ZstdCompressor(level=1).compress
        parts = [press(self.doc_ids.astype("<i8").tobytes()), press(self.lengths.astype("<i8").tobytes())]
        for packed, sample in zip(self.planes, self.samples, strict=True):
            parts += [press(packed.tobytes()), press(sample.astype("<u8").tobytes())]
        head = _MAGIC + struct.pack("<QBQ", self.n, self.bits, len(self.doc_ids)) + struct.pack(f"<{self.bits}Q", *self.zeros)
        return head + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, image: bytes) -> WaveletMatrix:
        if image[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix image")
        n, bits, docs = struct.unpack_from("<QBQ", image, 4)
        at = 4 + struct.calcsize("<QBQ")
        zeros = list(struct.unpack_from(f"<{bits}Q", image, at))
        at += 8 * bits
        sizes = struct.unpack_from(f"<{2 + 2 * bits}Q", image, at)
        at += 8 * len(sizes)
        open_, parts = zstandard.ZstdDecompressor().decompress, []
        view = memoryview(image)
        for s in sizes:
            parts.append(open_(view[at : at + s]))
            at += s
        planes = [np.frombuffer(p, np.uint8) for p in parts[2::2]]
        samples = [np.frombuffer(p, "<u8") for p in parts[3::2]]
        return cls(n, bits, zeros, planes, samples, np.frombuffer(parts[0], "<i8", docs), np.frombuffer(parts[1], "<i8", docs))

    def save(self, path: str) -> None:
        """Atomic: written beside ``path`` and renamed."""
        with open(f"{path}.{os.getpid()}.tmp", "wb") as f:
            f.write(self.to_bytes())
        os.replace(f.name, path)

    @classmethod
    def load(cls, path: str) -> WaveletMatrix:
        with open(path, "rb") as f:
            return cls.from_bytes(f.read())

    # -- queries

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        packed, block = self.planes[level], i // _BLOCK
        first = block * (_BLOCK // 8)
        total = int(self.samples[level][block]) + int(np.bitwise_count(packed[first : i // 8]).sum())
        return total + (int(packed[i // 8] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = int(self.planes[level][i // 8]) >> (i & 7) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _interval(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``token`` in ``[lo, hi)``."""
        a, b = self._interval(token, lo, self.n if hi is None else hi)
        return b - a

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) bit of that value in a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, token: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of ``token``."""
        lo, hi = self._interval(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, in order: the planes' sorts undone from the last."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        value = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~ones)] = value[: self.zeros[level]]
            above[np.flatnonzero(ones)] = value[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            value = above
        return value


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordEncoder:
    """The tokenizers library behind a cache of runs of non-space, whose encodings are independent of each other.

    A worker keeps the cache from task to task; ``memo`` bounds it to twice as many runs (about 150 MB).

    A lower-case word of letters alone, which normalisation and pre-tokenisation leave
    as it is, goes straight to the library's model; any other run takes the whole way.
    """

    def __init__(self, path: str, memo: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.bits = max(1, int(self.library.get_vocab_size() - 1).bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        code = "H" if self.bits <= 16 else "I"
        self.pack = lambda ids: struct.pack(f"<{len(ids)}{code}", *ids)
        self.memo = Memo(self._run, memo)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _run(self, run: str) -> bytes:
        """Ids of a run of non-space; ASCII marks after letters are a pre-token of their own, and ASCII letters lower their case alone."""
        stem = run if run.isalpha() else run.rstrip(_ASCII_MARKS)
        if not stem.isalpha():
            return self._whole(run)
        low = stem.lower() if stem.isascii() else stem
        if len(stem) < len(run):
            return self.memo[low] + self.memo[run[len(stem) :]]
        if low != run:
            return self.memo[low]
        if run.isascii():
            pieces = self.model.tokenize(run)
        elif run.islower() and run == run.lower() and unicodedata.is_normalized("NFC", run):
            pieces = self.model.tokenize("".join(map(self.letters.__getitem__, run.encode())))
        else:
            return self._whole(run)
        return self.pack([p.id for p in pieces])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        look, out = self.memo.__getitem__, []
        for t in texts:
            if t and (any(s in t for s in self.special) or any(c in t for c in _ODD_SPACES)):
                out.append(self._whole(t))
            else:
                out.append(b"".join(map(look, t.split())) if t else b"")
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


SHARDS = "part int, seq int, before bigint, n_tokens bigint, image binary"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, shard_tokens: int = 500_000) -> str:
    """Encodes every text, writes the shards to the shared folder and returns their path.

    ``before``: ids of the same partition in front of the shard. One shuffle, of the
    texts by range of ``doc_id``; a shard closes at the document that fills it, so
    that a document lies in one shard whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.asarray([end_id], enc.kind).tobytes()
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        ids: list[int] = []
        sizes: list[int] = []
        size = 0

        def shard() -> pa.RecordBatch:
            nonlocal seq, before, held, ids, sizes, size
            tokens = np.frombuffer(b"".join(held), enc.kind)
            image = WaveletMatrix.build(tokens, enc.bits, np.asarray(ids, np.int64), np.asarray(sizes, np.int64)).to_bytes()
            row = [[part], [seq], [before], [len(tokens)], [image]]
            seq, before = seq + 1, before + len(tokens)
            held, ids, sizes, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "seq", "before", "n_tokens", "image"])

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                for doc, packed in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                    held += [packed, end]
                    ids.append(_NULL_ID if doc is None else doc)
                    n = len(packed) // enc.kind.itemsize + 1
                    sizes.append(n)
                    size += n
                    if size >= shard_tokens:
                        yield shard()
        if ids:
            yield shard()

    # The beginning of the text parts rows that share an id, or have none, without changing their order.
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    path = shared_dir(docs.sparkSession, "token-shards")
    dealt.mapInArrow(tidied(run), SHARDS).write.option("compression", "uncompressed").parquet(path)
    return path


_NULL_ID = -(2**63)


def read_shards(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the shards alone.

    Only one total for each partition of the write goes to the driver.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    offsets, total = {}, 0
    for r in sorted(shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        offsets[r["part"]], total = total, total + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, image in zip(b.column("part").to_pylist(), b.column("before").to_pylist(), b.column("image"), strict=True):
                wm = WaveletMatrix.from_bytes(image.as_py())
                ids = wm.decode()
                ends = np.cumsum(wm.lengths)
                starts = ends - wm.lengths
                wide = memoryview(ids.astype("<u4")).cast("B") if len(ids) else memoryview(b"")
                crc = [zlib.crc32(wide[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wm.doc_ids, pa.int64(), mask=wm.doc_ids == _NULL_ID), pa.array(starts + (offsets[part] + before)), pa.array(wm.lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.select("part", "before", "image").mapInArrow(tidied(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
