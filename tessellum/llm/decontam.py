"""Operator 10: benchmark passages in documents, up to a share of edits.

Texts and items are lower-cased and their white space becomes single spaces. Items are
cut into pieces of ``q`` characters, at least one more than the edits allowed: an edit
spoils one piece at most, so that of ``n`` pieces at least ``n - edits`` stand verbatim in
any passage that matches, on diagonals no further apart than the edits. Every place of a
text is looked up among the hashes of all pieces, however common they are, and every run
of that many hits is verified by the exact edit distance of the item to the substrings
there. What is found is therefore exact and complete, whatever else is in the benchmark;
no embedding or LSH, which would lose matches, stands before the verification (README
has figures of that).

Items of fewer than four words and fewer than 20 characters must occur exactly, between
spaces unless they are written in a script that sets none. The index of the items is
broadcast in groups of a bounded size; larger benchmarks take more scans.

Edge cases: null or blank texts and items match nothing; repeated documents or items
give rows each; of several matches of an item in one place the nearest is reported;
an empty table on either side gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_batches, tidied

_PIECE = 8  # longest piece, in characters
_SHORT = 20  # characters from which on an item of few words may be edited
_CHUNK = 1 << 20  # characters that are looked up at a time, unless a text is longer
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Index:
    """Items and the hashes of their pieces."""

    def __init__(self, items: list[tuple[int, str]], edits: float):
        self.items: list[tuple[int, int, str, int]] = []  # id, words, text, edits
        for item_id, text in items:
            words = (text or "").lower().split()
            if words:
                flat = " ".join(words)
                self.items.append((item_id, len(words), flat, int(len(flat) * edits) if len(words) > 3 or len(flat) >= _SHORT else 0))
        self.sizes = np.array([len(f) for _, _, f, _ in self.items], np.int64)
        self.most = np.array([k for *_, k in self.items], np.int64)
        self.longest = int(self.sizes.max(initial=1))
        piece = np.ones(len(self.items), np.int64)
        for q in range(2, _PIECE + 1):
            piece[self.sizes // q > self.most] = q
        self.need = np.maximum(1, self.sizes // piece - self.most)
        codes = _codes("".join(f for _, _, f, _ in self.items))
        first = np.cumsum(self.sizes) - self.sizes
        #: For each length: hashes in order with the item and the place of the piece, and the hashes' leading bits as a bitmap.
        self.tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.uint64, np.ndarray]] = []
        for q in np.unique(piece).tolist():
            some = np.flatnonzero(piece == q)
            n = self.sizes[some] // q
            item = np.repeat(some, n)
            at = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * q
            keys = _hashes(codes, q)[first[item] + at]
            order = np.argsort(keys, kind="stable")
            bits = max(16, int(16 * len(keys)).bit_length())
            shift = np.uint64(64 - bits)
            seen = np.zeros(1 << bits, bool)
            seen[keys >> shift] = True
            self.tables.append((q, keys[order], item[order], at[order], shift, seen))

    def candidates(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``item, text, diagonal`` where enough pieces of an item occur; ``starts``: of the texts among ``codes``. A diagonal is the place at which the item would begin without insertions or deletions."""
        width, found = len(codes) + self.longest + 1, []
        for q, keys, item, at, shift, seen in self.tables:
            if len(codes) < q:
                continue
            h = _hashes(codes, q)
            where = np.flatnonzero(seen[h >> shift])
            lo, hi = (np.searchsorted(keys, h[where], side=side) for side in ("left", "right"))
            counts = hi - lo
            which = np.repeat(lo, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            text = np.repeat(np.searchsorted(starts, where, side="right") - 1, counts)
            found.append((item[which] * len(starts) + text) * width + np.repeat(where, counts) - at[which] + self.longest)
        keys = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        item = keys // (width * len(starts))
        last = np.arange(len(keys)) + self.need[item] - 1
        ok = last < len(keys)
        ok[ok] = keys[last[ok]] - keys[ok] <= self.most[item[ok]]
        keys, item = keys[ok], item[ok]
        return item, keys // width % len(starts), keys % width - self.longest

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """Matches of each text: item id, first and last word, edits."""
        flats = [" ".join(t.lower().split()) if t else "" for t in texts]
        out: list[list[tuple[int, int, int, int]]] = []
        at = 0
        while at < len(flats):
            end, size = at + 1, len(flats[at])
            while end < len(flats) and size + len(flats[end]) < _CHUNK:
                size += len(flats[end]) + 1
                end += 1
            out += self._search(flats[at:end])
            at = end
        return out

    def _search(self, flats: list[str]) -> list[list[tuple[int, int, int, int]]]:
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in flats]
        ends = np.cumsum([len(f) + 1 for f in flats])
        starts = ends - [len(f) + 1 for f in flats]
        items, docs, diagonals = self.candidates(_codes("\n".join(flats) + "\n"), starts)
        if not len(items):
            return out
        diagonals = diagonals - starts[docs]
        new = np.concatenate([[True], (items[1:] != items[:-1]) | (docs[1:] != docs[:-1]) | (np.diff(diagonals) > self.most[items[1:]])])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(items)) - 1
        best: dict[tuple[int, int, int], tuple[int, int, int]] = {}
        for i, d, lo, hi in zip(items[first].tolist(), docs[first].tolist(), diagonals[first].tolist(), diagonals[last].tolist(), strict=True):
            item_id, _, text, most = self.items[i]
            flat, a = flats[d], max(0, lo - most)
            for edits, start, end in _places(text, flat[a : max(0, hi) + len(text) + most], most):
                start, end = a + start, a + end
                if not most and not ((start == 0 or flat[start - 1] == " " or _unspaced(text[0])) and (end == len(flat) or flat[end] == " " or _unspaced(text[-1]))):
                    continue
                w0, w1 = flat.count(" ", 0, start), flat.count(" ", 0, max(start, end - 1))
                key = (d, i, w0)
                if key not in best or edits < best[key][0]:
                    best[key] = (edits, w1, item_id)
        for (d, i, w0), (edits, w1, item_id) in sorted(best.items()):
            rows = out[d]
            if rows and rows[-1][0] == item_id and rows[-1][1] + self.items[i][1] // 2 > w0:  # the same place again
                if rows[-1][3] > edits:
                    rows[-1] = (item_id, w0, w1, edits)
            else:
                rows.append((item_id, w0, w1, edits))
        return out


def _unspaced(c: str) -> bool:
    """Whether words of the letter's script stand without spaces: from Thai on, letters without case but for Hangul."""
    return c >= "\u0e00" and unicodedata.category(c) == "Lo" and not "\uac00" <= c <= "\ud7a3"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


def _hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the ``q`` characters from every place on."""
    n = max(0, len(codes) - q + 1)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h *= _BASE
        h += codes[j : j + n]
    return h * _BASE


def _scores(pattern: str, text: str, anchored: bool = False) -> Iterator[int]:
    """Least edits of ``pattern`` against the substrings (``anchored``: the prefix) of ``text`` that end after each character (bit-parallel columns)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1 | anchored) & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        yield score


def _ends(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edits of ``pattern`` against a substring (``anchored``: a prefix) of ``text``, and the last end at which they occur."""
    best, end = len(pattern), 0
    for j, score in enumerate(_scores(pattern, text, anchored), 1):
        if score <= best:
            best, end = score, j
    return best, end


def _places(pattern: str, text: str, most: int) -> list[tuple[int, int, int]]:
    """Edits, start and end of the substrings within ``most`` edits of ``pattern``; of ends less than half of it apart the nearest."""
    found: list[list[int]] = []
    for j, score in enumerate(_scores(pattern, text), 1):
        if score > most:
            continue
        if not found or j - found[-1][0] > len(pattern) // 2:
            found.append([j, score, j])
        elif score <= found[-1][1]:
            found[-1][1:] = [score, j]
    out = []
    for _, edits, end in found:
        _, size = _ends(pattern[::-1], text[max(0, end - len(pattern) - edits) : end][::-1], anchored=True)
        out.append((edits, end - size, end))
    return out


def nearest(pattern: str, text: str) -> tuple[int, int, int]:
    """Edits, start and end of the substring of ``text`` nearest to ``pattern``."""
    edits, end = _ends(pattern, text)
    _, size = _ends(pattern[::-1], text[:end][::-1], anchored=True)
    return edits, end - size, end


def groups(benchmark: DataFrame, bound: int = 8_000_000) -> Iterator[list[tuple[int, str]]]:
    """Items in groups of at most ``bound`` characters (an item longer than that is a group of its own): what is broadcast at a time."""
    rows = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    held: list[tuple[int, str]] = []
    size = 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if held and size + len(r["text"]) > bound:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, edits: float = 0.1) -> DataFrame:
    """``doc_id, item_id, start, end, edits`` of every occurrence; places are characters of the text. Narrow for each group of items."""
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, start int, end int, edits int"

    def scan(items: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, edits)
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    texts, rows = b.column("text").to_pylist(), []
                    for doc, text, found in zip(b.column("doc_id").to_pylist(), texts, index.search(texts), strict=True):
                        if found:
                            spans = [m.span() for m in re.finditer(r"\S+", text)]
                            rows += [(doc, item, spans[a][0], spans[z][1], e) for item, a, z, e in found]
                    if rows:
                        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "start", "end", "edits"])

        return map_batches(docs, ["doc_id", "text"], run, schema)

    parts = [scan(g) for g in groups(benchmark)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def without_matches(docs: DataFrame, benchmark: DataFrame, edits: float = 0.1) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; same columns. Narrow: each group of items filters what the one before left."""
    columns, schema = docs.columns, docs.schema

    def keep(frame: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, edits)
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    clean = pa.array([not m for m in index.search(b.column("text").to_pylist())], pa.bool_())
                    yield b.filter(clean)

        return frame.select(*columns).mapInArrow(tidied(run), schema)

    return reduce(keep, groups(benchmark), docs)
