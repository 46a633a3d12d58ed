"""Hashes of all words of a text at once, without a Python object for any of them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SEGMENT = 1 << 19
_BASE = 0x5851F42D4C957F2D
_CODES = np.random.default_rng(17).integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _fixed_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(SEGMENT)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def _segment(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(buf)
    up, down = _fixed_powers() if n <= SEGMENT else _powers(n)
    word = np.zeros(n + 2, bool)
    word[1:-1] = (buf != 32) & ((buf < 9) | (buf > 13))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    v = _CODES[buf]
    v *= up[:n]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(v, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and byte offsets of the runs without space and \\t to \\r.

    A polynomial over random codes of the bytes: sums of code times power, taken over
    all bytes at once, less what precedes a word and times the inverse power of its
    place. Work is cut at white space into segments, so that memory is bounded unless a
    single word is longer than one.
    """
    if len(raw) <= SEGMENT:
        return _segment(np.frombuffer(raw, np.uint8))
    buf, at, hashes, starts = np.frombuffer(raw, np.uint8), 0, [], []
    while at < len(raw):
        end = min(at + SEGMENT, len(raw))
        if end < len(raw):
            spaces = np.flatnonzero(_SPACE[buf[at:end]])
            while not len(spaces) and end < len(raw):  # a very long word
                a, end = end, min(end + SEGMENT, len(raw))
                spaces = np.flatnonzero(_SPACE[buf[a:end]]) + (a - at)
            end = at + int(spaces[-1]) + 1 if len(spaces) else end
        h, s = _segment(buf[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, their offsets in the texts joined by line ends, and the number of words of each text."""
    h, starts = word_hashes(b"\n".join(texts))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    upto = np.searchsorted(starts, ends)
    return h, starts, np.diff(upto, prepend=0)
