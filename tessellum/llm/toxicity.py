"""Operator 7: toxicity of texts restored from obfuscation by a noisy channel.

A chunk that may hide a word (digits or signs among letters, letters repeated three
times or more, letters set apart) becomes a lattice of the characters that could
stand behind it; Viterbi decoding under a character trigram model picks the likeliest
spelling. Trigrams and known words are those of all documents that may be learned from,
counted in one pass over them. Restored words give evidence: the log odds, shrunk towards none, that a
labelled text with that word, or with a word that begins alike, is toxic. A logistic
model turns a text's strongest evidence into a score. ``learn`` takes every labelled row:
tasks count, and sum what the steps of Newton's method need.

Edge cases: a null or empty text gets the score of a text without evidence; repeated
rows score alike; without labelled rows of both classes every score is 0, and so it is
where none is left for the logistic model; an empty
table gives no rows; labels with null fields never train; extra columns are ignored.
Signs alone count as a word only if they spell one that the labelled texts hold.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Memo, discard, map_batches, stored

_LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
_STRIP = "\"'`.,;:?()[]{}<>«»“”‘’…-_*#~=/\\&%^"
_REPEAT = regex.compile(r"(\p{L})\1\1")
_THRICE = re.compile(r"(.)\1\1")  # tells the same of letters alone, sooner
_APART = regex.compile(r"^(?:[\p{L}\d@$!|+][.\-_*~]+){2,}[\p{L}\d@$!|+]$")
_MARKS = regex.compile(r"[.\-_*~]+")
_WORDS = regex.compile(r"\p{L}+")
PREFIXES = (4, 5, 6, 7)
#: Texts' worth of no evidence that each unit starts with.
SHRINK = 10.0
#: Evidence that no feature reads unless it is greater.
LEAST = 0.5
#: Occurrences of the rarest known words.
KNOWN = 3
#: Letters of the longest word that is put together from letters set apart.
LONGEST = 24


def _key(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) >> 1


class Hashed:
    """Numbers by 63 bits of the hash of a string, in 16 bytes each; ``keys`` ascend. ``marks``: slots of keys, four to eight a key, which tell most strings that have no number."""

    def __init__(self, keys: array, values: array):
        self.keys, self.values = keys, values
        self.mask = (1 << (4 * len(keys)).bit_length()) - 1
        marks = np.zeros(self.mask + 1, np.uint8)
        marks[np.frombuffer(keys, np.int64) & self.mask] = 1
        self.marks = marks.tobytes()

    def __reduce__(self):
        return Hashed, (self.keys, self.values)

    @classmethod
    def gather(cls, df: DataFrame) -> Hashed:
        """From ``key, value``: sorted and packed by the tasks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                packed = [pa.array([b.column(c).to_numpy().astype(t).tobytes()], pa.binary()) for c, t in (("key", "=i8"), ("value", "=f8"))]
                yield pa.RecordBatch.from_arrays(packed, names=["keys", "numbers"])

        keys, values = array("q"), array("d")
        for r in map_batches(df.orderBy("key"), ["key", "value"], run, "keys binary, numbers binary").toLocalIterator():
            keys.frombytes(r["keys"])
            values.frombytes(r["numbers"])
        return cls(keys, values)

    def get(self, s: str, default: float | None = None) -> float | None:
        k = xxhash.xxh3_64_intdigest(s) >> 1
        if not self.marks[k & self.mask]:
            return default
        i = bisect_left(self.keys, k)
        return self.values[i] if i < len(self.keys) and self.keys[i] == k else default

    def __contains__(self, s: str) -> bool:
        return self.get(s) is not None


class CharModel:
    """Interpolated character trigrams of words (``^^`` before and ``$`` after each), and the frequencies of known words, by counts or as logs."""

    def __init__(self, trigrams: dict[str, int], words: dict[str, int] | Hashed):
        self.tri = dict(trigrams)
        self.bi: Counter[str] = Counter()
        self.uni: Counter[str] = Counter()
        self.tri_of: Counter[str] = Counter()
        self.bi_of: Counter[str] = Counter()
        for t, n in self.tri.items():
            self.tri_of[t[:2]] += n
            self.bi[t[1:]] += n
            self.bi_of[t[1]] += n
            self.uni[t[2]] += n
        self.total = sum(self.uni.values()) + 1.0
        if not isinstance(words, Hashed):
            n = sum(words.values()) + 1.0
            words = {w: math.log(k / n) for w, k in words.items() if k >= KNOWN}
        self.words = words
        self.logs = Memo(self._log, 100_000)

    def log(self, before: str, c: str) -> float:
        return self.logs[before + c]

    def _log(self, trigram: str) -> float:
        before, c = trigram[:2], trigram[2]
        p = 0.01 * (self.uni[c] + 0.01) / self.total
        if n := self.bi_of[before[1]]:
            p += 0.24 * self.bi[before[1] + c] / n
        if n := self.tri_of[before]:
            p += 0.75 * self.tri.get(trigram, 0) / n
        return math.log(p)

    def word(self, word: str) -> float:
        """Log probability: the frequency of a known word, else by its characters, as rarer than any known one."""
        if (known := self.words.get(word)) is not None:
            return known
        p = f"^^{word}$"
        return sum([self.logs[p[i : i + 3]] for i in range(len(p) - 2)]) - 8.0

    def decode(self, lattice: list[list[str]]) -> str:
        """The likeliest path through alternatives, each of which is a string of one or more characters."""
        logs = self.logs
        states: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
        for options in lattice:
            after: dict[str, tuple[float, str]] = {}
            for last, (score, text) in states.items():
                for option in options:
                    s, b = score, last
                    for c in option:
                        b += c
                        s += logs[b]
                        b = b[1:]
                    if b not in after or s > after[b][0]:
                        after[b] = (s, text + option)
            states = after
        return max((s + self.log(last, "$"), text) for last, (s, text) in states.items())[1]


@dataclass
class Model:
    chars: CharModel
    evidence: dict[str, float] | Hashed
    weights: np.ndarray  # of the features, then the constant; empty: never trained

    def restore(self, chunk: str) -> list[str]:
        """Words behind one lower-case run of non-space."""
        core = chunk.strip(_STRIP)
        if core.isalpha() and not _THRICE.search(core):
            return [core]
        if _APART.match(core):
            return self.join(list(_MARKS.sub("", core)))
        if 2 < len(core) < 25 and all(c in _LEET for c in core):  # signs alone are a number, unless they spell a word that is known
            word = self.chars.decode([list(_LEET[c]) for c in core])
            return [word] if word in self.chars.words else []
        if core and not core.isalpha() and any(c.isalpha() for c in core) and any(c in _LEET for c in core):
            ends = {core, core.lstrip("!|+"), core.rstrip("!|+"), core.strip("!|+")} - {""}  # signs at an end are letters or punctuation
            found = [x if x.isalpha() else self.chars.decode([list(_LEET[c]) if c in _LEET else [c] for c in x]) for x in sorted(ends)]
            core = max(found, key=self.chars.word)
        out = []
        for w in _WORDS.findall(core):
            if _REPEAT.search(w):
                runs = regex.findall(r"(.)(\1*)", w)
                w = self.chars.decode([[a, a * 2] if len(b) > 1 else [a + b] for a, b in runs])
            out.append(w)
        return out

    def join(self, letters: list[str]) -> list[str]:
        """Letters set apart: the likeliest cut into words, each letter by the lattice of its own."""
        n = len(letters)
        best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(-math.inf, 0, "")] * n  # score, where the last word begins, that word
        for j in range(1, n + 1):
            for i in range(max(0, j - LONGEST), j):
                w = self.chars.decode([list(_LEET.get(c, c)) for c in letters[i:j]])
                s = best[i][0] + self.chars.word(w)
                if s > best[j][0]:
                    best[j] = (s, i, w)
        out: list[str] = []
        while n:
            _, n, w = best[n]
            out.append(w)
        return out[::-1]


def _units(word: str) -> list[str]:
    return [f"{word}$", *(word[:k] for k in PREFIXES if len(word) >= k)]


class Scorer:
    """Scores texts; the evidence of runs of non-space is cached, and that of the beginnings of their words."""

    def __init__(self, model: Model, memo: int = 300_000):
        self.model = model
        self.known = Memo(self._chunk, memo)
        self.begins = Memo(self._begin, memo // 2)

    def _begin(self, begin: str) -> float:
        return max(map(self.model.evidence.get, [begin[:k] for k in PREFIXES if len(begin) >= k], repeat(0.0)))

    def of_word(self, word: str) -> float:
        whole = self.model.evidence.get(f"{word}$", 0.0)
        return whole if len(word) < PREFIXES[0] else max(whole, self.begins[word[: PREFIXES[-1]]])

    def _chunk(self, chunk: str) -> float:
        """The greatest evidence of a chunk's words, with the sign of minus where it is one letter."""
        core = chunk.strip(_STRIP)
        if core.isalpha() and not _THRICE.search(core):
            value = self.of_word(core)
        else:
            value = max(map(self.of_word, self.model.restore(chunk)), default=0.0)
        return -value if len(core) == 1 and (core.isalpha() or core in _LEET) else value

    def features(self, text: str | None) -> np.ndarray:
        chunks = text.lower().split() if text else []
        if not chunks:
            return np.zeros(3)
        values = np.fromiter(map(self.known.__getitem__, chunks), np.float64, len(chunks))
        alone = np.signbit(values)
        values = np.abs(values)
        if alone.sum() > 2:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], alone.view(np.int8), [0]])))
            for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if z - a > 2:
                    words = self.model.join([c.strip(_STRIP) for c in chunks[a:z]])
                    values = np.append(values, [self.of_word(w) for w in words])
        values = values[values > LEAST]
        top = np.sort(np.append(values, [0.0, 0.0]))[::-1]
        return np.array([top[0], top[1], math.log1p(float(np.count_nonzero(values > 2.0)))])

    def score(self, text: str | None) -> float:
        w = self.model.weights
        return 0.0 if not len(w) else float(1 / (1 + math.exp(-max(-500.0, min(500.0, float(self.features(text) @ w[:3] + w[3]))))))


_kept: list[Scorer] = []


def _scorer(model: Model) -> Scorer:
    """A worker keeps the scorer, and with it the chunks that it knows, from task to task."""
    if not _kept or _kept[0].model is not model:
        _kept[:] = [Scorer(model)]
    return _kept[0]


def sample(docs: DataFrame, labels: DataFrame, bound: int, seed: int = 11) -> tuple[list[str], list[int]]:
    """Whole texts and classes of about ``bound`` labelled rows, chosen by a hash of the id: what the driver gets never grows with the table."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    share = math.ceil(1e6 * min(1.0, bound / n)) if n else 0
    chosen = marked.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_000)) < share)
    rows = sorted((r["doc_id"], r["text"] or "", int(r["toxic"])) for r in docs.select("doc_id", "text").join(chosen, "doc_id").toLocalIterator())
    return [t for _, t, _ in rows], [y for _, _, y in rows]


def _trigrams(words: dict[str, int]) -> Counter[str]:
    """Counts of the trigrams of words that occur so often."""
    flat = np.frombuffer("".join(f"^^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(flat):
        return Counter()
    n = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.fromiter((len(w) + 3 for w in words), np.int64, len(words)))
    codes = flat[:-2] << np.uint64(42) | flat[1:-1] << np.uint64(21) | flat[2:]
    ends = np.cumsum(np.fromiter((len(w) + 3 for w in words), np.int64, len(words)))
    inside = np.ones(len(codes), bool)
    inside[(ends[:-1, None] - [2, 1]).ravel()] = False  # over the border of two words
    keys, at = np.unique(codes[inside], return_inverse=True)
    sums = np.bincount(at, weights=n[2:][inside]).astype(np.int64)
    mask = (1 << 21) - 1
    return Counter({chr(k >> 42) + chr(k >> 21 & mask) + chr(k & mask): c for k, c in zip(keys.tolist(), sums.tolist(), strict=True)})


def _counted(docs: DataFrame) -> DataFrame:
    """A stored row for each character trigram (``gram``) and for each word (``key``) of all texts, with its count ``n``.

    Tasks send a row for each of their trigrams, and one for each word whenever those that they hold become many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: Counter[str] = Counter()
        sums: Counter[str] = Counter()

        def rows(grams: list[str] | None, keys: list[int] | None, n: list[int]) -> pa.RecordBatch:
            columns = [pa.nulls(len(n), pa.string()) if grams is None else pa.array(grams, pa.string()), pa.nulls(len(n), pa.int64()) if keys is None else pa.array(keys, pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=["gram", "key", "n"])

        def fold() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for chunk, n in chunks.items():
                for w in (chunk,) if chunk.isalpha() else _WORDS.findall(chunk):
                    words[w] += n
            chunks.clear()
            sums.update(_trigrams(words))
            return rows(None, list(map(_key, words)), list(words.values()))

        for b in batches:
            for t in b.column("text"):
                if t.is_valid:
                    chunks.update(t.as_py().lower().split())
                    if len(chunks) > 200_000:
                        yield fold()
        yield fold()
        yield rows(list(sums), None, list(sums.values()))

    return stored(map_batches(docs, ["text"], run, "gram string, key bigint, n bigint").groupBy("gram", "key").agg(F.sum("n").alias("n")), "language")


def _grams_of(sums: DataFrame, least: float = 0.0) -> dict[str, int]:
    grams = sums.where("gram is not null")
    total = grams.agg(F.sum("n")).first()[0] or 0
    return {r["gram"]: r["n"] for r in grams.where(F.col("n") >= least * total).toLocalIterator()}


def trigrams(docs: DataFrame, least: float = 0.0) -> dict[str, int]:
    """Counts of the character trigrams of all words of all texts, less those rarer than ``least`` of all."""
    sums = _counted(docs)
    found = _grams_of(sums, least)
    discard(sums)
    return found


def language(docs: DataFrame) -> CharModel:
    """Every trigram and every known word of all texts. The driver gets a row a trigram, whose number the alphabets bound, and 16 bytes a known word."""
    sums = _counted(docs)
    words = sums.where("key is not null")
    total = (words.agg(F.sum("n")).first()[0] or 0) + 1.0
    known = Hashed.gather(words.where(F.col("n") >= KNOWN).select("key", F.log(F.col("n") / total).alias("value")))
    model = CharModel(_grams_of(sums), known)
    discard(sums)
    return model


#: Keys of the units of a chunk's words; a worker keeps them from task to task.
_units_of = Memo(lambda chunk: tuple({_key(u) for w in ((chunk,) if chunk.isalpha() else _WORDS.findall(chunk)) for u in _units(w)}), 100_000)


def _unit_counts(labelled: DataFrame) -> DataFrame:
    """A stored row for each unit (``key``) of the words of ``text``, with the texts of each class that hold it; the row without a key counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: tuple[Counter[int], Counter[int]] = (Counter(), Counter())
        n = [0, 0]

        def rows(keys: list[int | None], clean: list[int], toxic: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, clean, toxic)], names=["key", "clean", "toxic"])

        def fold() -> pa.RecordBatch:
            keys = list(hits[0].keys() | hits[1].keys())
            row = rows(keys, *([h[k] for k in keys] for h in hits))
            for h in hits:
                h.clear()
            return row

        for b in batches:
            for t, toxic in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
                n[toxic] += 1
                hits[toxic].update(set().union(*map(_units_of.__getitem__, set((t.as_py() or "").lower().split()))))
                if len(hits[0]) + len(hits[1]) > 500_000:
                    yield fold()
        yield fold()
        yield rows([None], [n[0]], [n[1]])

    counts = map_batches(labelled, ["text", "toxic"], run, "key bigint, clean bigint, toxic bigint")
    return stored(counts.groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-units")


def _steps(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Newton's method with a small ridge; ``sums`` gives the curvature and the slope at some weights."""
    w = np.zeros(4)
    for _ in range(50):
        h, g = sums(w)
        step = np.linalg.solve(h + 0.1 * np.eye(4), g - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row's curvature and slope, for every row."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x[:, :, None] * x[:, None, :] * (p * (1 - p))[:, None, None], x * (y - p)[:, None]


def _logistic(features: DataFrame) -> np.ndarray:
    """Weights fitted on all rows of ``x array<double>, y int, n bigint``. Sums are whole numbers of 2^-30, which no order of the tasks changes."""

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.array(b.column("x").to_pylist()).reshape(-1, 4)
                h, g = _slopes(x, b.column("y").to_numpy(), w)
                parts = np.rint(np.concatenate([h.reshape(-1, 16), g], axis=1) * 2.0**30).astype(np.int64) * b.column("n").to_numpy()[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([parts.sum(axis=0).tolist()], pa.list_(pa.int64()))], names=["sums"])

        rows = map_batches(features, ["x", "y", "n"], run, "sums array<bigint>").collect()  # 20 numbers a batch
        total = np.array([sum(c) / 2**30 for c in zip(*(r["sums"] for r in rows), strict=True)])
        return total[:16].reshape(4, 4), total[16:]

    return _steps(sums)


def learn(docs: DataFrame, labels: DataFrame, seed: int = 11) -> Model:
    """The model of all ``docs`` and of all their ``labels``: evidence from four fifths of the labelled rows, by a hash of the id, the logistic model from the rest."""
    chars = language(docs)
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).hint("merge")  # never a broadcast: labels grow with the documents
    fifth = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(5))
    texts = docs.select("doc_id", "text")
    counts = _unit_counts(texts.where(fifth != 4).join(marked, "doc_id"))
    n = counts.where("key is null").select("clean", "toxic").first() or (0, 0)
    if not min(n):
        discard(counts)
        return Model(chars, {}, np.zeros(0))
    rate, a, both = n[1] / sum(n), F.col("toxic"), F.col("toxic") + F.col("clean")
    p = (a + SHRINK * rate) / (both + SHRINK)
    units = counts.where("key is not null").where((a > 2) & (a / both > rate)).select("key", (F.log(p / (1 - p)) - math.log(rate / (1 - rate))).alias("value"))
    evidence = Hashed.gather(units.where(F.col("value") > LEAST))  # no feature reads the others
    discard(counts)
    first = docs.sparkSession.sparkContext.broadcast(Model(chars, evidence, np.zeros(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(first.value)
        for b in batches:
            x = [[*scorer.features(t.as_py()).tolist(), 1.0] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("toxic")], names=["x", "y"])

    rest = map_batches(texts.where(fifth == 4).join(marked, "doc_id"), ["text", "toxic"], run, "x array<double>, y int")
    features = stored(rest.groupBy("x", "y").agg(F.count("*").alias("n")), "toxic-features")
    weights = np.zeros(0) if features.isEmpty() else _logistic(features)
    discard(features)
    first.destroy()
    return Model(chars, evidence, weights)


def fit(texts: list[str], toxic: list[int], of_corpus: dict[str, int] | None = None) -> Model:
    """``learn`` for texts in memory: evidence from four fifths of the rows, the logistic model from the rest.

    ``of_corpus``: trigram counts of the character model; those of ``texts`` where it is not given.
    """
    words: Counter[str] = Counter()
    split: list[set[str]] = []
    for t in texts:
        found = _WORDS.findall(t.lower())
        words.update(found)
        split.append(set(found))
    chars = CharModel(_trigrams(words) if of_corpus is None else of_corpus, words)
    if len(set(toxic)) < 2:
        return Model(chars, {}, np.zeros(0))
    part = [i % 5 == 4 for i in range(len(texts))]

    def evidence(rows: list[int]) -> dict[str, float]:
        hits: dict[int, Counter[str]] = defaultdict(Counter)
        n = Counter(toxic[i] for i in rows)
        for i in rows:
            hits[toxic[i]].update({u for w in split[i] for u in _units(w)})
        rate = n[1] / max(1, len(rows))
        out = {}
        for u, a in hits[1].items():
            b = hits[0][u]
            if a > 2 and a / (a + b) > rate:
                p = (a + SHRINK * rate) / (a + b + SHRINK)
                out[u] = math.log(p / (1 - p)) - math.log(rate / (1 - rate))
        return out

    first = Model(chars, evidence([i for i, held in enumerate(part) if not held]), np.zeros(0))
    scorer = Scorer(first)
    rows = [i for i, held in enumerate(part) if held]
    x = np.array([[*scorer.features(texts[i]), 1.0] for i in rows])
    y = np.array([float(toxic[i]) for i in rows])
    return Model(chars, first.evidence, _steps(lambda w: tuple(s.sum(axis=0) for s in _slopes(x.reshape(-1, 4), y, w))))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, the columns in ``keep``, ``score`` and ``predicted``. Narrow."""
    keep = [c for c in keep or [] if c != "doc_id"]
    kinds = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # grows with the vocabulary: 16 bytes a known word or a unit with evidence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for b in batches:
            found = [scorer.score(t.as_py()) for t in b.column("text")]
            columns = [b.column(c) for c in ["doc_id", *keep]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], names=["doc_id", *keep, "score", "predicted"])

    head = ", ".join(f"`{c}` {kinds[c]}" for c in ["doc_id", *keep])
    return map_batches(docs, list(dict.fromkeys(["doc_id", *keep, "text"])), run, f"{head}, score double, predicted int")
