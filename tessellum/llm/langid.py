"""Operator 4: language identification by words first, then shorter and shorter n-grams.

The model holds log frequencies per language of the words and of the character
n-grams (words padded with a space on both sides) of labelled texts. A text is scored
word by word: a known word adds its log frequencies; an unknown one is cut into
n-grams of the longest order, each of which backs off to shorter ones, at a penalty
per step, until it is known.

Edge cases: a null text, or one without letters (combining marks alone are none), is ``und`` with score 0; a tie goes
to the language that sorts first; repeated rows are scored alike; an empty table
gives no rows; without any labelled text every prediction is ``und``; a null
``lang`` never trains; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_batches

_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
ORDER = 5
#: Taken off the log frequency for each order that an n-gram backs off.
PENALTY = 0.7


@dataclass
class Model:
    """``words`` and ``grams`` give rows of ``word_logs`` and ``gram_logs``, which have a column for each language."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_logs: np.ndarray
    gram_logs: np.ndarray
    floor: np.ndarray

    def parts(self, word: str) -> tuple[list[int], float]:
        """Rows of ``logs()`` whose mean is the word's score, and what the steps of its back-off take off that mean."""
        known = self.words.get(word)
        if known is not None:
            return [known], 0.0
        padded, grams, at, rows, steps = f" {word} ", self.grams, len(self.words), [], 0
        floor = at + len(grams)
        for i in range(max(1, len(padded) - ORDER + 1)):
            gram = padded[i : i + ORDER]
            row = grams.get(gram)
            while row is None and gram:
                gram, steps = gram[:-1], steps + 1
                row = grams.get(gram)
            rows.append(floor if row is None else at + row)
        return rows, PENALTY * steps / len(rows)  # an unknown word counts as one word, whatever its length

    def logs(self) -> np.ndarray:
        """Words, then n-grams, then the floor."""
        return np.concatenate([self.word_logs, self.gram_logs, self.floor[None, :]])

    def word(self, word: str) -> np.ndarray:
        rows, cost = self.parts(word)
        return self.logs()[rows].mean(axis=0) - cost


def fit(labelled: dict[str, list[str]], words: int = 20_000, grams: int = 60_000) -> Model:
    """From texts by language. ``words`` and ``grams`` bound the model for each language."""
    langs = sorted(labelled)
    by_word: list[Counter[str]] = []
    by_gram: list[Counter[str]] = []
    for lang in langs:
        w = Counter(x for t in labelled[lang] for x in _NOT_LETTERS.sub(" ", t.lower()).split())
        g: Counter[str] = Counter()
        for x, n in w.items():
            p = f" {x} "
            for size in range(1, ORDER + 1):
                for i in range(len(p) - size + 1):
                    g[p[i : i + size]] += n
        by_word.append(w)
        by_gram.append(g)

    def logs(counts: list[Counter[str]], most: int, least: int) -> tuple[dict[str, int], np.ndarray]:
        keys = sorted({k for c in counts for k, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most] if n >= least})
        totals = np.array([sum(c.values()) + 1.0 for c in counts])
        table = np.array([[c.get(k, 0) + 0.1 for c in counts] for k in keys]).reshape(len(keys), len(counts))
        return {k: i for i, k in enumerate(keys)}, np.log(table / totals)

    of_words, of_grams = logs(by_word, words, 2), logs(by_gram, grams, 1)
    return Model(langs, of_words[0], of_grams[0], of_words[1], of_grams[1], np.full(len(langs), math.log(1e-9)))


def sample(docs: DataFrame, per_lang: int, seed: int = 7) -> dict[str, list[str]]:
    """Labelled texts for ``fit``: whole texts of about ``per_lang`` documents a language, chosen by a hash of the id.

    The bound keeps what the driver gets independent of the size of the table.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_000))
    share: Column = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(math.ceil(1e6 * min(1.0, per_lang / n)))).otherwise(share)
    out: dict[str, list[str]] = {lang: [] for lang in counts}
    for r in known.where(draw < share).select("lang", "text", "doc_id").toLocalIterator():
        out[r["lang"]].append(r["text"])
    return {lang: sorted(texts) for lang, texts in out.items() if texts}


class _Rows(dict):
    """Chunk to its row in a table; ``make`` adds the row of a new one."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> int:
        i = self[chunk] = self.make(chunk)
        return i


class Scorer:
    """Scores texts; runs of non-space are cached as rows of one table of scores, which new ones enter a text at a time."""

    def __init__(self, model: Model, memo: int = 150_000):
        self.model, self.memo, self.logs = model, memo, model.logs()
        self.table = np.zeros((1024, len(model.langs)))
        self.used = 1  # row 0: no letters, no score
        self.known = _Rows(self._row)
        self.new: list[tuple[int, list[int], float]] = []

    def _row(self, chunk: str) -> int:
        words = [chunk] if chunk.isalpha() else [w for w in _NOT_LETTERS.sub(" ", chunk).split() if _LETTER.search(w)]
        if not words:
            return 0
        self.new += [(self.used, *self.model.parts(w)) for w in words]
        self.used += 1
        return self.used - 1

    def _enter(self) -> None:
        if self.used > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(self.used, len(self.table)), self.table.shape[1]))])
        into, rows, cost = zip(*self.new, strict=True)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
        means = np.add.reduceat(self.logs[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None] - np.array(cost)[:, None]
        self.table[list(into)] = 0
        np.add.at(self.table, list(into), means)
        self.new = []

    def predict(self, text: str | None) -> tuple[str, float]:
        if len(self.known) > self.memo:
            self.known.clear()
            self.used = 1
        chunks = text.lower().split() if text else []
        ids = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        if not self.model.langs or not ids.any():
            self.new = []
            return "und", 0.0
        if self.new:
            self._enter()
        total = self.table[ids].sum(axis=0)
        best = int(np.argmax(total))
        return self.model.langs[best], float(1.0 / np.exp(np.maximum(total - total[best], -700.0)).sum())


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, the columns in ``keep``, ``lang_pred`` and ``score`` (the posterior of that language). Narrow."""
    keep = [c for c in keep or [] if c != "doc_id"]
    kinds = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit()'s words and grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            found = [scorer.predict(t.as_py()) for t in b.column("text")]
            columns = [b.column(c) for c in ["doc_id", *keep]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", *keep, "lang_pred", "score"])

    head = ", ".join(f"`{c}` {kinds[c]}" for c in ["doc_id", *keep])
    return map_batches(docs, list(dict.fromkeys(["doc_id", *keep, "text"])), run, f"{head}, lang_pred string, score double")
