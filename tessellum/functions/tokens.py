"""Technical-text tokens, cut in whole batches of texts by Python's patterns; built-in functions would call a chain of expressions for every token."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Compounds that count as tokens.
COMPOUNDS = ("向量召回", "谷歌订阅", "订阅支付", "查询改写")
_OPEN, _CLOSE = "", ""
# The words that stay whole. Each starts at the first of its letters and no part gives characters back, so a run of letters is read a few times, not once for each way to cut it.
_TECHNICAL = re.compile(
    r"/[A-Za-z0-9_./-]++"
    r"|(?<![A-Za-z])(?:[A-Za-z][A-Za-z0-9.-]*+_[A-Za-z0-9_.-]++"
    r"|[A-Za-z][A-Za-z0-9_.]*+-[A-Za-z0-9_.-]++"
    r"|[A-Za-z]++(?:\.[A-Za-z0-9_-]++)++"
    r"|[A-Za-z]++\s++\d++(?:\.\d++)*+"
    r"|(?:[Ii][Dd]|[Mm][Dd]|[Aa][Pp][Ii]|[Uu][Ii]|[Ll][Ll][Mm])(?![A-Za-z]))"
)
_WRAPPED = rf" {_OPEN}\g<0>{_CLOSE} "
_PIECES = re.compile(rf"{_OPEN}[^{_CLOSE}]*{_CLOSE}|[A-Za-z0-9_./-]+|[一-鿿]+")
_PLAIN = re.compile(r"[A-Za-z0-9_./-]+")
_INVALID = re.compile(r"[_./-]+|[A-Za-z]")
_WORD = re.compile("[a-z0-9]+")
_MARKS = "`\"'()[]{}<>:;,.!?，。；：、"
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.btrim(c, F.lit(_BLANKS))


@lru_cache(maxsize=100_000)
def _normal(piece: str) -> str:
    """The token of a piece, empty if it is none."""
    bare = piece.strip(_OPEN + _CLOSE).strip().strip(_MARKS)
    return "" if _INVALID.fullmatch(bare) else bare.lower() if _PLAIN.fullmatch(bare) else bare


def cut(text: str | None) -> list[str]:
    """Valid tokens in order, repeats included. Null and empty texts have none."""
    if not text:
        return []
    plain = text.replace(_OPEN, "").replace(_CLOSE, "")
    return [t for t in map(_normal, _PIECES.findall(_TECHNICAL.sub(_WRAPPED, plain))) if t]


def cut_distinct(text: str | None, found: list[str] | None = None) -> list[str]:
    """Distinct tokens by first occurrence, then the fixed compounds that the text holds when its white space is taken out."""
    compact = "".join(text.split()) if text and not text.isascii() else ""
    return list(dict.fromkeys([*(cut(text) if found is None else found), *(c for c in COMPOUNDS if c in compact)]))


def cut_words(text: str | None) -> list[str]:
    """Distinct lower-case runs of letters a-z and digits; a capital I with a dot is an i, as SQL has it."""
    return list(dict.fromkeys(_WORD.findall((text or "").replace("İ", "i").lower())))


def _listed(name: str, of: Callable[[str | None], list[str]]) -> Callable[[pa.Array], pa.Array]:
    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([of(t.as_py()) for t in texts[i : i + 256]], pa.list_(pa.string())) for i in range(0, len(texts), 256)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    run.__name__ = name
    return run


def _column(name: str, of: Callable[[str | None], list[str]], text: Column) -> Column:
    return F.arrow_udf(_listed(name, of), "array<string>")(text)


def all_tokens(text: Column) -> Column:
    """Column of ``cut``."""
    return _column("all_tokens", cut, text)


def tokens(text: Column) -> Column:
    """Column of ``cut_distinct``."""
    return _column("tokens", cut_distinct, text)


def counted(text: Column) -> Column:
    """``tokens`` and ``token_size`` (n) of a text that is cut once."""

    def run(texts: pa.Array) -> pa.Array:
        sizes, found = [], []
        for i in range(0, len(texts), 256):
            cuts = [cut(t.as_py()) for t in texts[i : i + 256]]
            sizes += map(len, cuts)
            found.append(pa.array([cut_distinct(t.as_py(), c) for t, c in zip(texts[i : i + 256], cuts, strict=True)], pa.list_(pa.string())))
        return pa.StructArray.from_arrays([pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.string())), pa.array(sizes, pa.int32())], ["tokens", "n"])

    return F.arrow_udf(run, "tokens array<string>, n int")(text)


def token_size(text: Column) -> Column:
    return F.size(all_tokens(text))


def index_text(text: Column, summary: Column, keywords: Column, tags: Column) -> Column:
    """What the keyword index sees of a chunk."""
    return F.concat_ws(" ", text, summary, F.array_join(keywords, " "), F.array_join(tags, " "))


def words(text: Column) -> Column:
    """Plain variant that any SQL engine shares: column of ``cut_words``."""
    return _column("words", cut_words, text)
