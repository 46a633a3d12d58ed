"""Markdown chunks: the one sequential step, a state machine per document inside ``mapInArrow`` (or a UDTF)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import node_id
from ..functions.scores import ATOMIC
from ..functions.tokens import cut

# Fixed values.
ATOMIC_TOKENS = 1000
TINY_TOKENS = 50
_RULE_CELL = re.compile(r":?-{3,}:?")
#: Ends of lines and blanks of Markdown; str.splitlines() and str.strip() know many more, which are text like any other.
_LINE_END = re.compile(r"\r\n|\r|\n")
_BLANKS = " \t\n\r\f"
_HEADING = re.compile(r"^(#+)\s+(.*?)\s*$")


@lru_cache(maxsize=10_000)
def token_size(text: str) -> int:
    """Valid tokens of a text; counts what ``functions.tokens.token_size`` counts."""
    return len(cut(text))


def is_row(line: str) -> bool:
    """Bars at both ends with something between."""
    bare = line.strip()
    return len(bare) > 2 and bare[0] == bare[-1] == "|"


def is_rule(line: str) -> bool:
    """Two cells or more, each of three dashes at least, perhaps with colons; outer bars may be missing."""
    cells = line.strip().removeprefix("|").removesuffix("|").split("|")
    return len(cells) > 1 and all(_RULE_CELL.fullmatch(c.strip()) for c in cells)


def is_table(lines: list[str], i: int) -> bool:
    return i + 1 < len(lines) and is_row(lines[i]) and is_rule(lines[i + 1])


def blocks(markdown: str) -> list[str]:
    """Fences (an open one runs to the end), tables, headings and paragraphs."""
    lines, out, held, i = _LINE_END.split(markdown), [], [], 0

    def flush() -> None:
        if held:
            out.append("\n".join(held).strip(_BLANKS))
            held.clear()

    while i < len(lines):
        bare, start = lines[i].strip(_BLANKS), i
        if not bare:
            flush()
            i += 1
        elif bare.startswith("```"):
            flush()
            i = next((j + 1 for j in range(i + 1, len(lines)) if lines[j].strip(_BLANKS).startswith("```")), len(lines))
            out.append("\n".join(lines[start:i]).strip(_BLANKS))
        elif is_table(lines, i):
            flush()
            i += 2
            while i < len(lines) and is_row(lines[i]):
                i += 1
            out.append("\n".join(lines[start:i]).strip(_BLANKS))
        elif bare.startswith("#"):
            flush()
            out.append(bare)
            i += 1
        else:
            held.append(lines[i])
            i += 1
    flush()
    return out


def level(block: str) -> int:
    m = _HEADING.match(block)
    return len(m.group(1)) if m else 0


def heading_path(section: list[str]) -> str:
    """Path at the last heading."""
    path: list[str] = []
    for b in section:
        m = _HEADING.match(b)
        if m and m.group(2):
            path = [*path[: len(m.group(1)) - 1], m.group(2)]
    return " > ".join(path)


def _cut_before(items: list[str], at) -> list[list[str]]:
    groups: list[list[str]] = []
    for b in items:
        if at(b) or not groups:
            groups.append([])
        groups[-1].append(b)
    return groups


def _overlap(section: list[str], limit: int) -> list[str]:
    picked: list[str] = []
    total = 0
    for b in reversed(section if limit > 0 else []):
        n = token_size(b)
        if n > limit:
            continue
        if picked and total + n > limit:
            break
        picked.insert(0, b)
        total += n
    return picked


def _line_parts(block: str, size: int) -> list[str]:
    parts: list[list[str]] = [[]]
    total = 0
    for line in _LINE_END.split(block):
        n = token_size(line)
        if parts[-1] and total + n > size:
            parts.append([])
            total = 0
        parts[-1].append(line)
        total += n
    return ["\n".join(p) for p in parts if p]


class _Packer:
    """Chunks of one large section."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap = size, overlap
        self.chunks: list[tuple[str, str]] = []
        self.held: list[str] = []
        self.tokens = 0
        self.path = ""

    def emit(self, section: list[str], path: str) -> None:
        text = "\n\n".join(section).strip(_BLANKS)
        if text:
            self.chunks.append((text, path))

    def flush(self) -> None:
        if self.held:
            self.emit(self.held, self.path)
        self.held, self.tokens = [], 0

    def add(self, block: str, path: str) -> None:
        n, heading = token_size(block), level(block) > 0
        if self.held and self.tokens + n > self.size:
            self.emit(self.held, self.path)
            self.held = _overlap(self.held, self.overlap)
            self.tokens = sum(map(token_size, self.held))
        if not self.held or heading:
            self.path = path
        if n > self.size and not (block.lstrip().startswith("```") or is_table(_LINE_END.split(block), 0)):
            for part in _line_parts(block, self.size):
                self.flush()
                self.emit([part.strip(_BLANKS)], self.path)
        else:
            self.held.append(block)
            self.tokens += n

    def section(self, section: list[str]) -> list[tuple[str, str]]:
        stack: list[str] = []
        atomic: list[tuple[str, str]] | None = None
        for b in section:
            depth = level(b)
            if depth:
                title = _HEADING.match(b).group(2)
                stack = [*stack[: depth - 1], title] if title else stack
            path = " > ".join(stack)
            if depth >= 3 and atomic is None and any(k in stack[-1].lower() for k in ATOMIC if stack):
                parents = self.held and self.tokens < TINY_TOKENS and all(0 < level(x) < depth for x in self.held)
                if not parents:
                    self.flush()
                atomic = [(x, path) for x in self.held] + [(b, path)]
                self.held, self.tokens = [], 0
                continue
            if atomic is not None and 0 < depth <= 3:
                self.close(atomic)
                atomic = None
            if atomic is not None:
                atomic.append((b, path))
            else:
                self.add(b, path)
        if atomic is not None:
            self.close(atomic)
        self.flush()
        return self.chunks

    def close(self, atomic: list[tuple[str, str]]) -> None:
        """A protected section is one chunk; one too large is packed like any text, so that none of it is lost."""
        if sum(token_size(b) for b, _ in atomic) <= ATOMIC_TOKENS:
            first = next(p for b, p in atomic if level(b) >= 3 or p)
            self.emit([b for b, _ in atomic], first)
        else:
            for b, p in atomic:
                self.add(b, p)
            self.flush()


def _by_h3(section: list[str], size: int) -> list[tuple[str, str]]:
    groups = _cut_before(section, lambda b: level(b) == 3)
    if len(groups) > 1 and sum(map(token_size, groups[0])) < TINY_TOKENS and all(level(b) <= 2 for b in groups[0]):
        groups[:2] = [groups[0] + groups[1]]
    out: list[list[str]] = []
    total = 0
    for g in groups:
        n = sum(map(token_size, g))
        if not out or total and total + n > size:
            out.append([])
            total = 0
        out[-1] += g
        total += n
    return [(t, heading_path(s)) for s in out if (t := "\n\n".join(s).strip(_BLANKS))]


def split(markdown: str, size: int = 512, overlap: int = 100, packed: bool = True) -> list[tuple[str, str]]:
    """Chunks as (text, heading path): whole H2 sections, those up to twice the size at H3s, larger ones packed with overlap, or without ``packed`` at H3s too."""
    out: list[tuple[str, str]] = []
    for section in _cut_before(blocks(markdown), lambda b: bool(re.match(r"##\s+", b))):
        n = sum(map(token_size, section))
        if n <= size:
            text = "\n\n".join(section).strip(_BLANKS)
            out += [(text, heading_path(section))] if text else []
        elif n <= 2 * size or not packed:
            out += _by_h3(section, size)
        else:
            out += _Packer(size, overlap).section(section)
    return out


def chunk(docs: DataFrame, size: int = 512, overlap: int = 100, packed: bool = True) -> DataFrame:
    """``doc_key, doc_id, chunk_index, text, heading_path, token_size, node_id`` of ``docs(doc_key, doc_id, text)``. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, doc, text in zip(*(b.column(c).to_pylist() for c in ("doc_key", "doc_id", "text")), strict=True):
                rows += [(key, doc, i, t, p, token_size(t)) for i, (t, p) in enumerate(split(text or "", size, overlap, packed))]
            if rows:
                kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_key", "doc_id", "chunk_index", "text", "heading_path", "token_size"])

    cut = docs.select(*(F.col(c).cast("string").alias(c) for c in ("doc_key", "doc_id", "text"))).mapInArrow(run, "doc_key string, doc_id string, chunk_index int, text string, heading_path string, token_size int")
    return cut.withColumn("node_id", node_id(F.col("doc_id"), F.col("chunk_index"), F.col("text")))


def register(spark: SparkSession, name: str = "markdown_chunks") -> None:
    """Makes the chunker a table function: ``SELECT c.* FROM docs, LATERAL markdown_chunks(text, 512, 100) c``."""
    from pyspark.sql.functions import udtf

    class Chunks:
        def eval(self, text: str, size: int, overlap: int):
            for i, (t, p) in enumerate(split(text or "", size, overlap)):
                yield i, t, p, token_size(t)

    spark.udtf.register(name, udtf(Chunks, returnType="chunk_index int, text string, heading_path string, token_size int"))
