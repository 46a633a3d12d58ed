"""Exported HTML and MHTML to Markdown: parsing is sequential, so it runs per file inside ``mapInArrow``."""

from __future__ import annotations

import email
import email.headerregistry
import email.policy
import quopri
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import escape, unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import bounded, tidied

DROPPED = {"script", "style", "meta", "link", "noscript", "svg"}
NOISE = ("page-metadata", "page-metadata-banner", "content-byline", "toc", "toc-indentation", "tocoutline", "toc-macro", "confluencetablesmall", "print-only", "hidden")
#: Fixed value: what untitled tables are called.
TABLE_MARK = "表格"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DEEPEST = 250
_EMPHASIS = {"b": "**", "strong": "**", "i": "*", "em": "*"}
#: Tags that close the inline tags still open in front of them.
_BLOCKS = set("address article aside blockquote body div dl dt dd fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_SUFFIX = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp", "image/webp": ".webp", "image/svg+xml": ".svg", "image/tiff": ".tiff"}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.depth: int = parent.depth + 1 if parent is not None else 0
        self.children: list[Node | str] = []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self) -> Iterator[Node]:
        for c in list(self.children):
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def html(self) -> str:
        inner = "".join(escape(c, quote=False) if isinstance(c, str) else c.html() for c in self.children)
        if not self.tag:
            return inner
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" if self.tag in VOID else f"<{self.tag}{attrs}>{inner}</{self.tag}>"


class _Tree(HTMLParser):
    """Comments never enter the tree; an end tag closes up to its start, a stray one nothing. Tags nested deeper than ``DEEPEST`` hold nothing: what follows stands beside them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.flat: Counter[str] = Counter()  # open tags that are too deep

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            while self.at.tag in _EMPHASIS and self.at.parent is not None:
                self.at = self.at.parent
        if tag in ("p", "li", "tr", "td", "th") and self.at.tag == tag or tag == "tr" and self.at.tag in ("td", "th"):
            self.at = self.at.parent or self.root
            if tag == "tr" and self.at.tag == "tr":
                self.at = self.at.parent or self.root
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in VOID:
            if n.depth < DEEPEST:
                self.at = n
            else:
                self.flat[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        if self.flat[tag]:
            self.flat[tag] -= 1
            return
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def _hidden(n: Node) -> bool:
    style = n.attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in n.attrs or n.attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


def _noise(n: Node) -> bool:
    marks = " ".join(n.attrs.get(k, "") for k in ("class", "id", "data-macro-name")).lower()
    return any(p in marks for p in NOISE)


def clean(root: Node) -> Node:
    """Drops scripts, hidden and exported clutter and fonts without text; tables that nothing titles get a numbered marker."""

    def prune(n: Node) -> bool:
        """Whether text is left."""
        kept: list[Node | str] = []
        some = False
        for c in n.children:
            if isinstance(c, str):
                some = some or not c.isspace()
            else:
                if c.tag in DROPPED or _hidden(c) or _noise(c):
                    continue
                filled = prune(c)
                if c.tag in ("font", "span") and not filled:
                    continue
                some = some or filled
            kept.append(c)
        n.children = kept
        return some

    prune(root)
    titled, tables = False, 0
    for n in list(root.walk()):
        if n.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "caption"):
            titled = True
        elif n.tag == "table":
            tables += 1
            if not titled and n.parent is not None:
                mark = Node("p", {}, n.parent)
                mark.children = [f"{TABLE_MARK} {tables}"]
                n.parent.children.insert(n.parent.children.index(n), mark)
    return root


def reference(raw: str) -> str:
    """Comparable form of a link to an asset."""
    r = raw.strip().strip("<>").replace("\\", "/")
    r = re.sub(r"(?i)^cid:", "", r)
    r = re.sub(r"(?i)^file:/+", "", r)
    return re.sub(r"^([A-Za-z]):", lambda m: m.group(1).lower() + ":", r)


def asset_suffix(name: str | None, kind: str) -> str:
    m = re.search(r"\.[A-Za-z0-9]{1,8}$", name or "")
    return m.group().lower() if m else _SUFFIX.get(kind.lower(), ".bin")


def link_images(root: Node, assets: dict[str, str]) -> int:
    """Points images at saved assets and numbers those that were found; returns how many."""
    known, n = {reference(k): v for k, v in assets.items()}, 0
    for img in (x for x in root.walk() if x.tag == "img"):
        r = reference(img.attrs.get("src") or img.attrs.get("data-image-src") or "")
        path = r and (known.get(r) or ("/" not in r and known.get(f"c:/{r}")))
        if path:
            n += 1
            img.attrs |= {"src": path, "data-image-src": path, "data-image-id": f"img_{n:04d}"}
    return n


def to_markdown(root: Node) -> str:
    out: list[str] = []

    def inline(n: Node) -> str:
        parts = []
        for c in n.children:
            if isinstance(c, str):
                parts.append(re.sub(r"\s+", " ", c))
            elif c.tag == "br":
                parts.append("\n")
            elif c.tag == "img":
                parts.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})")
            elif c.tag == "code":
                parts.append(f"`{c.text()}`")
            else:
                inner = inline(c)
                bare = inner.strip()
                if c.tag == "a" and c.attrs.get("href"):
                    parts.append(f"[{bare}]({c.attrs['href']})")
                else:
                    mark = _EMPHASIS.get(c.tag, "") if bare else ""
                    parts.append(f"{mark}{bare}{mark}" if mark else inner)
        return "".join(parts)

    def items(n: Node, depth: int) -> Iterator[str]:
        for k, li in enumerate((c for c in n.children if isinstance(c, Node) and c.tag == "li"), 1):
            lists = [c for c in li.children if isinstance(c, Node) and c.tag in ("ul", "ol")]
            li.children = [c for c in li.children if c not in lists]
            yield "  " * depth + (f"{k}. " if n.tag == "ol" else "- ") + inline(li).strip()
            for sub in lists:
                yield from items(sub, depth + 1)

    def rows(n: Node) -> list[list[str]]:
        return [[re.sub(r"\s+", " ", inline(c)).strip().replace("|", "\\|") for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")] for tr in n.walk() if tr.tag == "tr"]

    def block(n: Node) -> None:
        loose: list[Node | str] = []

        def flush() -> None:
            if loose:
                holder = Node("", {}, None)
                holder.children = list(loose)
                text = inline(holder).strip()
                if text:
                    out.append(text)
                loose.clear()

        for c in n.children:
            if isinstance(c, str) or c.tag in ("a", "b", "strong", "i", "em", "code", "span", "font", "img", "br", "u", "sub", "sup", "small"):
                loose.append(c)
                continue
            flush()
            if re.fullmatch("h[1-6]", c.tag):
                title = re.sub(r"\s+", " ", inline(c)).strip()
                out.extend([f"{'#' * int(c.tag[1])} {title}"] if title else [])
            elif c.tag == "pre":
                out.append("```\n" + c.text().strip("\n") + "\n```")
            elif c.tag in ("ul", "ol"):
                out.append("\n".join(items(c, 0)))
            elif c.tag == "table":
                grid = [r for r in rows(c) if r]
                if grid:
                    wide = max(map(len, grid))
                    lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in grid]
                    out.append("\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]]))
            elif c.tag not in ("head", "title"):
                block(c)
        flush()

    block(root)
    return "\n\n".join(out)


def normal_markdown(text: str) -> str:
    """Unix ends of lines, plain spaces, no trailing ones, at most two blank lines in a row outside fences, one end of line at the end."""
    text = re.sub("\r\n?", "\n", text).replace("\xa0", " ")
    text = re.sub("[\u200b\ufeff]", "", text)
    out: list[str] = []
    fence, blank = False, 0
    for line in (raw.rstrip() for raw in text.split("\n")):
        if line.lstrip().startswith("```"):
            fence = not fence
        blank = 0 if line or fence else blank + 1
        if blank <= 2:
            out.append(line)
    return "\n".join(out).strip() + "\n"


def embedded(html: str) -> str:
    """The page inside an MHTML export that was pasted as preformatted text, else ``html`` itself."""
    if "message-id:" not in html.lower():
        return html
    text = unescape("\n".join(n.text() for n in tree(html).walk() if n.tag == "pre")).replace("\r\n", "\n").replace("\r", "\n")
    low = text.lower()
    if not all(m in low for m in ("message-id:", "content-transfer-encoding: quoted-printable", "content-type: text/html")):
        return html
    part = re.search(r"(?ims)^[ \t]*content-type: text/html.*?\n[ \t]*\n(.*?)(?=^[ \t]*(?:------=_|content-type:)|\Z)", text)
    page = quopri.decodestring(part.group(1).encode()).decode("utf-8", "ignore") if part else ""
    found = re.search(r"(?is)<html.*</html>", page) or re.search(r"(?is)<html.*", page)
    return (found.group() if found else page) or html


#: Headers are read once; the policy itself would parse one anew each time that it is asked for.
_header = lru_cache(maxsize=4096)(email.headerregistry.HeaderRegistry())
_POLICY = email.policy.default.clone(header_factory=_header)


def mhtml(content: bytes) -> tuple[str, list[tuple[str, str, bytes, str | None, str | None]]] | None:
    """Longest HTML part, and images as (reference, type, data, name, content id); None if it is no multipart with HTML."""
    message = email.message_from_bytes(content, policy=_POLICY)
    if not message.is_multipart():
        return None
    pages, assets = [], []
    for part in message.walk():
        kind, data = part.get_content_type(), part.get_payload(decode=True)
        if kind == "text/html" and data:
            try:
                pages.append(data.decode(part.get_content_charset() or "utf-8", "ignore"))
            except LookupError:
                pages.append(data.decode("utf-8", "ignore"))
        elif kind.startswith("image/") and data:
            cid = (part.get("Content-ID") or "").strip().strip("<>") or None
            assets.append((str(part.get("Content-Location") or cid or ""), kind, data, part.get_filename(), cid))
    return (max(pages, key=len), assets) if pages else None


def convert(html: str, assets: dict[str, str] | None = None) -> str:
    root = clean(tree(embedded(html)))
    link_images(root, assets or {})
    return normal_markdown(to_markdown(root))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Pieces of batches, so that few pages and their trees are held at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def markdown_of(pages: DataFrame, html_col: str, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` and ``markdown`` of HTML pages; null stays empty. Narrow."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            texts = [convert(h) if h else "" for h in b.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "markdown"])

    return bounded(pages).select(*keep, html_col).mapInArrow(tidied(run), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", markdown string")


PACKAGE = "path string, html string, assets array<struct<reference:string,kind:string,data:binary,name:string,cid:string,file:string>>"


def packages(files: DataFrame) -> DataFrame:
    """MHTML packages of ``binaryFile`` rows; assets are numbered in order, the empty ones skipped. Other files yield no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("reference", pa.string()), ("kind", pa.string()), ("data", pa.binary()), ("name", pa.string()), ("cid", pa.string()), ("file", pa.string())]))
        for b in _slices(batches):
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if found := mhtml(content):
                    named = [{"reference": r, "kind": k, "data": d, "name": n, "cid": c, "file": f"img_{i:04d}{asset_suffix(n or r, k)}"} for i, (r, k, d, n, c) in enumerate(found[1], 1)]
                    rows.append((path, found[0], named))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], kind)], names=["path", "html", "assets"])

    return bounded(files).select("path", "content").mapInArrow(tidied(run), PACKAGE)


def preprocess(files: DataFrame, asset_root: str = "assets") -> DataFrame:
    """``path, work_name, markdown, assets`` of Word exports in MHTML form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            texts = []
            for work, html, assets in zip(b.column("work_name").to_pylist(), b.column("html").to_pylist(), b.column("assets").to_pylist(), strict=True):
                paths = {r: f"{asset_root}/{work}/{a['file']}" for a in assets for r in (a["reference"], a["cid"], a["name"]) if r}
                texts.append(convert(html, paths))
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("work_name"), pa.array(texts, pa.string()), b.column("assets")], names=["path", "work_name", "markdown", "assets"])

    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    named = packages(files).withColumn("work_name", F.concat(stem, F.lit("-"), F.substring(F.sha2("path", 256), 1, 8)))
    return named.select("path", "work_name", "html", "assets").mapInArrow(tidied(run), f"path string, work_name string, markdown string, {PACKAGE.split(', ', 2)[2]}")
