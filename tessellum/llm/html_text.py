"""Operator 1: main text of web pages by text-to-tag ratios.

The standard library's parser streams events; block-level tags cut the page into
lines, each with its text, its tags and the elements around it. A line's ratio is its
text outside links over its tags (none in menus, forms, adverts and the like). The
ratios, smoothed by a Gaussian, fall (as logarithms, since they span several powers of
ten) into two clusters; the threshold between them marks content. Marked lines choose
the ``article`` and ``main`` elements: all that hold one are kept, with their lines of
more text than links and the headings before these. Where such elements hold less than
half of the marked text, or there are none, the marked lines themselves are kept, with
the headings before and the short paragraphs between them.

Boxes named by class, id or role for something else, and forms, are left out with all
they hold, but not where they wrap the page: a box that holds an ``article`` or
``main`` while none stands outside such boxes, or more than half of the text outside links
while no such element does, counts as none. If nothing is left, all boxes count as none.

Edge cases: null or empty html, or a page without content, gives an empty text;
markup that ends early or is nested wrongly is read as far as it goes; repeated rows
give equal results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_batches

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIP = frozenset("script style noscript template svg math iframe object canvas audio video map head title nav footer aside button select textarea datalist dialog menu label fieldset".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
_SPACE = frozenset("br td th option img wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_REGION = frozenset(("article", "main"))
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner banners nav navbar navigation menu menus sidebar sidebars "
    "aside footer footnav header masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations breadcrumb breadcrumbs comment comments commentlist reply replies respond disqus discussion widget widgets pagination pager "
    "search skip hidden paywall disclaimer copyright legal tags taglist byline outbrain taboola".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar status note".split())
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class _Lines(HTMLParser):
    """Cuts a page into lines: [pieces of text, letters in links, tags, region, excluded, heading, boxes around it]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.stack: list[tuple[str, bool, int, tuple[int, ...]]] = [("", False, 0, ())]  # tag, excluded, region, boxes
        self.regions: list[tuple[int, ...]] = [()]  # boxes around each
        self.boxes = 0
        self.links = 0
        self.line: list | None = None

    def _cut(self) -> None:
        self.line = None

    def _hidden(self, attrs: list[tuple[str, str | None]]) -> bool:
        return any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I) for k, v in attrs)

    def _box(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        inside = self.stack[-1][2] > 0
        for k, v in attrs:
            if not v:
                continue
            if k == "role":
                if v.lower() in _ROLES:
                    return True
            elif k in ("class", "id"):
                found = {t.lower() for t in _TOKENS.findall(v)}
                if found & _NOISE and not (inside and tag in ("header", "hgroup") and found & _NOISE <= {"header"}):
                    return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        stack = self.stack
        if tag in _BLOCK:
            while stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or stack[-1][0] not in _BLOCK and any(s[0] == "p" for s in stack[-8:]) and stack[-1][0] not in _SKIP and stack[-1][0] not in ("td", "th"):
                self._pop()
            if tag == "li" and stack[-1][0] == "li" or tag == "body" and stack[-1][0] == "head":
                self._pop()
            self.line = None
        elif tag in _SPACE and self.line is not None:
            self.line[0].append(" ")
        if tag in _VOID:
            if self.line is not None:
                self.line[2] += 1
            return
        _, out, region, boxes = stack[-1]
        if not out:
            out = tag in _SKIP or tag == "header" and not region
            if not out and tag not in ("html", "body", "article", "main"):
                out = self._hidden(attrs)
                if not out and (tag == "form" or self._box(tag, attrs)):
                    self.boxes += 1
                    boxes = (*boxes, self.boxes)
        if tag in _REGION and not region and not out:
            region = len(self.regions)
            self.regions.append(boxes)
        if tag == "a":
            self.links += 1
        stack.append((tag, out, region, boxes))
        if self.line is not None:
            self.line[2] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.stack[-1][0] == tag:
            self._pop()

    def _pop(self) -> None:
        if self.stack.pop()[0] == "a":
            self.links -= 1

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self.line = None
        elif tag in _SPACE and self.line is not None:
            self.line[0].append(" ")
        stack = self.stack
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                while len(stack) > i:
                    self._pop()
                break
            if stack[i][0] in _REGION and tag not in ("body", "html"):
                break  # a stray end tag closes nothing outside the region

    def handle_data(self, data: str) -> None:
        _, out, region, boxes = self.stack[-1]
        if self.line is not None and boxes != self.line[6]:
            if boxes[: len(self.line[6])] == self.line[6]:
                return  # a box within a line wraps nothing
            self.line = None
        if self.line is None:
            if data.isspace():
                return
            heading = any(s[0] in _HEADINGS for s in self.stack[-3:])
            self.line = [[], 0, 1, region, out, heading, boxes]
            self.lines.append(self.line)
        if not out:
            self.line[0].append(data)
            if self.links:
                self.line[1] += len(data)


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing; the kernel is cut at three deviations and normed at the ends."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi], strict=True)) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """Halfway between the means of the two clusters into which the values fall."""
    low, high = min(values), max(values)
    for _ in range(20):
        t = (low + high) / 2
        under, over = [v for v in values if v < t], [v for v in values if v >= t]
        if not under or not over:
            return t
        a, b = sum(under) / len(under), sum(over) / len(over)
        if (a, b) == (low, high):
            break
        low, high = a, b
    return (low + high) / 2


def extract(html: str | None) -> str:
    """Main text: blocks in page order, joined by an empty line."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    if re.match("<[a-zA-Z/!?]", parser.rawdata):  # a tag or comment that never ends is no text
        parser.rawdata = ""
    parser.close()
    lines, around = [], []
    for pieces, linked, tags, region, out, heading, boxes in parser.lines:
        text = " ".join("".join(pieces).split()) if not out else ""
        own = max(0, len(text) - linked)
        lines.append((text, own / max(1, tags), own, region, heading))
        around.append(boxes)
    if not parser.boxes:
        return "\n\n".join(_content(lines))
    wrapping = _wrapping(lines, around, parser.regions)
    inner = [line if wrapping.issuperset(boxes) else ("", 0.0, 0, line[3], line[4]) for line, boxes in zip(lines, around, strict=True)]
    return "\n\n".join(_content(inner) or _content(lines))


def _wrapping(lines: list[tuple[str, float, int, int, bool]], around: list[tuple[int, ...]], regions: list[tuple[int, ...]]) -> set[int]:
    """Boxes that wrap the page and so exclude nothing, outer ones before those in them."""
    own: dict[int, int] = {}
    filled: set[tuple[int, ...]] = set()  # boxes around the regions that have text of their own
    for (_, _, n, region, _), boxes in zip(lines, around, strict=True):
        for box in boxes:
            own[box] = own.get(box, 0) + n
        if n and region and boxes == regions[region]:
            filled.add(boxes)
    total = sum(n for _, _, n, *_ in lines)
    wrapping: set[int] = set()
    outer = {box: boxes[:i] for boxes in around for i, box in enumerate(boxes)}
    free = any(wrapping.issuperset(boxes) for boxes in filled)
    holding = {box for boxes in filled for box in boxes}
    while not free:
        level = [box for box, up in outer.items() if box not in wrapping and wrapping.issuperset(up)]
        more = [box for box in level if box in holding] if filled else [box for box in level if 2 * own[box] > total]
        if not more:
            break
        wrapping.update(more)
        free = any(wrapping.issuperset(boxes) for boxes in filled)
    return wrapping


def _content(lines: list[tuple[str, float, int, int, bool]]) -> list[str]:
    """Texts of the content among lines (text, ratio, letters outside links, region, heading)."""
    if not any(text for text, *_ in lines):
        return []
    smoothed = [math.log1p(v) for v in smooth([ratio for _, ratio, *_ in lines])]
    mark = threshold(smoothed)
    marked = [bool(text) and v >= mark and ratio > 0 for (text, ratio, *_), v in zip(lines, smoothed, strict=True)]
    chosen = {region for (*_, region, _), m in zip(lines, marked, strict=True) if m and region}
    inside = sum(own for (_, _, own, region, _), m in zip(lines, marked, strict=True) if m and region)
    if chosen and 2 * inside >= sum(own for (_, _, own, *_), m in zip(lines, marked, strict=True) if m):
        keep = [region in chosen and bool(text) and not heading and 2 * own > len(text) for text, _, own, region, heading in lines]
        following, passed = 0, 0
        for i in range(len(lines) - 1, -1, -1):
            text, _, _, region, heading = lines[i]
            if keep[i]:
                following, passed = region, 0
            elif text and heading and region in chosen and following == region and passed < 2:
                keep[i] = True
            elif text:  # one line of links, such as a name, may stand between
                passed += 1
        return [line[0] for line, k in zip(lines, keep, strict=True) if k]
    first = next((i for i, m in enumerate(marked) if m), 0)
    keep = list(marked)
    for i in range(len(lines) - 1, -1, -1):
        if lines[i][4] and lines[i][0] and any(keep[i + 1 : i + 3]):
            keep[i] = True
    last = max((i for i, m in enumerate(marked) if m), default=-1)
    for i in range(first, last):  # short paragraphs between two marked ones
        text, _, own, _, _ = lines[i]
        keep[i] = keep[i] or bool(text) and 2 * own > len(text)
    return [line[0] for line, k in zip(lines, keep, strict=True) if k]


def main_text(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep``, ``text`` and ``n_chars``. Narrow: a row needs nothing but itself."""
    keep = keep or [c for c in pages.columns if c != "html"]
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    head = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return map_batches(pages, [*keep, "html"], run, f"{head}, text string, n_chars bigint")
