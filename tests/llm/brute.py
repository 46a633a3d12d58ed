"""Plain references for the operators: every pair, every place, no index."""

import re
from collections import defaultdict

_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def shingles(text, width):
    words = _SPLIT.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


def similar(a, b):
    both = len(a & b)
    return both > 0 and 100 * both >= 80 * len(a | b)


def near_groups(docs, width):
    """doc_id to the smallest doc_id of its component, and to the size of its set. ``docs``: (doc_id, text)."""
    sets = [(i, shingles(t, width)) for i, t in docs]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 0.8 * len(a) <= len(b) / 0.999 and 0.8 * len(b) <= len(a) / 0.999 and similar(a, b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}, {i: len(s) for i, s in sets}


def line_dedup(docs):
    """doc_id to (text, lines, removed, links) for distinct ids in ascending order."""
    lines = [(i, k, line) for i, t in sorted(docs, key=lambda d: d[0]) if t for k, line in enumerate(t.split("\n"))]
    sets = [frozenset(_SPLIT.findall(lower(line))) for *_, line in lines]
    classes = sorted({s for s in sets if s}, key=sorted)
    at, links, index = {}, defaultdict(set), defaultdict(list)
    for c, s in enumerate(classes):
        for w in s:
            index[w].append(c)
    for c, s in enumerate(classes):
        shared = defaultdict(int)
        for w in s:
            for d in index[w]:
                shared[d] += 1
        links[c] = {d for d, n in shared.items() if d != c and 100 * n >= 80 * (len(s) + len(classes[d]) - n)}
    number = {s: c for c, s in enumerate(classes)}
    gone, found = defaultdict(set), defaultdict(int)
    for (i, k, _), s in zip(lines, sets, strict=True):
        if not s:
            continue
        c = number[s]
        found[i] += len(links[c])
        if c in at or any(d in at for d in links[c]):
            gone[i].add(k)
        at.setdefault(c, (i, k))
    out = {}
    for i, t in docs:
        parts = t.split("\n") if t else []
        kept = [p for k, p in enumerate(parts) if k not in gone[i]]
        if gone[i] and not any(p.strip() for p in kept):
            kept = []
        out[i] = (None if t is None else "\n".join(kept), len(parts), len(gone[i]), found[i])
    return out


def substring_edits(pattern, text):
    """Least edits of ``pattern`` against any substring of ``text``, by the full table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def leaks(docs, items, edits, distance):
    """(doc_id, item_id) of items that occur within their share of edits; ``distance(pattern, text)`` gives the least edits."""
    out = set()
    texts = [(d, " ".join((t or "").lower().split())) for d, t in docs]
    for item, text in items:
        words = (text or "").lower().split()
        if not words:
            continue
        flat = " ".join(words)
        for d, t in texts:
            if len(words) <= 3 and len(flat) < 20:
                if f" {flat} " in f" {t} ":
                    out.add((d, item))
            elif len(t) >= len(flat) * (1 - edits) and distance(flat, t) <= int(len(flat) * edits):
                out.add((d, item))
    return out
