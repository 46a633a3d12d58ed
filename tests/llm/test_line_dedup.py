import hashlib
import random

import brute
import numpy as np

from tessellum.llm import line_dedup
from tessellum.llm.queries import QUERIES


def table(frame):
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"], r["n_links"]) for r in line_dedup.dedup(frame).collect()}


def test_equals_brute_force(documents, rows):
    want = brute.line_dedup(rows)
    assert table(documents) == want
    assert sum(w[2] for w in want.values()) > 10 and sum(w[3] for w in want.values()) > 10


def test_query(spark, sf_dir, rows):
    want = {i: (n, gone, links, hashlib.sha256((t or "").encode()).hexdigest()) for i, (t, n, gone, links) in brute.line_dedup(rows).items()}
    got = QUERIES["op2_line_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_links"], r["text_sha256"]) for r in got} == want


def near_lines(n, seed):
    """Lines that differ by few words from each other, from other families, and not at all."""
    rng = random.Random(seed)
    families = [[f"f{k}w{i}" for i in range(rng.randrange(4, 14))] for k in range(6)]
    out = []
    for i in range(n):
        words = list(rng.choice(families))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(25)}"
        rng.shuffle(words)
        out.append((i, "\n".join([" ".join(words), f"own line {i} with a {i * 3} and b {i * 5}", "The same Line everywhere", ""])))
    return out


def test_hot_lines_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    docs = near_lines(250, 5)
    assert table(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)) == brute.line_dedup(docs)


def test_threshold_is_exact(spark):
    words = [f"t{i}" for i in range(10)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:8])), (3, " ".join(words[:7])), (4, " ".join(words[:9] + ["z"])), (5, " ".join(words[:8] + ["y1", "y2"]))]
    got = table(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert got == brute.line_dedup(docs)
    assert got[2][2] == 1 and got[5][2] == 1 and got[1][2] == 0


def test_edge_cases(spark, messy):
    got = line_dedup.dedup(messy).collect()
    assert len(got) == messy.count() and set(got[0].asDict()) == {*messy.columns, "n_lines", "n_removed", "n_links"}
    by = lambda i: sorted(("<null>" if r["text"] is None else r["text"], r["n_removed"]) for r in got if r["doc_id"] == i)
    assert by(1) == [("one two three four five six", 0)] and by(2) == [("", 1)]
    assert by(3) == [("", 0)] and by(4) == [("<null>", 0)] and by(5) == [(" \n\t ", 0)]
    assert by(None) == [("<null>", 0), ("one two three four five six", 0)]
    assert by(7) == [("", 1), ("another text under the same number", 0), ("x", 0)]
    assert line_dedup.dedup(messy.limit(0)).collect() == []
    long = next(r for r in messy.collect() if r["doc_id"] == 6)["text"]
    assert table(messy.where("doc_id = 6").select("doc_id", "text")) == brute.line_dedup([(6, long)])


def test_repeated_rows(spark):
    text = "one two three four five\n\nsix seven eight nine ten"
    docs = [(7, text), (7, text), (7, text), (8, "something else that is long enough"), (9, "one two three four five"), (7, "a text of its own")]
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect())
    assert got == [(7, "", 3, 2), (7, "", 3, 2), (7, "a text of its own", 1, 0), (7, text, 3, 0), (8, docs[3][1], 1, 0), (9, "", 1, 1)]


def test_bitmaps_of_likely_pairs_only(monkeypatch):
    """Lengths and positions rule out most pairs of a group first; the edges are those of all filters on every pair."""
    rng = np.random.default_rng(4)
    m = 60
    n, pos = rng.integers(4, 80, m), np.zeros(m, np.int64)
    bits, bits2 = (rng.integers(0, 4, m).astype(np.uint64) for _ in range(2))
    whole = line_dedup.least_overlap
    asked = []
    monkeypatch.setattr(line_dedup, "least_overlap", lambda a, b: (asked.append(np.size(a)), whole(a, b))[1])
    none = np.zeros(m, np.int8)
    found = line_dedup.meet({"id": np.arange(m), "n": n, "pos": pos, "bits": bits, "bits2": bits2}, np.array([0]), np.array([m]), none, none.view(bool))
    want, short = set(), 0
    for i in range(m):
        for j in range(i + 1, m):
            least = int(whole(n[i], n[j]))
            differ = int(bits[i] ^ bits[j]).bit_count() + int(bits2[i] ^ bits2[j]).bit_count()
            if min(n[i], n[j]) >= least:
                short += 1
                if n[i] + n[j] - differ >= 2 * least:
                    want.add((i, j))
    assert set(zip(found.column("a").to_pylist(), found.column("b").to_pylist(), strict=True)) == want and want
    assert sum(asked) == short < m * (m - 1) / 4
