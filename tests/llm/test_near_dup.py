import random

import brute
import numpy as np
import pytest

from tessellum.llm import _similar, near_dup
from tessellum.llm.queries import QUERIES


@pytest.mark.parametrize("width", [2, 5])
def test_equals_brute_force(spark, documents, rows, width):
    groups, sizes = brute.near_groups(rows, width)
    got = near_dup.near_duplicates(documents, width=width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (sizes[i], groups[i], i == groups[i]) for i, _ in rows}
    assert len(set(groups.values())) < len(rows)


def test_query(spark, sf_dir, rows):
    groups, sizes = brute.near_groups(rows, 2)
    assert sorted(tuple(r) for r in QUERIES["op9_near_duplicates"](spark, sf_dir).select("doc_id", "n_shingles", "component_id", "kept").collect()) == sorted((i, sizes[i], groups[i], i == groups[i]) for i, _ in rows)


def test_large_group_in_small_blocks(spark, monkeypatch):
    """A group of near copies far beyond a block, and a chain whose ends are not alike themselves."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(150):
        words = list(base)
        words[rng.randrange(60)] = f"v{i % 40}"
        docs.append((1000 - i, " ".join(words)))
    chain = [f"c{i}" for i in range(40)]
    docs += [(2000 + k, " ".join(chain[k:] + [f"d{j}" for j in range(k)])) for k in range(12)]
    docs += [(3000 + k, " ".join(f"u{k}x{j}" for j in range(30))) for k in range(50)]
    rng.shuffle(docs)
    groups, _ = brute.near_groups(docs, 2)
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7), width=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == groups
    assert len({groups[2000 + k] for k in range(12)}) == 1 and groups[1000] == 851


def test_threshold_is_exact(spark):
    """Eight shingles of ten in common are linked; a little less is not."""
    words = [f"t{i}" for i in range(10)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:9])), (3, " ".join(words[:8])), (4, " ".join(words[:8]) + " q0 q1")]
    groups, _ = brute.near_groups(docs, 2)
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), width=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == groups


def test_edge_cases(spark, messy):
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(messy, width=2).collect()), key=str)
    assert got == sorted(
        [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True), (7, 7, True), (7, 7, True), (8, 8, True), (None, None, None), (None, None, None)], key=str
    )
    assert near_dup.near_duplicates(messy.limit(0)).collect() == []


def test_components(spark):
    """Chains, hubs and repeated edges."""
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, 1000 + i) for i in range(1, 500)] + [(5, 4), (2000, 2001), (2000, 2001)]
    random.Random(1).shuffle(edges)
    got = {r["id"]: r["component"] for r in _similar.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(9)).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 1000 for i in range(1000, 1500)} | {2000: 2000, 2001: 2000}
    assert _similar.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_probes_meet_the_pigeonhole_bound():
    """Any signatures with at most chunks * (errors + 1) - 1 differing places share a key."""
    rng = np.random.default_rng(0)
    n = near_dup.CHUNKS * near_dup.SLOTS
    for _ in range(200):
        a = rng.integers(0, 65536, n).astype(np.uint16)
        b = a.copy()
        at = rng.choice(n, near_dup.CHUNKS * (near_dup.ERRORS + 1) - 1, replace=False)
        b[at] ^= 1
        keys = near_dup.probe_keys(np.stack([a, b]))
        assert set(keys[0]) & set(keys[1])


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50))) for _ in range(30)]
    got = _similar.overlaps(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    assert [[len(set(a) & set(b)) for b in sets] for a in sets] == got.tolist()


def test_pairs_at_the_threshold_are_not_lost():
    """Pairs of sets with a similarity of exactly 0.8 share a key and pass the filter of slots."""
    rng, by, lost, total = np.random.default_rng(6), near_dup._multipliers(), 0, 100_000
    for _ in range(total // 2000):
        x = rng.integers(0, 2**64, (2000, 100), dtype=np.uint64)  # 80 in common, 10 of each alone
        sigs = []
        for part in (np.r_[0:80, 80:90], np.r_[0:80, 90:100]):
            least = np.stack([(x[:, part] * m).min(axis=1) for m in by], axis=1)
            sigs.append((near_dup.mix(least) >> np.uint64(48)).astype(np.uint16))
        shared = (near_dup.probe_keys(sigs[0]) == near_dup.probe_keys(sigs[1])).any(axis=1)
        f, g = (near_dup.pack_filter(s).view(np.uint64) for s in sigs)
        near = near_dup.slot_errors(f[:, 0], g[:, 0]) + near_dup.slot_errors(f[:, 1], g[:, 1]) <= near_dup.FILTER_ERRORS
        lost += int((~(shared & near)).sum())
    assert lost == 0


def test_rows_that_share_an_id_are_one_document(spark):
    a, c, d = "one two three four five six", "a text of its own that nothing resembles", "still another text which stands alone"
    docs = [(5, a), (9, a), (9, c), (12, c), (20, d), (20, c), (30, "quite alone here with some words")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), width=2).collect()}
    assert got == {(5, 5, True), (9, 5, False), (12, 5, False), (20, 5, False), (30, 30, True)}
