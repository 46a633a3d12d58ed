import math

import numpy as np
import pyarrow as pa
import pytest

from tessellum.llm import hilbert
from tessellum.llm.queries import QUERIES


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (5, 2)])
def test_curve_visits_each_cell_once_and_steps_to_a_neighbour(dims, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(side**dims))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def usable(rows):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    return np.array([i for i, _ in good]), np.stack([v for _, v in good])


def brute(ids, x, k):
    out = {}
    for q in sorted({i for i in ids.tolist() if i % 20 == 0}):
        s = x @ x[np.flatnonzero(ids == q)[0]]
        best = [(-a, b) for a, b in zip(s.tolist(), ids.tolist()) if b != q]
        out[q] = sorted(best)[:k]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    path = f"/root/testdata/{sf}"
    ids, x = usable([(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()])
    want, got = brute(ids, x, 20), {}
    vector = dict(zip(ids.tolist(), x))
    for r in QUERIES["op3_hilbert_neighbours"](spark, path).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
        assert math.isclose(r["score"], float(vector[r["query_id"]] @ vector[r["vec_id"]]), rel_tol=1e-12, abs_tol=1e-12)
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        assert [r["rank"] for r in rows] == list(range(1, 21)) and len({r["vec_id"] for r in rows}) == 20 and q not in {r["vec_id"] for r in rows}
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        hits += len({r["vec_id"] for r in rows} & {i for _, i in want[q]})
    assert hits >= 0.95 * 20 * len(want)


def test_recall_with_a_hot_vector_and_small_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    x[:1000] = x[0]  # a third of all rows
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in hilbert.search(rows, block=128).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(np.arange(3000), x, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert [v for _, v, _ in sorted(got[0])] == list(range(1, 21))  # ties go to the smaller ids
    hits = sum(len({v for _, v, _ in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_a_query_meets_as_many_rows_at_any_size():
    block = 64
    for n in (1000, 20_000):
        rng = np.random.default_rng(n)
        codes, asked = rng.normal(size=(n, 8)).astype(np.float32), np.arange(n) % 20 == 0
        q, c, s = hilbert.windows(codes, asked, np.arange(n), block, 10**9, 0, -(-n // block))
        met = np.bincount(q, minlength=n)[asked]
        assert met.max() == 3 * block and set(q.tolist()) == set(np.flatnonzero(asked).tolist())
        assert np.allclose(s, (codes[q] * codes[c]).sum(axis=1), atol=1e-4)


def test_many_ranges_and_runs_of_windows(spark):
    """Ranges far smaller than the table, each in several runs: every query still gets its neighbours."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8)).repeat(15, axis=0) + 0.02 * rng.normal(size=(3000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)  # else long vectors elsewhere would be nearer than those beside a query
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    want, got = brute(np.arange(3000), x, 10), {}
    for r in hilbert.search(rows, k=10, curves=8, dims=4, bits=4, block=16, range_rows=1000).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[q] & {i for _, i in want[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_recall_at_fifty_thousand(spark):
    """Directions that are nearly noise, the hardest case: the nearest of 51,000 are little nearer than the rest."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(51_000, 64)) + rng.normal(size=(10, 64))[rng.integers(0, 10, 51_000)] * 0.3
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))})).repartition(8)
    got = {}
    for r in hilbert.search(rows, every=500).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    near = {q: set(np.argsort(-np.where(np.arange(len(x)) == q, -9, x @ x[q]))[:20].tolist()) for q in range(0, len(x), 500)}
    assert set(got) == set(near) and sum(len(got[q] & near[q]) for q in near) >= 0.9 * 20 * len(near)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [1.0, 0.0], "a", 9), (20, [0.0, 1.0], "a", 9), (1, [1.0, 1.0], "a", 9), (2, [1.0, 1.0], None, 9), (2, [1.0, 1.0], None, 9), (3, None, "a", 9), (4, [], "a", 9),
        (5, [0.0, 0.0], "a", 9), (6, [nan, 1.0], "a", 9), (7, [inf, 1.0], "a", 9), (8, [None, 1.0], "a", 9), (None, [1.0, 1.0], "a", 9), (40, [0.0, 0.0], "a", 9), (60, [1.0, 2.0, 3.0], "a", 9),
    ]
    rows = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, id string, cell int")
    got = sorted(tuple(r) for r in hilbert.search(rows).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 0, 0.0)]
    assert hilbert.search(rows.limit(0)).collect() == []
    assert hilbert.search(rows.where("vec_id = 5")).collect() == []
