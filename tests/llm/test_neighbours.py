import math

import numpy as np
import pytest

from umbra.llm.neighbours import Tree, cell_of, chi_square_quantile, kd_splits, nearest


def brute(rows, every, k):
    out = {}
    rows = [(i, np.array(v, float)) for i, v in sorted({(i, tuple(v)) for i, v in rows})]
    for q, (i, v) in enumerate(rows):
        if i % every == 0:
            s = sorted(((-float((v * w).sum()), j) for p, (j, w) in enumerate(rows) if p != q))[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


def got(df, **kw):
    out = {}
    for r in sorted(nearest(df, **kw).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("cell_rows", [1 << 16, 300])
def test_recall_and_scores(spark, cell_rows):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(10, 24))
    data = centres[rng.integers(0, 10, 3000)] + 0.5 * rng.normal(size=(3000, 24))
    data *= rng.uniform(0.5, 1.5, (3000, 1))
    rows = [(i, data[i].astype("f4").tolist()) for i in range(3000)]
    want, have = brute(rows, 20, 20), got(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), cell_rows=cell_rows)
    assert want.keys() == have.keys() and all(len(x) == 20 for x in have.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in have[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q in list(want)[:20]:
        exact = {i: float((data[q].astype("f4").astype(float) * data[i].astype("f4").astype(float)).sum()) for i, _ in have[q]}
        assert all(math.isclose(s, exact[i], rel_tol=1e-12) for i, s in have[q])


def test_stop_without_clusters(spark):
    """Directions without any structure: the stop still passes over more than half of the vectors."""
    rng = np.random.default_rng(7)
    data = rng.normal(size=(12_000, 64))
    data /= np.linalg.norm(data, axis=1)[:, None]
    stats: dict = {}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "vec_id long, embedding array<double>")
    have = got(df, query_every=60, cell_rows=1500, stats=stats)
    scores = data[::60] @ data.T
    scores[np.arange(200), np.arange(0, 12_000, 60)] = -9
    best = np.argsort(-scores, axis=1)[:, :20]
    assert sum(len({i for i, _ in have[60 * q]} & set(best[q].tolist())) for q in range(200)) >= 0.9 * 20 * 200
    assert stats["cells"] == 8 and stats["queries"] == 200 and stats["verified"] < 0.5


@pytest.mark.parametrize("cell_rows", [1 << 16, 20])
def test_ties_copies_and_bad_rows(spark, cell_rows):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 200)]  # a large group of copies
    rows += [(200 + i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(100)]
    rows = [r for r in rows if any(r[1])]
    bad = [(400, None), (420, [0.0, 0.0, 0.0]), (440, [1.0, None, 2.0]), (460, [1.0, float("nan"), 2.0]), (480, [float("inf"), 1.0, 1.0]), (500, [1.0]), (None, [1.0, 1.0, 1.0]), (520, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad + rows[:3]], "vec_id long, embedding array<double>, g string, score int")
    want = brute(rows, 20, 20)
    assert got(df, confidence=0.999999, cell_rows=cell_rows) == want


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    assert got(spark.createDataFrame([], schema)) == {}
    assert got(spark.createDataFrame([(0, None)], schema)) == {}
    assert got(spark.createDataFrame([(0, [1.0])], schema)) == {}
    assert got(spark.createDataFrame([(0, [1.0]), (3, [2.0]), (20, [-1.0])], schema)) == {0: [(3, 2.0), (20, -1.0)], 20: [(0, -1.0), (3, -2.0)]}


def test_parts():
    assert math.isclose(chi_square_quantile(0.95, 6), 12.5916, rel_tol=1e-4)
    points = np.random.default_rng(3).normal(size=(1000, 4))
    cells = cell_of(points, kd_splits(points, 8))
    assert sorted(set(cells)) == list(range(8)) and max(np.bincount(cells)) <= 130
    tree = Tree(points, 16)
    d = tree.distances(np.zeros(4))
    for (a, b), x in zip(tree.bounds, d):
        assert (points[tree.order[a:b]] ** 2).sum(1).min() >= x - 1e-12
