import math

import numpy as np
import pytest

from umbra.llm.ball_tree import Forest
from umbra.llm.hard_negatives import mine

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50, positives=5, negatives=3):
    rows = [(i, tuple(math.floor(256 * x) for x in v), y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    rows = sorted(set(rows))
    out = []
    for a in rows:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[1], r[1])), r[0], r[2] == a[2]) for r in rows if r != a)
        for ps, p, same in [s for s in scored if s[2]][:positives]:
            hits = [(ns, n) for ns, n, same in scored if not same and 50 * -ps <= 100 * -ns <= 95 * -ps][:negatives]
            out += [(a[0], p, k, n, -ps, -ns) for k, (ns, n) in enumerate(hits, 1)]
    return sorted(out)


def got(df, **kw):
    return sorted(tuple(r) for r in mine(df, **kw).collect())


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))
    return [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, rng.integers(0, 4, n)))]


@pytest.mark.parametrize("cell_rows", [1 << 16, 150])
def test_equals_brute_force(spark, cell_rows):
    rows = clustered(1200, 12, 3)
    stats: dict = {}
    assert got(spark.createDataFrame(rows, SCHEMA), cell_rows=cell_rows, stats=stats) == brute(rows)
    assert stats["scored"] < 2 * 24 * 1200 and (stats["cells"] > 1) == (cell_rows == 150)


def test_the_trees_pass_over_most_rows():
    """Clusters: a window's answers come out of few leaves, and are those of a plain scan."""
    rng = np.random.default_rng(5)
    x = np.round(60 * (rng.normal(size=(60, 8))[rng.integers(0, 60, 6000)] + 0.05 * rng.normal(size=(6000, 8))))
    labels = rng.integers(0, 3, 6000)
    forest = Forest(labels, x)
    ids, total = forest.order, 0
    for q in range(0, 6000, 300):
        s = x @ x[q]
        top = int(np.sort(s[labels == labels[q]])[-2])
        low, high = math.ceil(top / 2), math.floor(0.95 * top)
        ((places, scores),), scored = forest.search(ids, x[q], labels[q], False, [low], [high], [low], 3)
        total += scored
        want = sorted((-s[i], i) for i in range(6000) if labels[i] != labels[q] and low <= s[i] <= high)[:3]
        assert [(-a, b) for a, b in zip(scores, ids[places])] == want
    assert total < 0.35 * 20 * 6000


@pytest.mark.parametrize("cell_rows", [1 << 16, 20])
def test_ties_copies_and_odd_rows(spark, cell_rows):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 4).tolist(), int(rng.integers(0, 2))) for i in range(90)]
    rows += [(100 + i, [1.0, 1.0, 1.0, 1.0], 1) for i in range(60)]  # one vector many times, anchors among them
    rows += [(200 + i, [1.0, 1.0, 1.0, 0.0], 0) for i in range(60)]
    rows += rows[:20]  # repeated rows
    rows += [(50, [2.0, 0.0, 1.0, 1.0], 0), (None, [1.0] * 4, 1), (300, None, 1), (301, [1.0, None, 1.0, 1.0], 0), (302, [1.0] * 4, None)]
    rows += [(350, [float("nan"), 1.0, 1.0, 1.0], 0), (400, [float("inf"), 1.0, 1.0, 1.0], 0), (450, [0.0] * 4, 1), (500, [-1.0, -0.001, 0.5, 0.3], 5)]
    want = brute([(i, None if v is None else [None if x is None else float(x) for x in v], y) for i, v, y in rows])
    odd = [(600, [1.0], 1), (650, [], 1)]  # of another length
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], y, 0, 0, 0) for i, v, y in rows + odd]
    df = spark.createDataFrame(rows, SCHEMA + ", g int, cell int, ids int")  # clashing names
    assert got(df, cell_rows=cell_rows) == want
    assert got(df.limit(0)) == []


def test_beyond_doubles(spark):
    """Scores over 2^53 come out as whole numbers."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.integers(1, 1 << 22, 3) + 0.5).tolist(), i % 2) for i in range(120)]
    assert got(spark.createDataFrame(rows, SCHEMA), cell_rows=40) == brute(rows)
