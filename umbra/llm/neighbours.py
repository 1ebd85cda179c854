"""Nearest neighbours by inner product: stable projections, kd-trees, a chi-square stop.

Largest inner product becomes smallest distance by one more coordinate: with M the
largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (M q / |q|, 0) give |q' - x'|^2 =
2 M (M - q.x / |q|).  Vectors are projected on ``projections`` Gaussian directions
(made orthogonal, which only narrows the spread); for a point at distance r the squared
projected distance over r^2 is chi-square distributed.  A point can be among the k best
only as long as chi-square(d^2 / r_k^2) is under ``confidence``: d its projected
distance, r_k the distance of the k-th best so far.

The projections are cut by a kd-tree over a bounded sample into cells.  A query starts
in its own cell, goes on with the nearest quarter of the others, then with the rest;
with the r_k found so far the test on the distance to a cell's box says which cells it
visits.  In a cell it takes the leaves of a kd-tree by growing distance and verifies
the points that pass the test by the exact inner product, until no leaf passes.  Cells
are bounded, and the queries that visit one are dealt out in bounded groups.

Equal vectors have equal answers: they are one candidate with its ``k + 1`` smallest
ids (no more can be in a result, as ties go to the smaller id), and one query.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.common import cut, inputs

LEAF = 128
#: Queries that meet a cell in one task, bytes of a cell's vectors, and what a cell has at least while there are fewer cells than tasks.
QUERY_CHUNK, CELL_BYTES, LEAST_ROWS = 8192, 32 << 20, 2048
SEED = 20
#: Rows that the cells' borders are taken from: so many, or so many a cell.
SAMPLE_ROWS, SAMPLE_PER_CELL = 20_000, 16


def chi_square_quantile(p: float, degrees: int) -> float:
    """x with chi-square CDF p, for even degrees (closed form and bisection)."""
    if degrees % 2 or not 0 < p < 1:
        raise ValueError("degrees must be even and p between 0 and 1")

    def cdf(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def kd_splits(points, parts: int):
    """Median splits of the widest dimension, breadth first: [(dimension, value)] for about ``parts`` cells."""
    import numpy as np

    depth = max(0, math.ceil(math.log2(max(parts, 1))))
    splits, level = [], [np.arange(len(points))]
    for _ in range(depth):
        following = []
        for rows in level:
            if len(rows) == 0:
                dim, value = 0, 0.0
            else:
                own = points[rows]
                dim = int(np.argmax(own.max(0) - own.min(0)))
                value = float(np.median(own[:, dim]))
            splits.append((dim, value))
            right = points[rows, dim] > value if len(rows) else np.zeros(0, bool)
            following += [rows[~right], rows[right]]
        level = following
    return splits


def cell_of(points, splits):
    import numpy as np

    node = np.zeros(len(points), dtype=np.int64)
    while splits and len(node) and node[0] < len(splits):  # all rows are on one level
        dims = np.array([d for d, _ in splits])[node]
        values = np.array([v for _, v in splits])[node]
        node = 2 * node + 1 + (points[np.arange(len(points)), dims] > values)
    return node - len(splits)


class Tree:
    """A kd-tree whose leaves are slices of one order of the rows, with tight boxes."""

    def __init__(self, points, leaf: int = LEAF):
        import numpy as np

        order = np.arange(len(points))
        bounds, todo = [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                bounds.append((a, b))
                continue
            own = points[order[a:b]]
            dim = int(np.argmax(own.max(0) - own.min(0)))
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, dim], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        self.order, self.bounds = order, bounds
        self.low = np.array([points[order[a:b]].min(0) for a, b in bounds])
        self.high = np.array([points[order[a:b]].max(0) for a, b in bounds])

    def distances(self, q):
        return box_distances(q, self.low, self.high)


def box_distances(q, low, high):
    """Squared distances of a point to boxes."""
    import numpy as np

    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return (gap * gap).sum(axis=1)


def search_block(ids, vectors, points, q_vectors, q_points, q_best, k: int, top: float, stop: float):
    """For each query up to ``k`` (place, score) of a block, best first, ties to smaller ids; and how many were verified.

    q_best: scores of the k-th best that each query already has elsewhere, or -inf.
    """
    import numpy as np

    tree = Tree(points)
    order = tree.order
    ids, vectors, points = ids[order], vectors[order], points[order]
    leaf_of = np.empty(len(order), dtype=np.int64)
    for leaf, (a, b) in enumerate(tree.bounds):
        leaf_of[a:b] = leaf
    out, verified = [], 0
    for q, p, best in zip(q_vectors, q_points, q_best):
        d = tree.distances(p)
        norm = math.sqrt(float((q * q).sum()))
        reach = lambda kth: np.inf if kth == -np.inf else stop * max(2 * top * (top - kth / norm), 0.0)
        ranks = np.empty(len(d), dtype=np.int64)
        ranks[np.argsort(d, kind="stable")] = np.arange(len(d))
        found_s, found_at, kth, first, step = np.zeros(0), np.zeros(0, dtype=np.int64), best, 0, 1
        while first < len(d):
            # the next leaves, twice as many each time
            leaves = (ranks >= first) & (ranks < first + step) & (d < reach(kth))
            first, step = first + step, 2 * step
            at = np.flatnonzero(leaves[leaf_of])
            if not len(at):
                continue
            gap = points[at] - p
            at = at[(gap * gap).sum(axis=1) < reach(kth)]
            s = (vectors[at] * q).sum(axis=1)  # a row's sum does not depend on its place
            verified += len(at)
            hit = s >= kth
            found_s, found_at = np.concatenate([found_s, s[hit]]), np.concatenate([found_at, at[hit]])
            if len(found_s) >= k:
                keep = np.lexsort((ids[found_at], -found_s))[:k]
                found_s, found_at = found_s[keep], found_at[keep]
                kth = max(kth, found_s[-1])
        keep = np.lexsort((ids[found_at], -found_s))
        out.append((order[found_at[keep]], found_s[keep]))
    return out, verified


def nearest(
    df: DataFrame,
    query_every: int = 20,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    projections: int = 16,
    confidence: float = 0.85,
    cell_rows: int | None = None,
    stats: dict | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``query_every``
    its ``k`` nearest found among all other rows, largest inner product first, ties to the
    smaller id; fewer if there are fewer.

    Null, empty and zero vectors, vectors with null or non-finite components, of another
    length than the most frequent (the smaller of two as frequent) and rows without an id
    take no part.  Rows that repeat both id and vector count once; one id with several
    vectors is several candidates, and a query for each, which together give its k best.
    An empty table gives no rows.
    """
    import numpy as np

    spark = df.sparkSession
    v = F.col("v")
    rows = inputs(df, id=(id_col, "long"), v=(vector_col, "array<double>")).where(
        "id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    )
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths[0].n
    rows = rows.where(F.size("v") == dim)
    few = rows.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= k + 1)
    groups = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    groups = cut(groups.select(F.xxhash64("v").alias("h"), "v", F.col("ids")[0].alias("gid"), "ids"))
    # One id may stand in several groups: a group is known by its vector's hash and smallest id.
    groups = groups.withColumn("g", F.monotonically_increasing_id())
    groups = cut(groups)
    sizes = groups.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m"), F.count("*").alias("n")).first()
    top, n = math.sqrt(sizes.m), sizes.n
    stop = chi_square_quantile(confidence, projections)
    matrix = np.random.default_rng(SEED).standard_normal((dim + 1, projections))
    if projections <= dim:
        matrix = np.linalg.qr(matrix)[0] * math.sqrt(dim + 1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block_rows = cell_rows or min(max(CELL_BYTES // (8 * (dim + projections)), 1), max(LEAST_ROWS, n // parts))

    def project(vectors, query: bool):
        norms = (vectors * vectors).sum(axis=1)
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(top * top - norms, 0))
        return np.column_stack([vectors * (top / np.sqrt(norms))[:, None] if query else vectors, rest]) @ matrix

    def packed(query: bool, splits):
        def run(iterator):
            import pyarrow as pa

            for batch in iterator:
                vectors = np.asarray(batch.column(batch.schema.get_field_index("v")).flatten()).reshape(-1, dim)
                points = project(vectors, query)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(batch.schema.get_field_index(c)) for c in ("g", "gid")),
                        pa.array([x.tobytes() for x in vectors], pa.binary()),
                        pa.array([x.tobytes() for x in points], pa.binary()),
                        pa.array(cell_of(points, splits), pa.int64()),
                    ],
                    ["g", "gid", "v", "p", "cell"],
                )

        return run

    schema = "g long, gid long, v binary, p binary, cell long"
    splits: list[tuple[int, float]] = []
    cells = math.ceil(n / block_rows)
    if cells > 1:
        size = max(SAMPLE_ROWS, SAMPLE_PER_CELL * cells)
        sample = groups.select("g", "gid", "v").orderBy(F.xxhash64("g")).limit(size).mapInArrow(packed(False, []), schema).select("p").collect()
        splits = kd_splits(np.stack([np.frombuffer(r.p) for r in sample]), cells)
    data = cut(groups.select("g", "gid", "v").mapInArrow(packed(False, splits), schema))
    # One row a cell; a cell whose projections are all alike can be larger than the tree meant: it has several parts.
    counts = data.groupBy("cell").agg(F.count("*").alias("c")).withColumn("subs", F.ceil(F.col("c") / (4 * block_rows)).cast("long"))
    counts = cut(counts)
    data = data.join(F.broadcast(counts.select("cell", "subs")), "cell").withColumn("sub", F.pmod(F.xxhash64("g"), F.col("subs")))

    asked = rows.where(F.col("id") % query_every == 0).distinct().withColumn("h", F.xxhash64("v"))
    asked = cut(asked.join(groups.select("h", "v", "g"), ["h", "v"]).select("id", "g"))
    queries = cut(groups.select("g", "gid", "v").join(asked.select("g").distinct(), "g").mapInArrow(packed(True, splits), schema))
    names, low, high = _boxes(data, projections)

    def going(turn: int):
        """Where each query goes in a turn: its own cell, the nearest quarter of the others, the rest."""

        def run(iterator):
            import pyarrow as pa

            for batch in iterator:
                cols = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
                at, to = [], []
                for i, (q, p, best, home) in enumerate(zip(cols["v"].to_pylist(), cols["p"].to_pylist(), cols["best"].to_pylist(), cols["cell"].to_pylist())):
                    q, d = np.frombuffer(q), box_distances(np.frombuffer(p), low, high)
                    d[names == home] = -1.0
                    ranks = np.empty(len(d), dtype=np.int64)
                    ranks[np.argsort(d, kind="stable")] = np.arange(len(d))
                    quarter = 1 + (len(d) + 2) // 4
                    mine = ranks == 0 if turn == 0 else (ranks > 0) & ((ranks <= quarter) if turn == 1 else (ranks > quarter))
                    reach = math.inf if best == -math.inf else stop * max(2 * top * (top - best / math.sqrt(float((q * q).sum()))), 0.0)
                    cells = names[mine & (d < reach)]
                    at += [i] * len(cells)
                    to += cells.tolist()
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([cols["g"].take(at), cols["v"].take(at), cols["p"].take(at), pa.array(to, pa.int64()), cols["best"].take(at)], ["g", "v", "p", "cell", "best"])

        return run

    found = None
    for turn in range(3 if len(names) > 1 else 1):
        if found is None:
            known = queries.withColumn("best", F.lit(float("-inf")))
        else:
            merged = found.groupBy("g").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k + 1).alias("s"))  # k + 1 of each cell visited
            best = merged.select("g", F.when(F.size("s") > k, F.col("s")[k]).otherwise(F.lit(float("-inf"))).alias("best"))
            known = queries.join(best, "g", "left").withColumn("best", F.coalesce("best", F.lit(float("-inf"))))
        visits = known.select("g", "v", "p", "cell", "best").mapInArrow(going(turn), "g long, v binary, p binary, cell long, best double")
        new = cut(_visit(cut(visits), data, counts, k + 1, top, stop))
        found = new if found is None else found.union(new)
    if stats is not None:
        asked_n, verified = queries.count(), found.agg(F.sum("verified")).first()[0] or 0
        stats |= {"vectors": n, "queries": asked_n, "cells": len(names), "verified": verified / max(asked_n * n, 1)}
    order = Window.partitionBy("g").orderBy(F.desc("score"), "vec_id")
    # The k + 1 best ids of each query vector, then of each query those that aren't its own row.
    answers = (
        found.join(groups.select(F.col("g").alias("found"), "ids"), "found")
        .select("g", "found", "score", F.explode("ids").alias("vec_id"))
        .withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= k + 1)
    )
    ranked = asked.withColumnRenamed("id", "query_id").join(answers, "g").where("not (vec_id = query_id and found = g)")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _boxes(data: DataFrame, projections: int):
    """The cells' names and projected boxes: one row a cell reaches the driver."""
    import numpy as np

    def run(iterator):
        import pyarrow as pa

        low, high = {}, {}
        for batch in iterator:
            points = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(batch.num_rows, -1)
            cells = batch.column(0).to_numpy()
            for c in np.unique(cells):
                own = points[cells == c]
                low[c] = np.minimum(low.get(c, np.inf), own.min(0))
                high[c] = np.maximum(high.get(c, -np.inf), own.max(0))
        sides = [pa.array([x.tolist() for x in side.values()], pa.list_(pa.float64())) for side in (low, high)]
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int64()), *sides], ["cell", "low", "high"])

    found = data.select("cell", "p").mapInArrow(run, "cell long, low array<double>, high array<double>")
    rows = found.groupBy("cell").agg(
        F.array(*(F.min(F.col("low")[i]) for i in range(projections))).alias("low"), F.array(*(F.max(F.col("high")[i]) for i in range(projections))).alias("high")
    ).collect()
    side = lambda name: np.array([r[name] for r in rows]).reshape(-1, projections)
    return np.array([r["cell"] for r in rows]), side("low"), side("high")


def _visit(queries: DataFrame, data: DataFrame, counts: DataFrame, k: int, top: float, stop: float) -> DataFrame:
    """(g, found, score, verified): the best ``k`` of each cell part for each query that visits it.

    QUERY_CHUNK queries meet a part at a time; ``verified`` is on one row of a meeting
    the number of its exact inner products, else 0.
    """
    chunks = cut(queries.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_CHUNK).cast("long").alias("chunks")))  # one row a cell
    queries = queries.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64("g"), F.col("chunks")))
    queries = queries.join(F.broadcast(counts.select("cell", "subs")), "cell").withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)))
    data = data.join(F.broadcast(chunks), "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))

    def run(q, x):
        import numpy as np
        import pandas as pd

        if not len(q) or not len(x):
            return pd.DataFrame({"g": [], "found": [], "score": [], "verified": []})
        rows = lambda column: np.frombuffer(b"".join(column)).reshape(len(column), -1)
        best, verified = search_block(x["gid"].to_numpy(), rows(x["v"]), rows(x["p"]), rows(q["v"]), rows(q["p"]), q["best"].to_numpy(), k, top, stop)
        names = x["g"].to_numpy()
        out = pd.DataFrame(
            {"g": np.repeat(q["g"].to_numpy(), [len(i) for i, _ in best]), "found": np.concatenate([names[i] for i, _ in best]), "score": np.concatenate([s for _, s in best])}
        )
        out["verified"] = np.where(np.arange(len(out)) == 0, verified, 0)
        return out

    keys = ["cell", "sub", "chunk"]
    q = queries.select(*keys, "g", "v", "p", "best").groupBy(*keys)
    x = data.select(*keys, "g", "gid", "v", "p").groupBy(*keys)
    return q.cogroup(x).applyInPandas(run, "g long, found long, score double, verified long")
