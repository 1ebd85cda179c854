"""Hard negatives for contrastive training: rows of other labels, near an anchor but not too near.

Ball-tree branch and bound.  Vectors are dealt to cells of bounded size along a kd-tree
over a bounded sample; each cell is searched through ball trees of its own (see
``ball_tree``).  An anchor's positives come first: from its own cell, then from those
cells whose ball can still hold a row at least as good as its k-th.  Each positive's
score opens a window for negatives, and the same two turns search all windows of an
anchor at once.  A pass of a cell takes anchors in bounded groups; only their best rows
leave it.

Scores are inner products of whole numbers, exact as doubles while dimension times the
largest square stays under 2^53, beyond that as 64-bit integers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.ball_tree import Forest
from umbra.llm.common import cut, inputs, join_per_key
from umbra.llm.neighbours import cell_of, kd_splits

POSITIVES, NEGATIVES = 5, 3
#: A negative's score in percent of the positive's, at least and at most.
FROM, TO = 50, 95
#: Bytes of a cell's vectors, and rows that a cell has at least while there are fewer cells than tasks.
CELL_BYTES, LEAST_ROWS = 16 << 20, 2048
#: Anchors that meet a cell in one task.
ANCHOR_CHUNK = 4096
#: Bytes of the vectors, by hash, that the cells' borders are taken from.
SAMPLE_BYTES = 16 << 20
#: Beyond any score.
TOP = (1 << 63) - 1

_EMPTY = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_FOUND = "g long, w int, id long, found long, score long, scored long"


def mine(
    df: DataFrame,
    anchor_every: int = 50,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cell_rows: int | None = None,
    stats: dict | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``anchor_every``.  Components count as
    floor(scale * x).  An anchor's positives are its first other rows of the same label,
    largest inner product first, ties to the smaller id; for each of them the first
    ``negatives`` rows of other labels whose score is from FROM to TO percent of the
    positive's.  Fewer where there are fewer.

    Rows with a null id, label, vector or component, with a component that isn't finite,
    or of another length than the most frequent one (the smaller of two as frequent)
    take no part.  Rows that repeat id, label and vector count once; one id with several
    vectors or labels is several rows, and what belongs to "other rows" then includes
    them.  Zero vectors score 0.  Rows of equal label and vector keep the smallest ids
    that any answer can hold.  An empty table gives no rows.
    """
    import numpy as np

    spark = df.sparkSession
    rows = inputs(df, id=(id_col, "long"), label=(label_col, "long"), x=(vector_col, "array<double>")).where(
        "id is not null and label is not null and size(x) > 0 and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))"
    )
    rows = rows.select("id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], _EMPTY)
    dim = lengths[0].n
    rows = rows.where(F.size("v") == dim)
    # Of equal rows only the smallest ids can be among the answers; own ones may have to be passed over.
    keep = max(positives + 1, negatives)
    few = rows.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("label", "v").orderBy("id"))).where(F.col("_r") <= keep)
    groups = few.groupBy("label", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    groups = cut(cut(groups).withColumn("g", F.monotonically_increasing_id()))  # numbers of what was written, written
    sizes = groups.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("m"), F.count("*").alias("n")).first()
    exact = dim * sizes.m**2 < 1 << 53
    block = cell_rows or min(max(CELL_BYTES // (8 * dim), 1), max(LEAST_ROWS, sizes.n // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cells = math.ceil(sizes.n / block)
    splits: list[tuple[int, float]] = []
    schema = "g long, label long, ids array<long>, v binary, cell long"

    def packed(splits):
        def run(iterator):
            import pyarrow as pa

            for batch in iterator:
                vectors = np.asarray(batch.column(batch.schema.get_field_index("v")).flatten(), dtype=np.int64).reshape(-1, dim)
                kept = [batch.column(batch.schema.get_field_index(c)) for c in ("g", "label", "ids")]
                cells = cell_of(vectors.astype(float), splits)
                yield pa.RecordBatch.from_arrays([*kept, pa.array([x.tobytes() for x in vectors], pa.binary()), pa.array(cells, pa.int64())], ["g", "label", "ids", "v", "cell"])

        return run

    if cells > 1:
        sample = groups.orderBy(F.xxhash64("g")).limit(max(SAMPLE_BYTES // (8 * dim), 1)).mapInArrow(packed([]), schema).select("v").collect()
        splits = kd_splits(np.stack([np.frombuffer(r.v, dtype=np.int64) for r in sample]).astype(float), cells)
    data = cut(groups.select("g", "label", "ids", "v").mapInArrow(packed(splits), schema))
    # A cell of rows that are much alike can be larger than the tree meant: it has several parts.
    counts = cut(data.groupBy("cell").agg(F.ceil(F.count("*") / (4 * block)).cast("long").alias("subs")))
    data = cut(join_per_key(data, counts, "cell").withColumn("sub", F.pmod(F.xxhash64("g"), F.col("subs"))).drop("subs"))
    balls = _balls(data, dim)

    asked = rows.where(F.col("id") % anchor_every == 0).distinct().withColumn("h", F.xxhash64("v"))
    asked = cut(asked.join(groups.select("label", F.xxhash64("v").alias("h"), "v", "g"), ["label", "h", "v"]).select("id", "g"))
    queries = cut(data.select("g", "label", "v", "cell").join(asked.select("g").distinct(), "g"))

    least, most = F.array(F.lit(-TOP)), F.array(F.lit(TOP))
    near = _search(queries.withColumn("low", least).withColumn("high", most), data, counts, balls, True, positives + 1, exact, stats)
    order = Window.partitionBy("g").orderBy(F.desc("score"), "id", "found")
    near = cut(near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= positives + 1))

    # floor and ceiling of whole numbers: a positive score s takes negatives from FROM * s / 100 to TO * s / 100.
    windows = near.select("g", F.col("score").alias("s")).where("s >= 0").distinct()
    windows = windows.groupBy("g").agg(F.sort_array(F.collect_list("s")).alias("s"))  # positives + 1 at most
    of = lambda s, percent: s.cast("decimal(20)") * percent / F.lit(100).cast("decimal(3)")
    windows = windows.withColumn("low", F.transform("s", lambda s: F.ceil(of(s, FROM)).cast("long"))).withColumn("high", F.transform("s", lambda s: F.floor(of(s, TO)).cast("long")))
    windows = cut(windows)
    far = _search(queries.join(windows, "g"), data, counts, balls, False, negatives, exact, stats)
    order = Window.partitionBy("g", "w").orderBy(F.desc("score"), "id", "found")
    far = cut(far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives))
    far = far.join(windows.select("g", F.posexplode("s").alias("w", "s")), ["g", "w"])
    hard = far.groupBy("g", F.col("s").alias("positive_score")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("hard"))

    if stats is not None:
        stats |= {"vectors": sizes.n, "anchors": queries.count(), "cells": len(balls[0])}
    # Of each anchor the first positives that aren't its own row.
    near = near.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("_r", F.col("id").alias("positive_id"), "found", F.col("score").alias("positive_score")))).alias("near"))
    own = lambda p: ~((p["positive_id"] == F.col("anchor_id")) & (p["found"] == F.col("g")))
    pairs = join_per_key(asked.withColumnRenamed("id", "anchor_id"), cut(near), "g", "inner")
    pairs = pairs.select("anchor_id", "g", F.explode(F.slice(F.filter("near", own), 1, positives)).alias("p")).select("anchor_id", "g", "p.positive_id", "p.positive_score")
    out = pairs.join(hard.hint("merge"), ["g", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.explode("hard").alias("n"))
    return out.select("anchor_id", "positive_id", "n.rank", "n.negative_id", "positive_score", "n.negative_score")


def _balls(data: DataFrame, dim: int):
    """(cells, centres, radii): a ball around each cell; one row a cell reaches the driver."""
    import numpy as np

    def vectors(batch):
        return np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int64).reshape(batch.num_rows, dim).astype(float)

    def sums(iterator):
        import pyarrow as pa

        total: dict = {}
        for batch in iterator:
            cells, x = batch.column(0).to_numpy(), vectors(batch)
            for c in np.unique(cells):
                n, s = total.get(c, (0, 0.0))
                total[c] = n + int((cells == c).sum()), s + x[cells == c].sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.float64()))], ["cell", "n", "s"]
        )

    centres: dict = {}
    for r in data.select("cell", "v").mapInArrow(sums, "cell long, n long, s array<double>").groupBy("cell").agg(
        F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(dim))).alias("s")
    ).collect():
        centres[r.cell] = np.array(r.s) / r.n

    def reach(iterator):
        import pyarrow as pa

        radius: dict = {}
        for batch in iterator:
            cells, x = batch.column(0).to_numpy(), vectors(batch)
            for c in np.unique(cells):
                far = float(np.sqrt(((x[cells == c] - centres[c]) ** 2).sum(axis=1).max()))
                radius[c] = max(radius.get(c, 0.0), far)
        yield pa.RecordBatch.from_arrays([pa.array(list(radius), pa.int64()), pa.array(list(radius.values()), pa.float64())], ["cell", "r"])

    found = data.select("cell", "v").mapInArrow(reach, "cell long, r double").groupBy("cell").agg(F.max("r").alias("r")).collect()
    names = np.array([r.cell for r in found])
    return names, np.array([centres[c] for c in names]).reshape(len(names), dim), np.array([r.r for r in found])


def _search(queries: DataFrame, data: DataFrame, counts: DataFrame, balls, same: bool, k: int, exact: bool, stats: dict | None) -> DataFrame:
    """_FOUND: for each query (g, label, v, cell, low, high) and window the ``k`` best of each cell it visits.

    The own cell comes first; what was found there says which other cells' balls can
    still hold something.
    """
    import numpy as np

    names, centres, radii = balls
    length = np.sqrt((centres**2).sum(axis=1)) + radii

    def going(turn: int):
        def run(iterator):
            import pyarrow as pa

            for batch in iterator:
                cols = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
                at, to = [], []
                for i, (v, home, low, high, kth) in enumerate(zip(*(cols[c].to_pylist() for c in ("v", "cell", "low", "high", "kth")))):
                    if turn == 0:
                        at.append(i)
                        to.append(home)
                        continue
                    q = np.frombuffer(v, dtype=np.int64).astype(float)
                    norm = float(np.sqrt((q * q).sum()))
                    middle, slack = centres @ q, 1e-9 * norm * length + 1e-9
                    above, below = middle + norm * radii + slack, middle - norm * radii - slack
                    open_ = np.zeros(len(names), bool)
                    for a, b, c in zip(low, high, kth):
                        open_ |= (above >= max(a, c)) & (below <= b)
                    cells = names[open_ & (names != home)]
                    at += [i] * len(cells)
                    to += cells.tolist()
                at = pa.array(at, pa.int64())
                kept = ["g", "label", "v", "low", "high", "kth"]
                yield pa.RecordBatch.from_arrays([*(cols[c].take(at) for c in kept), pa.array(to, pa.int64())], [*kept, "cell"])

        return run

    unknown = F.transform("low", lambda x: F.lit(-TOP))
    schema = "g long, label long, v binary, low array<long>, high array<long>, kth array<long>, cell long"
    found = None
    for turn in range(2 if len(names) > 1 else 1):
        if found is None:
            known = queries.withColumn("kth", unknown)
        else:
            best = found.groupBy("g", "w").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k).alias("s")).where(F.size("s") == k)
            best = best.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("w", F.col("s")[k - 1].alias("s")))).alias("m"))
            known = queries.join(best, "g", "left").withColumn("kth", F.transform("low", lambda x, i: F.coalesce(F.try_element_at("m", i), F.lit(-TOP))))
        visits = cut(known.select("g", "label", "v", "low", "high", "kth", "cell").mapInArrow(going(turn), schema))
        new = cut(_visit(visits, data, counts, same, k, exact))
        found = new if found is None else found.union(new)
    if stats is not None:
        stats["scored"] = stats.get("scored", 0) + (found.agg(F.sum("scored")).first()[0] or 0)
    return found


def _visit(visits: DataFrame, data: DataFrame, counts: DataFrame, same: bool, k: int, exact: bool) -> DataFrame:
    """Cell parts and groups of ANCHOR_CHUNK queries meet, each meeting in one task."""
    chunks = cut(visits.groupBy("cell").agg(F.ceil(F.count("*") / ANCHOR_CHUNK).cast("long").alias("chunks")))
    visits = join_per_key(join_per_key(visits, chunks, "cell", "inner"), counts, "cell", "inner")
    visits = visits.withColumn("chunk", F.pmod(F.xxhash64("g"), F.col("chunks"))).withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)))
    data = join_per_key(data, chunks, "cell", "inner").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))

    def run(q, x):
        import numpy as np
        import pandas as pd

        out: dict = {c: [] for c in ("g", "w", "id", "found", "score", "scored")}
        if len(q) and len(x):
            kind = np.float64 if exact else np.int64
            rows = lambda column: np.frombuffer(b"".join(column), dtype=np.int64).reshape(len(column), -1).astype(kind)
            forest = Forest(x["label"].to_numpy(), rows(x["v"]))
            names, ids = x["g"].to_numpy()[forest.order], [x["ids"].iloc[i] for i in forest.order]
            first = np.array([i[0] for i in ids])
            for g, label, v, low, high, kth in zip(q["g"], q["label"], rows(q["v"]), q["low"], q["high"], q["kth"]):
                best, scored = forest.search(first, v, label, same, low, high, kth, k)
                for w, (places, scores) in enumerate(best):
                    for p, s in zip(places, scores):
                        for i in ids[p][:k]:
                            for c, value in zip(out, (g, w, i, names[p], int(s), scored)):
                                out[c].append(value)
                            scored = 0
        return pd.DataFrame({c: np.array(v, dtype=np.int64) for c, v in out.items()}).astype({"w": np.int32})

    keys = ["cell", "sub", "chunk"]
    q = visits.select(*keys, "g", "label", "v", "low", "high", "kth").groupBy(*keys)
    x = data.select(*keys, "g", "label", "ids", "v").groupBy(*keys)
    return q.cogroup(x).applyInPandas(run, _FOUND)
