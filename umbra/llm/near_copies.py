"""Near copies by shingle similarity: an index over positional bytes, a tally, exact verification.

Two texts are near copies if the Jaccard similarity of their sets of SHINGLE-word
shingles is LEAST or more.  A text has BANDS * ROWS minimum hashes; the lists of the
index are those of ROWS neighbouring positions.  Two texts of similarity 0.8 meet in
none of the BANDS lists with a probability of (1 - 0.8 ** 4) ** 25, two in a million.
Of pairs that meet the shared positional bytes are tallied; at 0.8 fewer than
LEAST_BYTES of 100 are shared by one pair in a million.  The rest is verified on the
shingles.

Texts of equal sets are one before the search.  A key's list of up to LIST sets gives
its pairs.  Each member of a longer list is compared with LEADERS of it, drawn anew for
each round; those like none of them go on to the next round with four times as
many, until no list is longer.  So no list with a large group is paired with itself and
no member is left out; only a link between one that is like a leader and one that is
like none, in all lists of both, is not seen.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import arrow_batches, cut, inputs, join_per_key
from umbra.llm.components import connected_components

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS, SEED = 25, 4, 42
LEAST_BYTES = 60
LIST, LEADERS = 16, 8
#: Hashes permuted at a time, 8 * BANDS * ROWS bytes each.
BLOCK = 1 << 12


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted different hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(flat, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    return np.unique(np.array([xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64))


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Is the Jaccard similarity of two sorted sets at least ``least``?"""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate((a, b)))
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= least * (len(a) + len(b) - shared) - 1e-9


@cache
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    odd = lambda *shape: rng.integers(0, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd(BANDS * ROWS, 1), odd(BANDS * ROWS, 1), odd(BANDS, ROWS)


def bands(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The keys of a set, BANDS of them (sets that share one are candidates), and its positional bytes."""
    times, plus, mix = _constants()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), BLOCK):
        least = np.minimum(least, (hashes[i : i + BLOCK] * times + plus).min(axis=1))
    keys = ((least.reshape(BANDS, ROWS) * mix).sum(axis=1, dtype=np.uint64) ^ mix[:, 0]).view(np.int64)
    return keys, (least >> np.uint64(56)).astype(np.uint8).tobytes()


def least_bytes(least: float) -> int:
    """The positional bytes that a pair of similarity ``least`` shares, all but once in a million."""
    n = BANDS * ROWS
    return max(0, int(n * least - 5 * (n * least * (1 - least)) ** 0.5)) if least < LEAST else LEAST_BYTES


def _signatures(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, s1, s2, keys, bytes): two hashes of the set, its keys and its positional bytes."""

    def run(iterator):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch, (ids, texts) in arrow_batches(iterator, ["id", "_t"]):
            sets = [shingles(t, shingle) for t in texts]
            names = np.array([[xxh64_intdigest(s.tobytes(), seed) for s in sets] for seed in (1, 2)], np.uint64).view(np.int64)
            made = [bands(s) for s in sets]
            keys = np.array([k for k, _ in made], np.int64).reshape(-1)
            own = pa.array([b for _, b in made], pa.binary())
            offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names[0]), pa.array(names[1]), pa.ListArray.from_arrays(offsets, pa.array(keys)), own], ["id", "s1", "s2", "keys", "bytes"])

    return inputs(df, id=(id_col, "long"), _t=(text_col, "string")).mapInArrow(run, "id long, s1 long, s2 long, keys array<long>, bytes binary")


def _sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, hashes) of the rows ``wanted``; only their texts move."""

    def run(iterator):
        import pyarrow as pa

        for _, (ids, texts) in arrow_batches(iterator, ["id", "_t"]):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([shingles(t, shingle).tobytes() for t in texts], pa.binary())], ["id", "hashes"])

    texts = inputs(df, id=(id_col, "long"), _t=(text_col, "string"))
    return join_per_key(texts, wanted, "id", "inner").mapInArrow(run, "id long, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that are near copies; ``sets``: (id, hashes, bytes)."""
    enough = least_bytes(least)

    def tallied(iterator):
        import pyarrow as pa

        for batch in iterator:
            x, y = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("x", "y"))
            ok = pa.array(np.flatnonzero((x == y).sum(axis=1) >= enough))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).take(ok) for c in ("a", "b")], ["a", "b"])

    def run(iterator):
        import pyarrow as pa

        for batch, (a, b, x, y) in arrow_batches(iterator, ["a", "b", "x", "y"], 64):
            ok = [i for i, (p, q) in enumerate(zip(x, y)) if similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), least)]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in ok], pa.int64()), pa.array([b[i] for i in ok], pa.int64())], ["a", "b"])

    ends = [sets.select(F.col("id").alias(c), F.col("hashes").alias(h)) for c, h in (("a", "x"), ("b", "y"))]
    small = [sets.select(F.col("id").alias(c), F.col("bytes").alias(h)) for c, h in (("a", "x"), ("b", "y"))]
    met = pairs.distinct().join(small[0], "a").join(small[1], "b").select("a", "b", "x", "y").mapInArrow(tallied, "a long, b long")
    both = met.join(ends[0], "a").join(ends[1], "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _counted(listed: DataFrame) -> DataFrame:
    """(key, id, n) of the lists with a pair."""
    sizes = listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return cut(listed.join(sizes, "key"))


def _all_pairs(lists: DataFrame) -> DataFrame:
    a, b = lists.select("key", F.col("id").alias("a")), lists.select("key", F.col("id").alias("b"))
    return a.join(b, "key").where("a < b").select("a", "b")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(id, component_id) for each row of ``df``: the smallest id reachable over near copies.

    ``id_col`` numbers the rows: no nulls, no repeats.  Texts without words (null,
    empty, blank) are copies of each other.
    """
    rows, per_set, found = _searched(df, id_col, text_col, shingle, least)
    roots = cut(connected_components(found))
    placed = cut(per_set.select("s1", "s2", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select(F.struct("s1", "s2").alias("s"), F.coalesce("root", "id").alias("component_id")))
    return join_per_key(rows.select("id", F.struct("s1", "s2").alias("s")), placed, "s").select("id", "component_id")


def near_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(a, b) of rows that are near copies: enough of them to keep every connection of ``near_copies``."""
    rows, per_set, found = _searched(df, id_col, text_col, shingle, least)
    copies = rows.join(per_set.select("s1", "s2", F.col("id").alias("b")), ["s1", "s2"]).where("id <> b")
    return found.union(copies.select(F.col("id").alias("a"), "b"))


def _searched(df: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (id, s1, s2), their different sets by the smallest id, and the links (a, b) between sets."""
    rows = cut(_signatures(df, id_col, text_col, shingle))
    per_set = cut(rows.groupBy("s1", "s2").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("bytes").alias("bytes")))
    rows = rows.select("id", "s1", "s2")
    lists = _counted(per_set.select("id", F.explode("keys").alias("key")))
    wanted = cut(lists.select("id").distinct())
    sets = cut(_sets(df, wanted, id_col, text_col, shingle).join(per_set.select("id", "bytes"), "id"))
    short = [lists.where(F.col("n") <= LIST)]
    many = lists.where(F.col("n") > LIST).select("key", "id")
    found, turn = None, 0
    while many.limit(1).count():
        drawn = many.withColumn("_h", F.xxhash64("id", F.lit(turn)))  # the same leaders in all lists of a group
        leaders = drawn.groupBy("key", F.pmod("_h", F.lit(LEADERS << 2 * turn)).alias("_slot")).agg(F.min(F.struct("_h", "id")).alias("_l"))
        leaders = leaders.select("key", F.col("_l.id").alias("lead"))
        stars = cut(many.join(leaders, "key").select("key", "id", "lead"))
        new = _verified(stars.where("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")), sets, least)
        linked = new.union(new.select(F.col("b").alias("a"), F.col("a").alias("b")))
        done = stars.join(linked, (F.col("id") == F.col("a")) & (F.col("lead") == F.col("b"))).select("key", "id")
        done = done.union(stars.where("id = lead").select("key", "id")).distinct()
        lists = _counted(many.join(done, ["key", "id"], "left_anti"))
        short.append(lists.where(F.col("n") <= LIST))  # a key's list is short once
        many = lists.where(F.col("n") > LIST).select("key", "id")
        found, turn = new if found is None else found.union(new), turn + 1
    rest = _verified(_all_pairs(reduce(DataFrame.union, short)), sets, least)
    found = rest if found is None else found.union(rest)
    return rows, per_set, found.distinct()
