"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits agree in at least six of
their eight bytes.  A posting's key is KEY_BYTES = 5 positional bytes, one posting for
each of the 56 choices of five positions; so two fingerprints that agree in six bytes
meet in six lists, in seven bytes in 21, and those that agree in five only meet once.
(Lists of single positional bytes, 2048 in all, would each hold 1/256 of the corpus and
pair it with itself.)  The lists in which a pair meets are tallied; pairs that reach
the guaranteed minimum of six are verified on their bits.

A list of up to PAIR_LIST fingerprints gives its pairs.  Members of a longer list are
linked without pairs: each gives the 65 codes at most one bit away from it;
fingerprints that share a code are at most two bits apart, and two that are at most two
bits apart share one.  So each is linked to the smallest at its code, at most 65
fingerprints a code, and no link is lost.

Sign bits can't find texts of a shingle similarity of 0.8: those differ in about ten of
64 bits, in any byte.  With ``least`` the links above are joined by those of texts of that
similarity (``near_copies``): there the positional bytes are those of minimum hashes, 100
of them, index keys are groups of four positions, the tally counts the shared bytes of a
pair, and what reaches the minimum is verified on the shingles themselves.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.common import arrow_batches, cut, inputs, join_per_key
from umbra.llm.components import connected_components
from umbra.llm.near_copies import SHINGLE as NEAR_SHINGLE
from umbra.llm.near_copies import near_links

BITS, BYTES, SEED = 64, 8, 42
MAX_BITS = 2
SHINGLE = 3
KEY_BYTES = 5
#: The lists in which two fingerprints at most MAX_BITS apart are sure to meet.
LEAST_MEETINGS = comb(BYTES - MAX_BITS, KEY_BYTES)
PAIR_LIST = 16
#: Hashes turned into bits at a time, 64 bytes each.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for a text without words or null."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        h = np.array([xxh64_intdigest(flat, SEED)], dtype="<u8")
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        h = np.array([xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), BLOCK):
        block = h[i : i + BLOCK].view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row of ``df``."""

    def run(iterator):
        import pyarrow as pa

        for batch, (texts,) in arrow_batches(iterator, ["_t"]):
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array([fingerprint(t, shingle) for t in texts], pa.int64())], ["doc_id", "fp"]
            )

    return inputs(df, doc_id=(id_col, "long"), _t=(text_col, "string")).mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints at most MAX_BITS apart: enough of them to keep every connection.

    ``fps`` has distinct, checkpointed fingerprints in its column fp.
    """
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    postings = []
    for n, positions in enumerate(combinations(range(BYTES), KEY_BYTES)):
        mask = sum(0xFF << (8 * p) for p in positions)
        postings.append(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(signed(mask)))))
    listed = fps.select(F.explode(F.array(*postings)).alias("key"), "fp")
    # Counted before they move, then joined back: a window would take a hot key's whole list into one task.
    sizes = listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(listed.join(sizes.hint("merge"), "key"))
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    few = met.where(F.col("n") <= PAIR_LIST)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b")
    tallied = pairs.groupBy("a", "b").agg(F.count("*").alias("meetings"))
    pairs = tallied.where(F.col("meetings") >= LEAST_MEETINGS).where(apart("a", "b") <= MAX_BITS).select("a", "b")

    many = met.where(F.col("n") > PAIR_LIST).select("fp").distinct()
    codes = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(BITS)))
    stars = (
        many.select(F.explode(codes).alias("code"), "fp")
        .withColumn("a", F.min("fp").over(Window.partitionBy("code")))
        .where("a <> fp")
        .where(apart("a", "fp") <= MAX_BITS)
        .select("a", F.col("fp").alias("b"))
    )
    return pairs.union(stars).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float | None = None, near_shingle: int = NEAR_SHINGLE) -> DataFrame:
    """One row for each row of ``df``: doc_id, fp, component_id.

    With ``least`` texts whose sets of ``near_shingle``-word shingles have that Jaccard
    similarity are linked as well, and ids have to number the rows.

    component_id is the smallest doc_id among all rows reachable over links of at most
    two differing bits.  Texts without words (null, empty, blank) have fingerprint 0
    and are linked like any other; a text of fewer words than ``shingle`` is one
    shingle.  Rows with a null id are linked too but lend no id: the component of only
    such rows is null.  Repeated rows each give a row.  An empty table gives none.
    """
    rows = cut(fingerprints(df, id_col, text_col, shingle))
    per_fp = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    if least is not None:
        # Links of both kinds in one graph of rows: one search for its components.
        ends = [per_fp.select(F.col("fp").alias(c), F.col("least").alias(i)) for c, i in (("a", "x"), ("b", "y"))]
        edges = links(per_fp.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = edges.union(rows.join(per_fp, "fp").where("doc_id <> least").select("doc_id", "least"))
        roots = cut(connected_components(edges.union(near_links(df, id_col, text_col, near_shingle, least))))
        return join_per_key(rows, roots.withColumnRenamed("node", "doc_id"), "doc_id").select("doc_id", "fp", F.coalesce("root", "doc_id").alias("component_id"))
    roots = cut(connected_components(links(per_fp.select("fp"))))
    placed = per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    per_fp = cut(placed.join(ids, "root").select("fp", "component_id"))
    return join_per_key(rows, per_fp, "fp").select("doc_id", "fp", "component_id")
