"""Contiguous, byte-balanced shards from global prefix sums (DataFrame functions only).

The rows are put in one global order (id, size, checksum) by a range exchange of
narrow rows, never of the texts.  Each range's byte and row totals, one row a range,
are summed up to the bytes before each range; adding the running sum inside the range
gives every row its global byte position.  A row goes to the shard in whose equal
share of all bytes its middle lies, so shards are contiguous in the order and their
sizes differ from the target by about half a row at each end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.common import crc32_of, cut, inputs


def shard_by_bytes(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, size, text_crc32, position, shard, slot.

    size is the text's UTF-8 bytes plus 1 (a null text has none), position the bytes of
    all rows before it, slot its number in its shard, gapless from 0.  Rows with a null
    id come first in the order.  Repeated rows get neighbouring positions, each its own
    slot; which of two equal rows comes first does not show in the result.  A text
    larger than a whole share leaves the shards it spans empty but for itself.  An
    empty table gives no rows.  Only ``id_col`` and ``text_col`` of ``df`` are read.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    rows = inputs(df, doc_id=(id_col, "long"), _t=(text_col, "string")).select(
        "doc_id",
        (F.coalesce(F.octet_length("_t"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(crc32_of(F.col("_t")), F.lit(0).cast("long")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_n"),
    )
    rows = cut(rows)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # _n lets the ranges split a third of all rows that share one id.
    ranged = cut(rows.repartitionByRange(n, "doc_id", "size", "text_crc32", "_n").withColumn("_p", F.spark_partition_id()))

    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_p").agg(F.sum("size").alias("_b"))
    starts = totals.select(  # as many rows as there are ranges
        "_p",
        F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_before"),
        F.sum("_b").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy("_p").orderBy("doc_id", "size", "text_crc32", "_n")
    placed = (
        ranged.repartitionByRange(n, "_p")
        .withColumn("_run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "_p")  # one row a range
        .withColumn("position", F.col("_before") + F.col("_run"))
        # in integers: floor((position + size / 2) * n_shards / all)
        .withColumn("shard", F.expr(f"least(({n_shards}L * (2L * position + size)) div (2L * _all), {n_shards - 1}L)").cast("int"))
    )
    placed = cut(placed.select("doc_id", "size", "text_crc32", "position", "shard", "_p", "_row"))
    # A shard's rows are contiguous, also inside a range: the slot is the row's number in its
    # range, less the first such number of the shard, plus the shard's rows in earlier ranges.
    parts = placed.groupBy("shard", "_p").agg(F.count("*").alias("_c"), F.min("_row").alias("_first"))
    offsets = parts.select(  # ranges + shards rows at most
        "shard", "_p", "_first", F.coalesce(F.sum("_c").over(Window.partitionBy("shard").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier")
    )
    return placed.join(F.broadcast(offsets), ["shard", "_p"]).select(
        "doc_id", "size", "text_crc32", "position", "shard", (F.col("_earlier") + F.col("_row") - F.col("_first")).cast("long").alias("slot")
    )


def shard_cuts(assigned: DataFrame) -> DataFrame:
    """Per shard its rows, bytes and first and last id: what a writer needs to cut the texts."""
    return assigned.groupBy("shard").agg(
        F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )

