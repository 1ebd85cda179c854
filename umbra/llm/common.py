"""What the operators of this subpackage share: lineage cuts, input columns, words."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from umbra.sources.allfiles import shared_folder

#: A side is broadcast only when it was counted and holds no more rows, and its numbers
#: and arrays of numbers no more bytes, than this.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Bytes of an Arrow batch between Spark and Python while ``cut`` runs.
ARROW_BYTES = 4 << 20

#: The ASCII characters that part words (fixed by the queries' contracts): space and \x09-\x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Removes the files of an execution's shuffles at its end.
SHUFFLE_FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """These settings for what runs inside; the session's own come back after it."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def small_batches(spark: SparkSession):
    """Arrow batches of at most ARROW_BYTES for what runs inside.

    A batch of texts stands in the JVM, in Python, and as Python objects at once.
    """
    return settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)})


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and go on from there.

    Steps in Python before the cut run with small batches.  The folder is that of
    ``shared_folder``; Spark removes a checkpoint after its last use if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.  The shuffles before the
    cut are read by nothing else: their files go at once and not when the driver happens
    to collect its garbage.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    with small_batches(spark), settings(spark, {SHUFFLE_FILES: "true"}):
        return df.select("*").checkpoint(eager=True)  # a frame takes the setting when it is made


def inputs(df: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """Only the named inputs, cast and renamed: ``inputs(df, _id=("doc_id", "long"))``.

    Whatever else ``df`` carries, also under clashing names, is out of the way.  A
    column that ``df`` lacks becomes null.
    """
    return df.select(
        *((F.col(f"`{src}`") if src in df.columns else F.lit(None)).cast(kind).alias(name) for name, (src, kind) in columns.items())
    )


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number for each row that is the same whenever the rows are read again.

    Rows of files: the file's rank by path, then the row's place in it, however the
    files are split.  Other rows are written once and numbered as they stand there.
    """
    try:
        found = df.withColumn("_umbra_file", F.col("_metadata.file_path")).withColumn("_umbra_place", F.col("_metadata.row_index"))
        found.schema  # resolved here  # noqa: B018
    except AnalysisException:
        return cut(df).withColumn(name, F.monotonically_increasing_id())
    files = found.select("_umbra_file").distinct().withColumn("_umbra_rank", F.row_number().over(Window.orderBy("_umbra_file")).cast("long"))
    found = join_per_key(found, cut(files), "_umbra_file")
    return found.withColumn(name, F.shiftleft("_umbra_rank", 40) + F.col("_umbra_place")).drop("_umbra_file", "_umbra_rank", "_umbra_place")


def join_per_key(rows: DataFrame, per_key: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Join ``rows`` with a checkpointed table of one row a key.

    The table's rows and the bytes of its texts and arrays are counted: up to BROADCAST_ROWS and BROADCAST_BYTES it is broadcast, beyond
    that it is a merge join whose hot keys adaptive execution splits (one row a key on
    the right, so splitting the left side copies one row).
    """
    width = lambda f: 8 if f.dataType.elementType.typeName() in ("integer", "long", "double") else 32
    sizes = [F.coalesce(F.sum(F.size(f.name)), F.lit(0)) * width(f) for f in per_key.schema if f.dataType.typeName() == "array"]
    sizes += [F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)) for f in per_key.schema if f.dataType.typeName() in ("string", "binary")]
    found = per_key.agg(F.count("*").alias("n"), sum(sizes, F.lit(0)).alias("m")).first()
    if found.n <= BROADCAST_ROWS and 64 * found.n + found.m <= BROADCAST_BYTES:
        return rows.join(F.broadcast(per_key), on, how)
    return rows.join(per_key.hint("merge"), on, how)


def crc32_of(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))


def arrow_batches(iterator, columns: list[str], rows: int = 512):
    """Slices of ``rows`` of the Arrow record batches, with the columns as Python lists.

    As Python objects, with what is made of them, a whole batch would take several
    times its size of a worker's memory at once.
    """
    for whole in iterator:
        for i in range(0, max(whole.num_rows, 1), rows):
            batch = whole.slice(i, rows)
            yield batch, [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
    release()


def release() -> None:
    """Give back what a task no longer uses: the worker goes on to other tasks, of other stages too."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
