"""Log records as masked lines, the same for batches and streams: nothing is kept between rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from umbra.operators.document import DocumentMasker, decode, encode
from umbra.operators.records import Unfit, compiled, finished, native, shape_of_type
from umbra.operators.rules import with_masked
from umbra.plans.registry import resolve
from umbra.profiles import Profile


MASKED, CONTEXT = "_umbra_message", "_umbra_context"


def _context(value: Column, kind: T.DataType, profile: Profile) -> Column:
    """`` {...}`` for a context that isn't empty, masked as a document; else nothing."""
    if not isinstance(kind, T.StringType):
        value = F.to_json(value, {"ignoreNullFields": "false"})
    rules = resolve(profile)

    @F.pandas_udf("string")
    def suffix(texts):
        masker = DocumentMasker(profile, rules)

        def one(raw):
            if raw is None:
                return ""
            try:
                root = decode(raw.decode())
            except ValueError:
                return " " + encode(masker.failed(raw.decode("utf-8", "replace")), compat=True, slashes=True)
            return " " + encode(masker.mask(root), compat=True, slashes=True) if root else ""

        return texts.map(one)

    return suffix(value.cast("binary"))


def _with_context(df: DataFrame, profile: Profile) -> DataFrame:
    """``df`` with CONTEXT: the suffix for ``context``.  A struct's keys are decided while the plan is built."""
    if "context" not in df.columns:
        return df.withColumn(CONTEXT, F.lit(""))
    value, kind = F.col("context"), df.schema["context"].dataType
    plan = None
    if isinstance(kind, T.StructType) and native(profile):
        try:
            plan = compiled(profile, shape_of_type(kind), value, 0, True, False)
        except Unfit:  # arrays, maps, times: as documents
            pass
    if plan is None:
        return df.withColumn(CONTEXT, _context(value, kind, profile))
    text = F.to_json(value, {"ignoreNullFields": "false"})
    rest = lambda open_: _context(F.when(open_, text), T.StringType(), profile)
    return finished(df, [(plan[0], F.concat(F.lit(" "), plan[1]))], df.columns, CONTEXT, rest)


def log_lines(df: DataFrame, profile: Profile) -> DataFrame:
    """``line`` for each record: datetime, channel, level, message, context (JSON, struct or map).

    The message is masked as a text without a key, the context as a document; a line
    ends with a line feed.  A missing context is an empty one.
    """
    stamp = F.date_format("datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    df = with_masked(_with_context(df, profile), F.col("message"), profile, MASKED, MASKED + "_hit")
    message = F.coalesce(F.col(MASKED), F.lit("null"))
    parts = [F.lit("["), stamp, F.lit("] "), F.col("channel"), F.lit("."), F.col("level"), F.lit(": "), message, F.col(CONTEXT), F.lit("\n")]
    return df.select(F.concat(*parts).alias("line"))


def batch_lines(df: DataFrame, profile: Profile, order: str = "datetime", first_only: bool = False) -> DataFrame:
    """A batch's lines; ``first_only``: of its first record alone, as formatters that drop the rest do."""
    return log_lines(df.orderBy(order).limit(1) if first_only else df, profile)


def tap(stream: DataFrame, profile: Profile, write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that gives each micro-batch's masked lines to ``write``; start() it."""
    return stream.writeStream.foreachBatch(lambda batch, n: write(log_lines(batch, profile), n))
