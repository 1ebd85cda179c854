"""A Spark sink for lines: one report from the parts of all tasks, or a log by epochs.

Tasks write their lines to files of their own beside the target; what the driver gets is
their names.  A batch is committed by putting the parts together, in blocks of bytes,
under a name that then takes the target's place at once; an aborted or lost attempt
leaves the target as it was.  A stream's epoch is committed by renaming a folder to the
epoch's number: if that is there already, the epoch was committed before a restart and
its lines are not written again.  Paths have to be visible to every executor.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

BLOCK = 4 << 20


@dataclass
class _Written(WriterCommitMessage):
    file: str
    partition: int
    lines: int


class _Parts:
    def __init__(self, options: dict[str, str]):
        self.target = options["path"]
        self.between = options.get("between", "")
        self.pending = os.path.join(os.path.dirname(os.path.abspath(self.target)), f".{os.path.basename(self.target)}.pending-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        os.makedirs(self.pending, exist_ok=True)
        file, lines = os.path.join(self.pending, uuid.uuid4().hex), 0
        with open(file, "wb") as f:
            for row in iterator:
                f.write((self.between if lines else "").encode() + row[0].encode())
                lines += 1
        return _Written(file, TaskContext.get().partitionId(), lines)

    def ordered(self, messages: list) -> list[_Written]:
        return sorted((m for m in messages if m is not None and m.lines), key=lambda m: m.partition)

    def cleared(self) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)


class _Report(_Parts, DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.head, self.tail, self.empty = options.get("head", ""), options.get("tail", ""), options.get("empty")

    def commit(self, messages: list) -> None:
        parts, made = self.ordered(messages), os.path.join(self.pending, "whole")
        os.makedirs(self.pending, exist_ok=True)
        with open(made, "wb") as out:
            if not parts and self.empty is not None:
                out.write(self.empty.encode())
            else:
                out.write(self.head.encode())
                for i, part in enumerate(parts):
                    out.write((self.between if i else "").encode())
                    with open(part.file, "rb") as f:
                        shutil.copyfileobj(f, out, BLOCK)
                out.write(self.tail.encode())
        os.replace(made, self.target)
        self.cleared()

    def abort(self, messages: list) -> None:
        self.cleared()


class _Epochs(_Parts, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        os.makedirs(self.target, exist_ok=True)
        done = os.path.join(self.target, f"{batchId:012d}")
        if not os.path.exists(done):
            made = os.path.join(self.pending, f"epoch-{batchId}")
            os.makedirs(made, exist_ok=True)
            for i, part in enumerate(self.ordered(messages)):
                os.replace(part.file, os.path.join(made, f"{i:06d}.log"))
            os.rename(made, done)
        self.cleared()

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.cleared()


class Lines(DataSource):
    """Lines of one string column.  Options: path; between, head, tail and empty for reports."""

    @classmethod
    def name(cls) -> str:
        return "umbra_lines"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Report(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _Epochs(self.options)


def write_report(lines: DataFrame, path: str, **options: str) -> None:
    """One file of the lines, in the order of ``lines``' partitions."""
    lines.sparkSession.dataSource.register(Lines)
    lines.write.format("umbra_lines").option("path", path).options(**options).mode("overwrite").save()


def write_log(stream: DataFrame, folder: str, state: str, **trigger) -> StreamingQuery:
    """Start a stream of lines into ``folder``, each once, however often it is stopped and started again with its ``state``."""
    stream.sparkSession.dataSource.register(Lines)
    writer = stream.writeStream.format("umbra_lines").option("path", folder).option("checkpointLocation", state)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The committed lines, in a column ``value`` without line ends, and the epoch."""
    return spark.read.option("recursiveFileLookup", "false").text(f"{folder}/[0-9]*").selectExpr("value", "cast(split(_metadata.file_path, '/')[size(split(_metadata.file_path, '/')) - 2] as long) as epoch")


def pretty(row: dict) -> str:
    """A row as an item of a JSON list indented by four."""
    return json.dumps([row], indent=4)[2:-2]
