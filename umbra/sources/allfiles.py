"""A Spark data source over file trees that, unlike Spark's own listing, sees hidden files.

Files named as such and those below directories, each real path once.  Exclude patterns
are globs on base names and hold for files found in directories only.  Files that are
too large or not readable are left out when listing, so they are never opened.  Paths
have to be visible to every executor.

The driver opens directories only until there are enough for the tasks, which list the
trees below them; the listed paths, rows of a few bytes, are dealt out by path, so that
links to one file meet, and the tasks that get them read the contents.

As a stream the source gives each file once for each time it changes: its offset is the
last modification time and path that were taken.  A trigger walks the names on the
driver and reads only what is newer; files that changed in the last ``settle`` seconds
wait for the next one, so that no file written at the same moment falls behind.
"""

from __future__ import annotations

import fnmatch
import json
import os
import tempfile
import time
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, length long, content binary, error string"
#: Directories that the driver opens at most, and bytes of contents that a task hands on at a time.
OPENED, BATCH_BYTES = 4096, 4 << 20
#: Bytes of a file that a task holds for a digest.
READ_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; unset, a temporary one serves a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith(("local[", "local-")) and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="umbra-")


def missing_paths(paths: Iterable[str]) -> list[str]:
    return [p for p in paths if not os.path.exists(p)]


@dataclass(frozen=True)
class Rules:
    """What a file found in a directory has to fulfil."""

    exclude: tuple[str, ...] = ()
    max_size: int = 10_485_760
    #: Globs on the path below the directory, which base-name globs such as ``vendor/*`` can't express.
    exclude_paths: tuple[str, ...] = ()

    def eligible(self, path: str) -> tuple[str, int] | None:
        """(real path, size)."""
        try:
            size = os.stat(path).st_size
        except OSError:
            return None
        if size > self.max_size or not os.access(path, os.R_OK) or not os.path.isfile(path):
            return None
        return os.path.realpath(path), size

    def opened(self, top: str, folder: str) -> tuple[list[tuple[str, int]], list[str]]:
        """A directory's eligible files and its directories; of one that can't be opened none."""
        files, folders = [], []
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return files, folders
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                folders.append(e.path)
            elif not any(fnmatch.fnmatchcase(e.name, g) for g in self.exclude) and not any(fnmatch.fnmatchcase(os.path.relpath(e.path, top), g) for g in self.exclude_paths):
                if found := self.eligible(e.path):
                    files.append(found)
        return files, folders

    def below(self, top: str, folder: str) -> Iterator[tuple[str, int]]:
        todo = [folder]
        while todo:
            files, folders = self.opened(top, todo.pop())
            yield from files
            todo += reversed(folders)


def collect_files(paths: Iterable[str], exclude: Iterable[str] = (), max_size: int = 10_485_760, exclude_paths: Iterable[str] = ()) -> Iterator[tuple[str, int]]:
    """(real path, size) of eligible files, each once, explicit ones first; paths that don't exist give nothing."""
    paths, rules, seen = list(paths), Rules(tuple(exclude), max_size, tuple(exclude_paths)), set()
    named = (f for p in paths if os.path.isfile(p) and (f := rules.eligible(p)))
    for path, size in chain(named, *(rules.below(p, p) for p in paths if os.path.isdir(p))):
        if path not in seen:
            seen.add(path)
            yield path, size


class _Part(InputPartition):
    """Files already listed, and (directory given, directory) whose trees are still to be."""

    def __init__(self, files: list[tuple[str, int]], trees: list[tuple[str, str]]):
        self.files, self.trees = files, trees


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options.get("paths", "[]")) or [options["path"]]
        lists = (tuple(json.loads(options.get(k, "[]"))) for k in ("exclude", "exclude_paths"))
        exclude, exclude_paths = lists
        self.rules = Rules(exclude, int(options.get("max_size", 10_485_760)), exclude_paths)

    def partitions(self) -> list[InputPartition]:
        files = [f for p in self.paths if os.path.isfile(p) and (f := self.rules.eligible(p))]
        trees = deque((p, p) for p in self.paths if os.path.isdir(p))
        opened = 0
        while trees and len(trees) < OPENED and opened < OPENED:
            top, folder = trees.popleft()
            found, folders = self.rules.opened(top, folder)
            files += found
            trees += ((top, f) for f in folders)
            opened += 1
        return [_Part(files, [])] + [_Part([], [t]) for t in trees]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.files
        for top, folder in partition.trees:
            yield from self.rules.below(top, folder)


class _Newer(DataSourceStreamReader):
    """Files after an offset [modified in nanoseconds, path]."""

    def __init__(self, options: dict[str, str]):
        self.reader, self.tasks = _Reader(options), int(options.get("tasks", 8))
        self.settle = float(options.get("settle", 2))

    def _files(self) -> Iterator[tuple[int, str, int]]:
        r, seen = self.reader, set()
        named = (f for p in r.paths if os.path.isfile(p) and (f := r.rules.eligible(p)))
        for path, size in chain(named, *(r.rules.below(p, p) for p in r.paths if os.path.isdir(p))):
            try:
                modified = os.stat(path).st_mtime_ns
            except OSError:  # gone meanwhile
                continue
            if path not in seen:
                seen.add(path)
                yield modified, path, size

    def initialOffset(self) -> dict:  # noqa: N802
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        limit = time.time_ns() - int(self.settle * 1e9)
        last = max(((m, p) for m, p, _ in self._files() if m <= limit), default=(-1, ""))
        return {"modified": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = ((o["modified"], o["path"]) for o in (start, end))
        new = sorted((p, n) for m, p, n in self._files() if low < (m, p) <= high)
        return [_Part(new[i :: self.tasks], []) for i in range(min(self.tasks, len(new)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.files


class AllFiles(DataSource):
    """(path, length) of files.  Options: paths, exclude and exclude_paths (JSON lists), max_size."""

    @classmethod
    def name(cls) -> str:
        return "allfiles"

    def schema(self) -> str:
        return "path string, length long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Newer(self.options)


def _contents(iterator):
    """path, length, content and error of listed files."""
    import pyarrow as pa

    kinds = [("path", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("error", pa.string())]
    rows, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], [n for n, _ in kinds])

    for listed in iterator:
        for path in listed.column(0).to_pylist():
            try:
                with open(path, "rb") as f:
                    content = f.read()
                rows.append((path, len(content), content, None))
                size += len(content)
            except OSError:
                rows.append((path, None, None, "File unreadable"))
            if size >= BATCH_BYTES or len(rows) >= 10_000:
                yield batch()
                rows, size = [], 0
    if rows:
        yield batch()


def _digests(iterator):
    """path, length, SHA-256 and error of listed files, read in blocks."""
    import hashlib

    import pyarrow as pa

    for listed in iterator:
        rows = []
        for path in listed.column(0).to_pylist():
            try:
                digest, length = hashlib.sha256(), 0
                with open(path, "rb") as f:
                    while block := f.read(READ_BYTES):
                        digest.update(block)
                        length += len(block)
                rows.append((path, length, digest.hexdigest(), None))
            except OSError:
                rows.append((path, None, None, "File unreadable"))
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(columns)], ["path", "length", "sha256", "error"])


def _options(paths: Iterable[str], exclude: Iterable[str], max_size: int, exclude_paths: Iterable[str]) -> dict[str, str]:
    return {"paths": json.dumps(list(paths)), "exclude": json.dumps(list(exclude)), "exclude_paths": json.dumps(list(exclude_paths)), "max_size": str(max_size)}


def list_files(spark: SparkSession, paths: Iterable[str], exclude: Iterable[str] = (), max_size: int = 10_485_760, exclude_paths: Iterable[str] = ()) -> DataFrame:
    """path and length of each file, dealt out by path."""
    spark.dataSource.register(AllFiles)
    listed = spark.read.format("allfiles").options(**_options(paths, exclude, max_size, exclude_paths)).load()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(n, "path").dropDuplicates(["path"])


def read_listed(listed: DataFrame) -> DataFrame:
    """path, length, content, error of each file that ``list_files`` gave."""
    return listed.select("path").mapInArrow(_contents, SCHEMA)


def read_files(spark: SparkSession, paths: Iterable[str], exclude: Iterable[str] = (), max_size: int = 10_485_760, exclude_paths: Iterable[str] = ()) -> DataFrame:
    """path, length, content, error of each file."""
    return read_listed(list_files(spark, paths, exclude, max_size, exclude_paths))


def digest_files(spark: SparkSession, paths: Iterable[str], exclude: Iterable[str] = (), max_size: int = 10_485_760, exclude_paths: Iterable[str] = ()) -> DataFrame:
    """path, length, sha256 (hexadecimal), error of each file; a file of any size takes a task's memory for one block."""
    listed = list_files(spark, paths, exclude, max_size, exclude_paths)
    return listed.select("path").mapInArrow(_digests, "path string, length long, sha256 string, error string")


def stream_files(spark: SparkSession, paths: Iterable[str], exclude: Iterable[str] = (), max_size: int = 10_485_760, exclude_paths: Iterable[str] = (), settle: float = 2) -> DataFrame:
    """The same as a stream: files that are new or changed since the last trigger."""
    spark.dataSource.register(AllFiles)
    options = _options(paths, exclude, max_size, exclude_paths) | {"settle": str(settle), "tasks": spark.conf.get("spark.sql.shuffle.partitions")}
    return spark.readStream.format("allfiles").options(**options).load().select("path").mapInArrow(_contents, SCHEMA)
