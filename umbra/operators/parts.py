"""Files scanned in parts: byte ranges in tasks of their own, put together to what a scan of the whole file finds.

What the rules ask about a content comes from its parts: bytes are counted by value and
added up, so the entropy is that of the whole; a pattern whose matches are of bounded
length is searched in windows that reach as far beyond a part as a match that begins in
it can, and see as much before it as the pattern looks back.  Any other pattern can match
across any number of parts: it gets a task of its own, which searches the file where it
is mapped into memory and holds only the pages that it is at.  Patterns with the flag
``u`` need the file as text, so their task reads it whole (``whole_patterns`` names all
of these).  Files up to one part are scanned as ever.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterable
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.dialect import Pattern
from umbra.functions.entropy import entropy_of_counts
from umbra.operators.keys import is_blocked, is_safe
from umbra.operators.scanning import DECIDED, FINDING, finding, scan_contents
from umbra.plans.registry import ColumnStrategy, named
from umbra.profiles import BLOCKED, ENTROPY, HEX_EXCLUSION, HEX_LENGTH, LARGE_STRING, REDACTED, REGEX, SAFE, Profile
from umbra.sources.allfiles import list_files, read_listed

#: Bytes of a part, and of what a window may reach beyond it.
PART, REACH = 32 << 20, 1 << 20
_PIECE = 1 << 20


@lru_cache(maxsize=1024)
def reach(pattern: Pattern) -> tuple[int, int] | None:
    """(longest match, bytes it looks at beside it), or None if that has no bound or isn't known."""
    if pattern.unicode:
        return None
    try:
        from re import _constants, _parser
    except ImportError:  # another Python: files are searched whole
        return None
    tree = _parser.parse(pattern.python())
    longest, beside = tree.getwidth()[1], 2 + sum(_looks(tree, _parser.SubPattern, {_constants.ASSERT, _constants.ASSERT_NOT}))
    return (longest, beside) if longest + beside <= REACH else None


def _looks(item, group: type, asserts: set) -> Iterable[int]:
    """The widths of what assertions anywhere in a parsed pattern look at."""
    if isinstance(item, group):
        for op, argument in item.data:
            if op in asserts:
                yield argument[1].getwidth()[1]
            yield from _looks(argument, group, asserts)
    elif isinstance(item, (list, tuple)):
        for part in item:
            yield from _looks(part, group, asserts)


def _patterns(profile: Profile) -> list[Pattern]:
    """What the rules search for, each once."""
    used = {rule for _, rule in named(profile) if isinstance(rule, str)}
    found = [p for _, p in profile.patterns] if REGEX in used else []
    if ENTROPY in used and profile.entropy.enabled:
        found += [p for _, p in profile.entropy.exclusions]
    return list(dict.fromkeys(found))


def whole_patterns(profile: Profile) -> list[str]:
    """The patterns for which a file is searched as a whole, as they stand in the profile."""
    return [f"{p.body} {p.flags}".strip() for p in _patterns(profile) if reach(p) is None]


def found_in_part(content, start: int, end: int, pattern: Pattern) -> bool:
    """Does a match of a bounded pattern begin in this part of a content (bytes or a mapped file)?"""
    longest, beside = reach(pattern)
    first = max(0, start - beside)
    window = content[first : min(len(content), end + longest + beside)]
    match = pattern.compiled().search(window, start - first)
    # At the content's very end an empty match may begin where no part does.
    return match is not None and (match.start() + first < end or end == len(content))


def _found_whole(content: mmap.mmap, pattern: Pattern) -> bool:
    if pattern.unicode:
        return pattern.found_in(content[:])
    if pattern.needs.isascii() and content.find(pattern.needs.encode("latin-1")) < 0:
        return False
    return pattern.compiled().search(content) is not None


def _examined(patterns: list[Pattern], counted: bool):
    """path, length, found (places in ``patterns``), counts (of the 256 byte values) and failed, for each piece of work.

    A piece is a part (at = -1) or the whole file for one pattern (at = its place).
    """
    bounded = [i for i, p in enumerate(patterns) if reach(p) is not None]

    def run(iterator):
        import pyarrow as pa

        kinds = [("path", pa.string()), ("length", pa.int64()), ("found", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("failed", pa.bool_())]
        for batch in iterator:
            rows = []
            for path, length, at, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                found, counts = [], None
                try:
                    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as content:
                        if at >= 0:
                            found = [at] * _found_whole(content, patterns[at])
                        else:
                            end = min(end, len(content))
                            found = [i for i in bounded if found_in_part(content, start, end, patterns[i])]
                            if counted:
                                pieces = (np.frombuffer(content[i : min(i + _PIECE, end)], np.uint8) for i in range(start, end, _PIECE))
                                counts = sum((np.bincount(p, minlength=256) for p in pieces), np.zeros(256, np.int64))
                except (OSError, ValueError):  # gone, not readable, or empty by now
                    rows.append((path, length, [], None, True))
                    continue
                rows.append((path, length, found, counts, False))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows) if rows else [()] * 5, kinds)], [n for n, _ in kinds])

    return run


def _entropy(counts: str) -> Column:
    @F.pandas_udf("double")
    def entropy(counts):
        return counts.map(lambda c: entropy_of_counts(np.asarray(c)))

    return entropy(counts)


def _facts(large: DataFrame, patterns: list[Pattern], counted: bool, part: int, tasks: int) -> DataFrame:
    """path, length, found, entropy and failed of each file of (path, length)."""
    unbounded = [i for i, p in enumerate(patterns) if reach(p) is None]
    piece = lambda at, start, end: F.struct(at.cast("int").alias("at"), start.cast("long").alias("start"), end.cast("long").alias("end"))
    size = F.col("length")
    parts = F.transform(F.sequence(F.lit(0).cast("long"), size - 1, F.lit(part).cast("long")), lambda s: piece(F.lit(-1), s, F.least(s + part, size)))
    whole = F.array(*(piece(F.lit(i), F.lit(0), size) for i in unbounded)) if unbounded else F.array().cast("array<struct<at:int,start:bigint,end:bigint>>")
    work = large.select("path", "length", F.explode(F.concat(whole, parts)).alias("w")).select("path", "length", "w.at", "w.start", "w.end")
    # Parts of one file go to different tasks.
    seen = work.repartition(tasks, "path", "at", "start").mapInArrow(_examined(patterns, counted), "path string, length long, found array<int>, counts array<long>, failed boolean")
    # One row for what a piece found and one for each byte value in it: both are added up before the shuffle.
    values = F.filter(F.transform(F.coalesce("counts", F.array().cast("array<bigint>")), lambda n, v: F.struct(v.cast("int").alias("v"), n.alias("n"))), lambda x: x["n"] > 0)
    none = F.struct(F.lit(-1).alias("v"), F.lit(0).cast("long").alias("n"))
    rows = seen.select("path", "length", "found", "failed", F.explode(F.concat(F.array(none), values)).alias("x"))
    rows = rows.select("path", "length", F.when(F.col("x.v") < 0, F.col("found")).alias("found"), "failed", F.col("x.v").alias("v"), F.col("x.n").alias("n"))
    by_value = rows.groupBy("path", "length", "v").agg(F.sum("n").alias("n"), F.max("failed").alias("failed"), F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"))
    per_file = by_value.groupBy("path", "length").agg(
        F.sort_array(F.collect_list(F.when(F.col("v") >= 0, F.struct("v", "n"))))["n"].alias("counts"),
        F.max("failed").alias("failed"),
        F.flatten(F.collect_list("found")).alias("found"),
    )
    return per_file.withColumn("entropy", _entropy("counts") if counted else F.lit(None).cast("double"))


def scan_large(large: DataFrame, profile: Profile, part: int = PART, compat: bool = False) -> DataFrame:
    """``scan_contents`` of files (path, length) that are longer than ``part`` bytes, in parts of that size.

    Custom rules are columns over a whole content, so they need ``scan_contents``: a
    profile with one raises ValueError.  A file that is gone or can't be read by the time a
    task gets to it was skipped.  No files give no rows.
    """
    if any(isinstance(rule, ColumnStrategy) for _, rule in named(profile)):
        raise ValueError("a custom rule needs the whole content: use scan_contents")
    size, e = F.col("length"), profile.entropy
    cases: list[tuple[Column, bool, bool]] = []  # (when, leaves the replacement, leaves something else)
    asked = False  # does any rule that is reached ask about the content?
    patterns = _patterns(profile)
    hit = lambda p: F.array_contains("found", patterns.index(p))
    either = lambda found: reduce(Column.__or__, found, F.lit(False))
    for _, rule in named(profile) if profile.enabled else []:
        if rule == SAFE and is_safe("", profile):
            cases.append((F.lit(True), False, False))
            break
        if rule == BLOCKED and is_blocked("", profile):
            cases.append((F.lit(True), True, False))
            break
        if rule == LARGE_STRING and profile.max_value_length is not None:
            cases.append((size > profile.max_value_length, False, True))
            if profile.max_value_length <= part:  # so are all of these
                break
        elif rule == REGEX and profile.patterns:
            asked = True
            cases.append((either(hit(p) for _, p in profile.patterns), True, False))
        elif rule == ENTROPY and e.enabled:
            asked = True
            common = either(hit(p) & (size < HEX_LENGTH) if text == HEX_EXCLUSION else hit(p) for text, p in e.exclusions)
            cases.append(((size >= e.min_length) & ~common & (F.col("entropy") >= e.threshold), True, False))
    tasks = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if asked:
        counted = any(rule == ENTROPY for _, rule in named(profile)) and e.enabled
        facts = _facts(large, patterns, counted, part, tasks)
    else:
        facts = large.select("path", "length", F.lit(False).alias("failed"))
    whole, collapsed = F.lit(False), F.lit(False)
    for when, plain, other in reversed(cases):
        whole, collapsed = (F.when(when, F.lit(now)).otherwise(later) for now, later in ((plain, whole), (other, collapsed)))
    none = F.array().cast(f"array<{FINDING}>")
    if compat:
        found = F.when(whole & F.lit(profile.replacement == REDACTED), finding(*DECIDED["whole"], size, profile))
    else:
        found = F.when(whole, finding(*DECIDED["whole"], size, profile)).when(collapsed, finding(*DECIDED["large"], size, profile))
    return facts.select(
        "path",
        F.when(F.col("failed"), none).otherwise(F.coalesce(found, none)).alias("findings"),
        F.lit(profile.name).alias("profile"),
        F.col("failed").alias("skipped"),
        F.when(F.col("failed"), F.lit("File unreadable")).alias("error"),
    )


def scan_files(
    spark: SparkSession, paths: Iterable[str], profile: Profile, exclude: Iterable[str] = (), max_size: int = 10_485_760, exclude_paths: Iterable[str] = (), part: int = PART, compat: bool = False
) -> DataFrame:
    """``scan_contents`` of all files below ``paths``, those longer than ``part`` bytes in parts.

    A profile with custom rules has all its files read whole.  No part is shorter than
    the replacement, so a file that is nothing else is one part.
    """
    part = max(part, len(REDACTED), len(profile.replacement.encode()))
    listed = list_files(spark, paths, exclude, max_size, exclude_paths)
    if any(isinstance(rule, ColumnStrategy) for _, rule in named(profile)):
        return scan_contents(read_listed(listed), profile, compat=compat)
    small = scan_contents(read_listed(listed.where(F.col("length") <= part)), profile, compat=compat)
    return small.unionByName(scan_large(listed.where(F.col("length") > part), profile, part, compat))
