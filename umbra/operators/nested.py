"""What only Python can say about strings inside arrays and maps, from Arrow's child buffers.

Lambdas over arrays can't call Python.  So before them, one function gets a container's
column as it is in Arrow, goes down to the strings' own buffer whatever the nesting,
looks at each string's bytes there once, and puts the lists' offsets back around the
answers.  A string's answer is a set of bits: is its entropy over the threshold, has it
one of the patterns where they are many (``many``), and else which patterns that Java
would overflow on does it have.  The work is linear in the
bytes, and no string is built as a Python object but for those patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.functions.dialect import Pattern
from umbra.functions.entropy import entropy_of
from umbra.functions.many import many, searcher
from umbra.plans.registry import resolve
from umbra.profiles import ENTROPY, REGEX, Profile

ENTROPY_BIT, FOUND_BIT = 1, 2
_DEEP_BIT = 4


def deep_patterns(profile: Profile) -> list[Pattern]:
    """The patterns that Python searches, of those that the profile's rules use."""
    rules = resolve(profile)
    found = [p for _, p in profile.patterns] if REGEX in rules and not many(profile.patterns) else []
    if ENTROPY in rules and profile.entropy.enabled:
        found += [p for _, p in profile.entropy.exclusions]
    return list(dict.fromkeys(p for p in found if p.deep))


def needed(profile: Profile) -> bool:
    return (ENTROPY in resolve(profile) and profile.entropy.enabled) or bool(deep_patterns(profile)) or bool(_sought(profile))


def _sought(profile: Profile) -> tuple[Pattern, ...]:
    """The profile's patterns, where they are many."""
    return tuple(p for _, p in profile.patterns) if REGEX in resolve(profile) and many(profile.patterns) else ()


def bit_of(profile: Profile, pattern: Pattern) -> int | None:
    deep = deep_patterns(profile)
    return _DEEP_BIT << deep.index(pattern) if pattern in deep else None


def told_type(kind: T.DataType) -> T.DataType | None:
    """The answers' type: numbers in place of strings, what holds none left out; maps as arrays of their values."""
    if isinstance(kind, T.StringType):
        return T.LongType()
    if isinstance(kind, T.ArrayType):
        inner = told_type(kind.elementType)
        return None if inner is None else T.ArrayType(inner)
    if isinstance(kind, T.MapType):
        inner = told_type(kind.valueType)
        return None if inner is None else T.ArrayType(inner)
    if isinstance(kind, T.StructType):
        parts = [(f"f{i}", told_type(f.dataType)) for i, f in enumerate(kind.fields)]
        fields = [T.StructField(n, k) for n, k in parts if k is not None]
        return T.StructType(fields) if fields else None
    return None


def _strings(values, deep: list[Pattern], sought: tuple[Pattern, ...], entropy: bool, least: int, threshold: float):
    """Bits for each string of an Arrow array."""
    import numpy as np
    import pyarrow as pa

    wide = pa.types.is_large_string(values.type)
    _, offsets, data = values.buffers()
    width = np.int64 if wide else np.int32
    n = len(values)
    at = np.frombuffer(offsets, dtype=width, count=n + 1, offset=values.offset * width().itemsize) if offsets is not None and n else np.zeros(n + 1, dtype=width)
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = np.asarray(values.is_valid()) if values.null_count else np.ones(n, dtype=bool)
    bits = np.zeros(n, dtype=np.int64)
    for i in np.flatnonzero(valid):
        raw = view[at[i] : at[i + 1]]
        if entropy and len(raw) >= least and entropy_of(raw) >= threshold:
            bits[i] = ENTROPY_BIT
        for k, pattern in enumerate(deep):
            if pattern.found_in(bytes(raw)):
                bits[i] |= _DEEP_BIT << k
        if sought and searcher(sought).found_in(bytes(raw)):
            bits[i] |= FOUND_BIT
    return pa.array(bits)


def _told(values, of_strings):
    """The answers to a nested Arrow array; None where it holds no strings."""
    import pyarrow as pa

    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return of_strings(values)
    if pa.types.is_map(kind) or pa.types.is_list(kind) or pa.types.is_large_list(kind):
        child = values.items if pa.types.is_map(kind) else values.values
        inner = _told(child, of_strings)
        if inner is None:
            return None
        make = pa.LargeListArray if pa.types.is_large_list(kind) else pa.ListArray
        lists = make.from_arrays(values.offsets, inner)  # offsets into the whole child, slices of it included
        return pa.compute.if_else(values.is_valid(), lists, pa.scalar(None, lists.type)) if values.null_count else lists
    if pa.types.is_struct(kind):
        parts = [(f"f{i}", _told(values.field(i), of_strings)) for i in range(kind.num_fields)]  # a null struct's strings are null or unused
        parts = [(n, p) for n, p in parts if p is not None]
        return pa.StructArray.from_arrays([p for _, p in parts], [n for n, _ in parts]) if parts else None
    return None


def told(value: Column, kind: T.DataType, profile: Profile) -> Column | None:
    """A column of answers shaped like ``value``; None where Python has nothing to say."""
    answers = told_type(kind)
    if answers is None or not needed(profile):
        return None
    deep, sought, e = deep_patterns(profile), _sought(profile), profile.entropy
    entropy = ENTROPY in resolve(profile) and e.enabled
    least, threshold = e.min_length, e.threshold

    @F.arrow_udf(answers)
    def look(values):
        import pyarrow.compute  # noqa: F401

        return _told(values, lambda s: _strings(s, deep, sought, entropy, least, threshold))

    return look(value)
