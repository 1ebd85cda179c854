"""Shannon entropy of a string's bytes, and the exclusions that come before it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions.dialect import search
from umbra.profiles import HEX_EXCLUSION, HEX_LENGTH, Entropy


def entropy_of(raw: bytes) -> float:
    """Bits a byte; 0.0 for up to one byte."""
    if len(raw) <= 1:
        return 0.0
    return entropy_of_counts(np.bincount(np.frombuffer(raw, dtype=np.uint8)))


def entropy_of_counts(counts: np.ndarray) -> float:
    """The same of how often each byte occurs, by value."""
    n = int(counts.sum())
    if n <= 1:
        return 0.0
    p = counts[counts > 0] / n
    return float(-(p * np.log2(p)).sum()) + 0.0


def raw_bytes(value: Column, charset: str = "UTF-8") -> Column:
    """A string's own bytes, valid or not; with one character a byte (``charset`` ISO-8859-1) what it stands for."""
    return value.cast("binary") if charset == "UTF-8" else F.encode(value, charset)


def byte_entropy_udf():
    """Over binary columns, in Arrow batches: numpy's counts are tens of times faster here than higher-order functions."""

    @F.pandas_udf("double")
    def byte_entropy(values):
        return values.map(lambda v: None if v is None else entropy_of(v))

    return byte_entropy


def byte_entropy(value: Column, charset: str = "UTF-8") -> Column:
    return byte_entropy_udf()(raw_bytes(value, charset))


def byte_entropy_native(value: Column) -> Column:
    """The same inside lambdas over arrays and maps, where Python functions can't be called."""
    n = F.octet_length(value)
    pairs = F.regexp_extract_all(F.hex(value.cast("binary")), F.lit("(..)"), F.lit(1))
    parts = F.transform(F.array_distinct(pairs), lambda d: F.size(F.filter(pairs, lambda x: x == d)) / n)
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p * F.log2(p))
    return F.when(n <= 1, F.lit(0.0)).otherwise(-total + F.lit(0.0))


def is_common_pattern(value: Column, settings: Entropy, length: Column | None = None, charset: str = "UTF-8", nested: bool = False, found_before=None) -> Column:
    """Does an exclusion match?  Long hexadecimal strings are not excluded as such.

    found_before: gives for a pattern what is known of it already, or None.
    """
    length = F.octet_length(value) if length is None else length
    found = F.lit(False)
    for text, pattern in settings.exclusions:
        hit = found_before(pattern) if found_before else None
        hit = search(value, pattern, charset, nested) if hit is None else hit
        found = found | ((hit & (length < HEX_LENGTH)) if text == HEX_EXCLUSION else hit)
    return found


def is_common_bytes(raw: bytes, settings: Entropy) -> bool:
    return any(p.found_in(raw) and not (text == HEX_EXCLUSION and len(raw) >= HEX_LENGTH) for text, p in settings.exclusions)
