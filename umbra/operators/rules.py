"""The chain of rules as Spark expressions: the first that matches decides."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.functions.dialect import Pattern, search
from umbra.functions.entropy import byte_entropy_native, entropy_of, is_common_pattern, raw_bytes
from umbra.functions.many import any_found_udf, many
from umbra.operators.keys import blocked_column, is_blocked, is_safe, safe_column
from umbra.operators.nested import ENTROPY_BIT, FOUND_BIT, bit_of
from umbra.plans.registry import ColumnStrategy, named
from umbra.profiles import BLOCKED, ENTROPY, LARGE_OBJECT, LARGE_STRING, REGEX, REMOVE, SAFE, Profile

#: What a branch of the chain does with a value.
KEEP, BLOCK, REPLACE, OVERSIZE, REMOVED = "keep", "block", "replace", "oversize", "removed"
#: A column that holds decisions for a while.
DECISION = "_umbra_decision"


@dataclass
class Branch:
    """One rule at one place: when, and what then.  ``when`` True is known at plan time.

    ``entropy``: ``when`` is only what comes before the entropy itself is looked at.
    ``plain``: the value is the profile's replacement.  ``rule``: its name, for reports.
    """

    when: Column | bool
    what: str
    value: Column | None = None
    note: Column | None = None
    entropy: bool = False
    plain: bool = False
    rule: str = ""


@dataclass(frozen=True)
class Text:
    """How strings stand for bytes: as UTF-8, or (file contents) one character a byte."""

    charset: str = "UTF-8"

    def length(self, value: Column) -> Column:
        return F.octet_length(value) if self.charset == "UTF-8" else F.length(value)


def _known(profile: Profile, told: Column | None):
    """For a pattern what Python has said about it already (see ``nested``), or None."""

    def found(pattern: Pattern) -> Column | None:
        bit = None if told is None else bit_of(profile, pattern)
        return None if bit is None else told.bitwiseAND(F.lit(bit)) != 0

    return found


def pattern_found(value: Column, profile: Profile, text: Text = Text(), nested: bool = False, told: Column | None = None) -> Column:
    patterns = tuple(p for _, p in profile.patterns)
    if many(patterns) and told is not None:
        return told.bitwiseAND(F.lit(FOUND_BIT)) != 0
    if many(patterns) and not nested:
        return any_found_udf(patterns)(raw_bytes(value, text.charset))
    known = _known(profile, told)
    hit = lambda p: search(value, p, text.charset, nested) if (said := known(p)) is None else said
    return reduce(Column.__or__, (hit(p) for _, p in profile.patterns), F.lit(False))


def entropy_worth(value: Column, profile: Profile, text: Text, nested: bool, told: Column | None = None) -> Column:
    """Long enough and not excluded: worth looking at the entropy."""
    e = profile.entropy
    return (text.length(value) >= e.min_length) & ~is_common_pattern(value, e, text.length(value), text.charset, nested, _known(profile, told))


def entropy_decided(code: Column, value: Column, rest: Column, at: int, threshold: float, charset: str) -> Column:
    """``code``, where that is -1 ``at`` or (the entropy being too low) ``rest``.

    Python functions run for every row, whatever CASE they stand in: so this one gets
    the decision so far, and a text only where that is open.
    """

    @F.pandas_udf("int")
    def decided(codes, texts, rests):
        out = codes.to_numpy(copy=True)
        for i in (out == -1).nonzero()[0]:
            out[i] = at if entropy_of(texts.iat[i]) >= threshold else rests.iat[i]
        return type(codes)(out)

    return decided(code, raw_bytes(F.when(code == -1, value), charset), rest)


def branches(value: Column, key: str | Column, kind: T.DataType, profile: Profile, text: Text = Text(), nested: bool = False, told: Column | None = None) -> list[Branch]:
    """The rules that can match a value of type ``kind`` under ``key``, up to one that always does.

    told: inside arrays and maps, the bits that ``nested`` has for the value.
    """
    out: list[Branch] = []
    literal = isinstance(key, str)
    replacement = F.lit(profile.replacement)
    for name, rule in named(profile):
        made: Branch | None = None
        if isinstance(rule, ColumnStrategy) and rule.removes:
            # A text without a key is its own root, of which the marker is left.
            marker = F.lit(REMOVE) if isinstance(kind, T.StringType) and isinstance(key, str) and not key else F.lit(None).cast(kind)
            made = Branch(rule.predicate(value, key, kind, profile), REMOVED, marker)
        elif isinstance(rule, ColumnStrategy):
            made = Branch(rule.predicate(value, key, kind, profile), REPLACE, rule.replace(value, key, kind, profile))
        elif rule == SAFE:
            made = Branch(is_safe(key, profile) if literal else safe_column(key, profile), KEEP)
        elif rule == BLOCKED:
            made = Branch(is_blocked(key, profile) if literal else blocked_column(key, profile), BLOCK, replacement, plain=True)
        elif rule == LARGE_OBJECT and profile.redact_large_objects:
            if isinstance(kind, T.StructType):
                n = len(kind.fields)
                made = Branch(n > profile.max_object_size, OVERSIZE, note=F.lit(f"{profile.replacement} (Object struct with {n} properties)"))
            elif isinstance(kind, (T.ArrayType, T.MapType)):
                note = F.format_string("%s (Array with %d items)", replacement, F.size(value))
                made = Branch(F.size(value) > profile.max_object_size, OVERSIZE, note=note)
        elif isinstance(kind, T.StringType):
            if rule == LARGE_STRING and profile.max_value_length is not None:
                n = text.length(value)
                made = Branch(n > profile.max_value_length, REPLACE, F.format_string("%s (String with %d characters)", replacement, n))
            elif rule == REGEX and profile.patterns:
                made = Branch(pattern_found(value, profile, text, nested, told), REPLACE, replacement, plain=True)
            elif rule == ENTROPY and profile.entropy.enabled:
                made = Branch(entropy_worth(value, profile, text, nested, told), REPLACE, replacement, entropy=True, plain=True)
        if made is None or made.when is False:
            continue
        made.rule = name
        out.append(made)
        if made.when is True:
            break
    return out


def _first(found: list[Branch], start: int, other: Column) -> Column:
    """The number, from ``start``, of the first branch that matches."""
    out = None
    for i, b in enumerate(found, start):
        when = F.lit(True) if b.when is True else b.when
        out = F.when(when, F.lit(i)) if out is None else out.when(when, F.lit(i))
    return other if out is None else out.otherwise(other)


def decision(found: list[Branch], value: Column, profile: Profile, text: Text = Text(), nested: bool = False, stage=lambda c: c, told: Column | None = None) -> Column:
    """Which branch matches, from 1; 0 for none.

    What is decided before entropy is used twice; ``stage`` may make it a column of an
    earlier projection, so that each pattern stands in the plan once.
    """
    at = next((i for i, b in enumerate(found) if b.entropy), None)
    if at is None:
        return _first(found, 1, F.lit(0))
    limit, rest = profile.entropy.threshold, _first(found[at + 1 :], at + 2, F.lit(0))
    if nested:  # lazily evaluated
        high = byte_entropy_native(value) >= limit if told is None else told.bitwiseAND(F.lit(ENTROPY_BIT)) != 0
        reached = replace(found[at], when=found[at].when & high)
        return _first([*found[:at], reached, *found[at + 1 :]], 1, F.lit(0))
    code = stage(_first([*found[:at]], 1, F.when(found[at].when, F.lit(-1)).otherwise(rest)))
    return entropy_decided(code, value, rest, at + 1, limit, text.charset)


def hits(found: list[Branch]) -> list[int]:
    """The numbers of the branches that change a value."""
    return [i for i, b in enumerate(found, 1) if b.what != KEEP]


def replaced(value: Column, found: list[Branch], at: Column) -> Column:
    """``value`` by the branch of number ``at``."""
    return chosen(value, [(at == i, found[i - 1].value) for i in hits(found)])


def mask_text(value: Column, profile: Profile, key: str = "", text: Text = Text()) -> Column:
    """A string column as a scalar under ``key``, masked."""
    if not profile.enabled:
        return value
    found = branches(value, key, T.StringType(), profile, text)
    return replaced(value, found, decision(found, value, profile, text)) if hits(found) else value


def text_matched(value: Column, profile: Profile, key: str = "", text: Text = Text()) -> Column:
    """Is a string column masked under ``key``?"""
    found = branches(value, key, T.StringType(), profile, text) if profile.enabled else []
    return decision(found, value, profile, text).isin(*hits(found)) if hits(found) else F.lit(False)


def with_masked(df: DataFrame, value: Column, profile: Profile, masked: str, matched: str, key: str = "", text: Text = Text()) -> DataFrame:
    """``df`` with the masked text and whether it was masked, by one decision a row."""
    found = branches(value, key, T.StringType(), profile, text) if profile.enabled else []
    if not hits(found):
        return df.withColumns({masked: value, matched: F.lit(False)})
    at = F.col(DECISION)
    df = with_decision(df, found, value, profile, text)
    return df.withColumns({masked: replaced(value, found, at), matched: at.isin(*hits(found))}).drop(DECISION)


def with_decision(df: DataFrame, found: list[Branch], value: Column, profile: Profile, text: Text = Text()) -> DataFrame:
    """``df`` with the column DECISION, in two projections."""
    early: list[Column] = []

    def stage(code: Column) -> Column:
        early.append(code.alias(DECISION + "_early"))
        return F.col(DECISION + "_early")

    made = decision(found, value, profile, text, stage=stage)
    return df.select("*", *early).withColumn(DECISION, made).drop(DECISION + "_early")


def chosen(value: Column, cases: list[tuple[Column | bool, Column | None]]) -> Column:
    """One flat CASE; None keeps the value."""
    out = None
    for when, new in cases:
        when, new = F.lit(True) if when is True else when, value if new is None else new
        out = F.when(when, new) if out is None else out.when(when, new)
    return value if out is None else out.otherwise(value)
