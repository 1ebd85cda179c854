"""Documents of a known shape, masked in the engine: what document mode gives, without Python.

A shape is a document's keys in their order with the kinds of its values.  Under a shape
every key, index and container size is known while the plan is built: which of them are
safe, blocked or oversized is decided there, by the rules of ``document``, and only
strings are looked at row by row.  The masked JSON is put together from the values'
texts, so keys keep their order and numbers their spelling.

Which rows have a shape is proved, not assumed: a row is parsed by the shape's schema
and spelled again, and that has to be the document itself up to spaces behind commas
and colons.  A row without a shape, or with a value that the two spellers may write
differently (escapes by number, exponents, long fractions), goes to document mode.
So the shapes that are looked for only say how fast it goes, never what comes out.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.operators.document import encode, mask_json, told_documents
from umbra.operators.keys import is_blocked, is_safe
from umbra.operators.reports import observed as observed_rows
from umbra.operators.rules import BLOCK, branches, chosen, decision, hits
from umbra.plans.registry import ColumnStrategy, PyStrategy, resolve
from umbra.profiles import BLOCKED, LARGE_OBJECT, REMOVE, SAFE, Profile

#: Rows that shapes are looked for in, and how many of the most frequent shapes are compiled.
SHAPE_ROWS, SHAPES = 10_000, 2
#: Nodes of a shape: larger documents stay in document mode.
NODES = 400
#: Fractions that both spellers write alike: at most fifteen digits, no exponent, no closing zero.
_FRACTION = r"^-?(0|[1-9][0-9]{0,6})\.(0|[0-9]{0,7}[1-9])$"
_OWN = ("_redacted", "_redacted_keys", "_corrupt_record")
_NAME = "_umbra_record"


class Unfit(Exception):
    """A shape that isn't compiled."""


@dataclass(frozen=True)
class Node:
    kind: str  # object, list, string, long, double, boolean
    names: tuple[str, ...] = ()
    parts: tuple[Node, ...] = ()

    @property
    def type(self) -> T.DataType:
        if self.kind == "object":
            return T.StructType([T.StructField(n, p.type) for n, p in zip(self.names, self.parts)])
        if self.kind == "list":
            return T.ArrayType(self.parts[0].type if self.parts else T.StringType())
        return {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[self.kind]

    @property
    def size(self) -> int:
        return 1 + sum(p.size for p in self.parts)


def _object(names: list[str], parts: list[Node]) -> Node:
    low = [n.lower() for n in names]
    if not names or len(set(low)) < len(low) or any(n in _OWN for n in names):
        raise Unfit
    return Node("object", tuple(names), tuple(parts))


def shape_of(value: Any) -> Node:
    """The shape of a decoded document."""
    if isinstance(value, dict):
        return _object(list(value), [shape_of(v) for v in value.values()])
    if isinstance(value, list):
        parts = [shape_of(v) for v in value]
        if len({p.type.json() for p in parts}) > 1:
            raise Unfit
        return Node("list", (), tuple(parts))
    if isinstance(value, bool):
        return Node("boolean")
    if isinstance(value, int):
        return Node("long")
    return Node("double" if isinstance(value, float) else "string")


def shape_of_type(kind: T.DataType) -> Node:
    """The shape of all values of a struct type without arrays and maps."""
    if isinstance(kind, T.StructType):
        return _object([f.name for f in kind.fields], [shape_of_type(f.dataType) for f in kind.fields])
    found = {T.StringType: "string", T.ByteType: "long", T.ShortType: "long", T.IntegerType: "long", T.LongType: "long", T.DoubleType: "double", T.BooleanType: "boolean"}.get(type(kind))
    if found is None:
        raise Unfit
    return Node(found)


def observed(df: DataFrame, column: str, rows: int = SHAPE_ROWS, most: int = SHAPES) -> list[Node]:
    """The most frequent shapes among ``rows`` rows; a job of its own.

    The engine's VARIANT tells shapes apart; of each, the shortest document reaches the driver.
    """
    text = F.col(column)
    seen = df.select(text.alias("t")).where("t is not null").limit(rows)
    told = seen.select("t", F.schema_of_variant(F.try_parse_json("t")).alias("s"), F.json_object_keys("t").alias("k")).where("s is not null and k is not null")
    found = told.groupBy("s", "k").agg(F.count("*").alias("n"), F.min_by("t", F.struct(F.octet_length("t"), "t")).alias("t")).orderBy(F.desc("n"), "t").limit(most).collect()
    out = []
    for r in found:
        try:
            shape = shape_of(json.loads(r.t))
        except (Unfit, ValueError, RecursionError):
            continue
        if shape.kind == "object" and shape.size <= NODES:
            out.append(shape)
    return out


@dataclass
class Compiled:
    """A shape's plan: columns of two earlier projections, the document's parts, and what has to hold for a row."""

    profile: Profile
    name: str
    compat: bool
    texts_checked: bool  # does the caller hold the texts against their spelling?
    early: list[Column] = field(default_factory=list)
    staged: list[Column] = field(default_factory=list)
    guards: list[Column] = field(default_factory=list)
    hit: list[Column] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    redacted: bool = False

    def document(self, shape: Node, value: Column) -> Column:
        parts = self._walk(shape, value)
        if len(parts) == 1:
            raise Unfit  # taken as a whole
        p, mark = self.profile, ""
        if p.mark_redacted:
            mark = ',"_redacted":true'
            if p.track_redacted_keys and self.keys:
                mark += ',"_redacted_keys":' + self._spelled(self.keys)
        if self.redacted:
            parts.insert(-1, mark)
        elif self.hit and mark:
            parts.insert(-1, F.when(reduce(Column.__or__, self.hit), F.lit(mark)).otherwise(F.lit("")))
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in self._merged(parts)))

    def _merged(self, parts: list) -> list:
        out: list = []
        for p in parts:
            if isinstance(p, str) and out and isinstance(out[-1], str):
                out[-1] += p
            else:
                out.append(p)
        return out

    def _spelled(self, value: Any) -> str:
        return encode(value, self.compat, True)

    def _static(self, node: Node, key: str) -> Any:
        """What the first rule that matches makes of a value that is no string, or None."""
        p = self.profile
        for rule in resolve(p):
            if rule == SAFE and is_safe(key, p):
                return None
            if rule == BLOCKED and is_blocked(key, p):
                self.redacted = True
                if key not in self.keys:
                    self.keys.append(key)
                return p.replacement
            if rule == LARGE_OBJECT and p.redact_large_objects and node.kind in ("object", "list") and len(node.parts) > p.max_object_size:
                self.redacted = True
                return {"_large_object_redacted": f"{p.replacement} (Array with {len(node.parts)} items)"}
        return None

    def _walk(self, node: Node, value: Column) -> list:
        """The texts of a container, tried without a key and then entry by entry."""
        new = self._static(node, "")
        if new is not None:
            return [self._spelled(new if isinstance(new, dict) else {"_redacted_array": new})]
        self.guards.append(value.isNotNull())
        if node.kind == "list":
            self.guards.append(F.size(value) == len(node.parts))
        elif self.compat and list(node.names) == [str(i) for i in range(len(node.names))]:
            raise Unfit
        out: list = ["{" if node.kind == "object" else "["]
        for i, part in enumerate(node.parts):
            key = node.names[i] if node.kind == "object" else str(i)
            out.append(("," if i else "") + (self._spelled(key) + ":" if node.kind == "object" else ""))
            out += self._entry(part, value.getField(key) if node.kind == "object" else F.get(value, F.lit(i)), key)
        return [*out, "}" if node.kind == "object" else "]"]

    def _entry(self, node: Node, value: Column, key: str) -> list:
        if node.kind == "string":
            return [self._string(value, key)]
        new = self._static(node, key)
        if new is not None:
            return [self._spelled(new)]
        if node.parts or node.kind == "list":
            return self._walk(node, value)
        text = value.cast("string")
        if node.kind == "double":
            plain = text.rlike(_FRACTION) & ~text.endswith(".0") if self.compat else text.rlike(_FRACTION)
            self.guards.append(value.isNull() | plain)
        return [F.coalesce(text, F.lit("null"))]

    def _string(self, value: Column, key: str) -> Column | str:
        p = self.profile
        found = branches(value, key, T.StringType(), p)
        if any(b.what == BLOCK and b.when is not True for b in found) or (len(found) > 1 and found[-1].what == BLOCK):
            raise Unfit  # blocked only if nothing before matches
        if found and found[0].what == BLOCK:
            self._static(Node("string"), key)
            return self._spelled(p.replacement)
        if not self.texts_checked:
            odd = r"[\x00-\x07\x0b\x0e-\x1f]" if not self.compat else r"[\x00-\x07\x0b\x0e-\x1f]|[^\x00-\x7f]"
            self.guards.append(value.isNull() | ~value.rlike(odd))
            self.guards.append(value.isNull() | (F.is_valid_utf8(value) & (value != REMOVE)))
        new = value
        if hits(found):
            at = self._stage(decision(found, value, p, stage=self._first))
            self.hit.append(F.coalesce(at.isin(*hits(found)), F.lit(False)))
            new = chosen(value, [(at == i, found[i - 1].value) for i in hits(found)])
        text = F.to_json(F.array(new))
        return F.coalesce(F.when(new.isNotNull(), F.substring(text, 2, F.length(text) - 2)), F.lit("null"))

    def _first(self, value: Column) -> Column:
        name = f"{self.name}_early_{len(self.early)}"
        self.early.append(value.alias(name))
        return F.col(name)

    def _stage(self, value: Column) -> Column:
        name = f"{self.name}_{len(self.staged)}"
        self.staged.append(value.alias(name))
        return F.col(name)


def _normal(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(": "), F.lit(":")), F.lit(", "), F.lit(","))


def native(profile: Profile) -> bool:
    """Can the engine say all of a profile's rules?"""
    return profile.enabled and not any(isinstance(r, PyStrategy) for r in resolve(profile)) and not any(isinstance(r, ColumnStrategy) for r in resolve(profile))


def mask_documents(
    df: DataFrame, column: str, profile: Profile, out: str | None = None, compat: bool = False, shapes: list[Node] | None = None, observation: Observation | str | None = None
) -> DataFrame:
    """``df`` with the JSON documents of ``column`` masked in ``out`` (default: in place).

    Gives what ``document.mask_json`` gives for every row: nulls, what can't be decoded
    and any other shape included.  ``shapes`` are those to compile; without them the
    most frequent ones are looked for (not in streams, where there are none unless given).
    observation: is filled with the rows and those whose document can't be decoded, under
    the name of the policy that they met (see ``reports``).
    """
    out = out or column
    name = f"`{column}`"
    if shapes is None:
        shapes = [] if df.isStreaming or not native(profile) else observed(df, name)
    told = F.col(f"{_NAME}_told")
    policy = f"undecodable: {profile.non_redactable_object_behavior}"
    seen = lambda d: observed_rows(d, observation, [(column, policy, told["bad"])])
    if not shapes or not native(profile):
        if observation is None:
            return df.withColumn(out, mask_json(F.col(name), profile, compat))
        told_df = seen(df.withColumn(f"{_NAME}_told", told_documents(F.col(name), profile, compat)))
        return told_df.withColumn(out, told["v"].cast("string")).drop(f"{_NAME}_told")
    text, columns = F.col(name), df.columns
    staged = df.select("*", *(F.from_json(text, s.type).alias(f"{_NAME}_parsed_{i}") for i, s in enumerate(shapes)))
    plans = []
    for i, shape in enumerate(shapes):
        value = F.col(f"{_NAME}_parsed_{i}")
        if (made := compiled(profile, shape, value, i, compat, True)) is None:
            continue
        plan, document = made
        same = _normal(text) == _normal(F.to_json(value, {"ignoreNullFields": "false"}))
        plain = F.is_valid_utf8(text) & ~text.contains("\\u") & ~text.contains(REMOVE)
        if compat:
            plain = plain & ~text.rlike(r"[^\x00-\x7f]")
        plan.guards = [same, plain, *plan.guards]
        plans.append((plan, F.replace(document, F.lit("/"), F.lit("\\/")) if compat else document))
    if observation is None:
        return finished(staged, plans, columns, out, lambda open_: mask_json(F.when(open_, text), profile, compat))
    between = lambda d: seen(d.withColumn(f"{_NAME}_told", told_documents(F.when(F.col(_NAME) < 0, text), profile, compat)))
    return finished(staged, plans, columns, out, lambda open_: told["v"].cast("string"), between)


def compiled(profile: Profile, shape: Node, value: Column, number: int, compat: bool, texts_checked: bool) -> tuple[Compiled, Column] | None:
    """A shape's plan and the masked document; None if it can't be compiled."""
    plan = Compiled(profile, f"{_NAME}_{number}", compat, texts_checked)
    try:
        return plan, plan.document(shape, value)
    except Unfit:
        return None


def finished(df: DataFrame, plans: list[tuple[Compiled, Column]], columns: list[str], out: str, rest: Callable[[Column], Column], between: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """``df`` with ``out``: the document of the first plan that fits a row, else what ``rest`` makes of the rows still open.

    between: a step once it is known which rows are open.
    """
    which = F.lit(-1)
    for i, (plan, _) in reversed(list(enumerate(plans))):
        which = F.when(F.coalesce(reduce(Column.__and__, plan.guards), F.lit(False)), F.lit(i)).otherwise(which)
    df = df.withColumn(_NAME, which)
    for stage in ([c for p, _ in plans for c in p.early], [c for p, _ in plans for c in p.staged]):
        df = df.select("*", *stage) if stage else df
    df = between(df)
    result = rest(F.col(_NAME) < 0)  # Python gets nulls for what is done
    for i, (_, document) in enumerate(plans):
        result = F.when(F.col(_NAME) == i, document).otherwise(result)
    df = df.withColumn(f"{_NAME}_out", result)
    return df.select(*((F.col(f"{_NAME}_out").alias(c) if c == out else F.col(f"`{c}`")) for c in columns), *([] if out in columns else [F.col(f"{_NAME}_out").alias(out)]))
