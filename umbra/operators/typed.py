"""Typed mode: a DataFrame in, a DataFrame out, masked by column expressions.

Keys that the schema names are decided while the plan is built and cost nothing a row;
what is left is a CASE for each string leaf.  Masking is narrow: no exchange, and
columns that aren't used later are pruned with their masks.

A static schema can't hold markers in place of containers: an oversized array, map or
struct, and a blocked value inside an array or map whose elements aren't strings,
become null; messages of oversized containers that the schema's names reach are in
``_redaction_notes`` (path to message).  A blocked column of another type becomes a
string.  ``_redacted`` is always there if the profile marks, ``_redacted_keys`` if it
also tracks; each takes the place of an input column of its name, as do the notes
(names are the same as the session's ``caseSensitive`` says).

A VARIANT's contents, which no schema names, are masked as a document's; inside arrays
and maps only key rules reach one.

Which rule takes a leaf is decided once a row: decisions are columns of a projection of
their own, values, flags and keys of the next.  Inside arrays and maps an element's
value, flag and keys are made together, with what Python says of their strings (see
``nested``) before.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.operators.document import mask_variant
from umbra.operators.keys import is_blocked
from umbra.operators.nested import told, told_type
from umbra.operators.rules import BLOCK, DECISION, KEEP, OVERSIZE, REMOVED, Branch, branches, chosen, decision, hits
from umbra.operators.reports import observed
from umbra.plans.registry import ColumnStrategy, resolve
from umbra.profiles import BLOCKED, SAFE, Profile

REDACTED, KEYS, NOTES = "_redacted", "_redacted_keys", "_redaction_notes"
#: What a report says of values masked somewhere inside an array, a map or a VARIANT.
INSIDE = "inside"


@dataclass
class Masked:
    """A masked value, whether anything in it was masked, its blocked keys and its notes."""

    value: Column
    redacted: list[Column] = field(default_factory=list)
    keys: list[Column] = field(default_factory=list)  # arrays of names, in order
    notes: list[tuple[str, Column]] = field(default_factory=list)  # path, message or null
    same: bool = False  # nothing here can ever be masked
    gone: bool = False  # the field is left out


def _any(columns: list[Column]) -> Column:
    return reduce(Column.__or__, (F.coalesce(c, F.lit(False)) for c in columns), F.lit(False))


def _names(columns: list[Column]) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(empty, *columns)) if columns else empty


def _let(value: Column, make) -> Column:
    """``make(value)`` with ``value`` evaluated once, where no projection can come before."""
    return F.transform(F.array(value), make)[0]


def _packed(value: Column, redacted: Column, keys: Column, gone: Column | None = None) -> Column:
    no = F.lit(False)
    return F.struct(value.alias("v"), F.coalesce(redacted, no).alias("r"), keys.alias("k"), F.coalesce(no if gone is None else gone, no).alias("x"))


def _struct(columns: list[Column]) -> Column:
    return F.struct(*columns) if columns else F.expr("named_struct()")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Masker:
    def __init__(self, profile: Profile):
        self.profile = profile
        self.tracks = profile.mark_redacted and profile.track_redacted_keys
        self.index_rules = any(r not in (SAFE, BLOCKED) for r in resolve(profile)) or any("*" in k or k.isdigit() for k in profile.blocked_keys)
        self.removes = any(isinstance(r, ColumnStrategy) and r.removes for r in resolve(profile))
        self.counts: list[tuple[str, str, Column]] = []  # path, rule, did it take the row's value
        self.early: list[Column] = []
        self.staged: list[Column] = []

    def _early(self, value: Column) -> Column:
        """A column of the first projection."""
        name = f"{DECISION}_early_{len(self.early)}"
        self.early.append(value.alias(name))
        return F.col(name)

    def _stage(self, value: Column) -> Column:
        """A column of the second projection."""
        name = f"{DECISION}_{len(self.staged)}"
        self.staged.append(value.alias(name))
        return F.col(name)

    def mask(self, value: Column, kind: T.DataType, key: str, path: str) -> Masked:
        """A value that the schema's names reach."""
        found = branches(value, key, kind, self.profile)
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return self._container(value, kind, key, path, found)
        if isinstance(kind, T.VariantType) and not (found and found[0].when is True and found[0].what != KEEP):
            return self._variant(value, key, path)
        if not hits(found):
            return Masked(value, same=True)
        if found[0].when is True:
            return self._fixed(found[0], key, path)
        at = self._stage(decision(found, value, self.profile, stage=self._early))
        self.counts += [(path, found[i - 1].rule, at == i) for i in hits(found)]
        out = chosen(value, [(at == i, found[i - 1].value) for i in hits(found)])
        keys = [self._key(at == i, key) for i in hits(found) if found[i - 1].what == BLOCK] if self.tracks else []
        return Masked(out, [at.isin(*hits(found))], keys)

    def _variant(self, value: Column, key: str, path: str) -> Masked:
        """Contents that no schema names, masked as a document is."""
        said = self._early(mask_variant(value, key, self.profile))
        redacted = F.coalesce(said["r"], F.lit(False))
        self.counts.append((path, INSIDE, redacted))
        return Masked(F.parse_json(said["v"].cast("string")), [redacted], [said["k"]] if self.tracks else [])

    def element(self, value: Column, kind: T.DataType, key: str | Column, said: Column | None = None) -> Column | None:
        """(value, was it masked, blocked keys) inside an array or map; None if nothing there can ever be masked.

        said: what ``nested.told`` has for the value.
        """
        found = branches(value, key, kind, self.profile, nested=True, told=said if isinstance(kind, T.StringType) else None)
        none, no = F.array().cast("array<string>"), F.lit(False)
        fixed = isinstance(key, str) or isinstance(kind, T.StringType)  # else an element can't change its type
        named = (lambda b: self._key(None, key) if b.what == BLOCK and self.tracks else none)
        new = lambda b: b.value if fixed and b.value is not None else F.lit(None).cast(kind)
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return self._element_container(value, kind, key, found, named, new, said)
        if not hits(found):
            return None
        if found[0].when is True:
            return _packed(new(found[0]), F.lit(True), named(found[0]), F.lit(found[0].what == REMOVED))

        def made(at: Column) -> Column:
            cases = [(at == i, found[i - 1]) for i in hits(found)]
            gone = [i for i in hits(found) if found[i - 1].what == REMOVED]
            return _packed(
                chosen(value, [(c, new(b)) for c, b in cases]), at.isin(*hits(found)), chosen(none, [(c, named(b)) for c, b in cases if b.what == BLOCK]), at.isin(*gone) if gone else None
            )

        return _let(decision(found, value, self.profile, nested=True, told=said), made)

    def _element_container(self, value, kind, key, found: list[Branch], named, new, said: Column | None) -> Column | None:
        none, no, there = F.array().cast("array<string>"), F.lit(False), value.isNotNull()
        again = branches(value, "", kind, self.profile, nested=True)
        for b in (*found[:1], *again[:1]):
            if b.when is True and b.what != KEEP:
                sure = b.what in (BLOCK, REMOVED)
                return _packed(new(b) if sure else F.lit(None).cast(kind), F.lit(True) if sure else there, named(b), F.lit(b.what == REMOVED))
        inner = self._elements_inside(value, kind, said)
        tests = self._tests(found, again)
        if inner is None and not tests:
            return None

        def made(o: Column) -> Column:
            cases = [(F.coalesce(w, no), b) for w, b in tests]
            v, r, k, x = o["v"], o["r"], o["k"], F.lit(False)
            for when, b in reversed(cases):
                v, r, k, x = F.when(when, F.lit(None)).otherwise(v), when | r, F.when(when, named(b)).otherwise(k), F.when(when, F.lit(b.what == REMOVED)).otherwise(x)
            return _packed(v, r, k, x)

        return _let(_packed(value, no, none) if inner is None else inner, made)

    def _elements_inside(self, value: Column, kind: T.DataType, said: Column | None) -> Column | None:
        """A container's packed elements put together again."""
        none, no = F.array().cast("array<string>"), F.lit(False)
        if isinstance(kind, T.StructType):
            of = lambda i, f: None if said is None or told_type(f.dataType) is None else said[f"f{i}"]
            parts = [self.element(value[f.name], f.dataType, f.name, of(i, f)) for i, f in enumerate(kind.fields)]
            if all(p is None for p in parts):
                return None
            some = [i for i, p in enumerate(parts) if p is not None]

            left = [(i, f) for i, f in enumerate(kind.fields) if not self._gone(value[f.name], f.dataType, f.name)]

            def made(o: Column) -> Column:
                built = _struct([(value[f.name] if parts[i] is None else o[f"p{i}"]["v"]).alias(f.name) for i, f in left])
                there = value.isNotNull()
                return _packed(F.when(there, built), there & _any([o[f"p{i}"]["r"] for i in some]), F.when(there, _names([o[f"p{i}"]["k"] for i in some])).otherwise(none))

            return _let(F.struct(*(parts[i].alias(f"p{i}") for i in some)), made)
        one = self._elements(value, kind, said)
        return None if one is None else _let(one, lambda o: _packed(*self._joined(o, kind)))

    def _elements(self, value: Column, kind: T.DataType, said: Column | None) -> Column | None:
        """An array's packed elements, or a map's entries with packed values; null if ``value`` is."""
        if isinstance(kind, T.ArrayType):
            leaf = not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType, T.StringType))
            if (leaf and not self.index_rules) or self.element(F.lit(None).cast(kind.elementType), kind.elementType, F.lit("0")) is None:
                return None
            at = lambda i: None if said is None else F.get(said, i)
            return F.transform(value, lambda x, i: self.element(x, kind.elementType, i.cast("string"), at(i)))
        if not isinstance(kind.keyType, T.StringType) or self.element(F.lit(None).cast(kind.valueType), kind.valueType, F.lit("k")) is None:
            return None
        at = lambda i: None if said is None else F.get(said, i)
        return F.transform(F.map_entries(value), lambda e, i: F.struct(e["key"].alias("key"), self.element(e["value"], kind.valueType, e["key"], at(i)).alias("value")))

    def _joined(self, one: Column, kind: T.DataType) -> tuple[Column, Column, Column]:
        """(value, was any masked, blocked keys) of what ``_elements`` made."""
        packed = (lambda e: e) if isinstance(kind, T.ArrayType) else (lambda e: e["value"])
        left = F.filter(one, lambda e: ~packed(e)["x"]) if self.removes else one
        if isinstance(kind, T.ArrayType):
            out = F.transform(left, lambda e: e["v"])
        else:
            out = F.map_from_entries(F.transform(left, lambda e: F.struct(e["key"].alias("key"), e["value"]["v"].alias("value"))))
        keys = F.coalesce(F.flatten(F.transform(one, lambda e: packed(e)["k"])), F.array().cast("array<string>")) if self.tracks else F.array().cast("array<string>")
        return out, F.exists(one, lambda e: packed(e)["r"]), keys

    def _tests(self, found: list[Branch], again: list[Branch]) -> list[tuple[Column, Branch]]:
        """What a container's own rules ask of its value: (when, branch), first match first.

        The two tries of a size rule are one test; a key rule can only be in the first.
        """
        at = lambda i: F.coalesce(found[i].when, F.lit(False)) if not isinstance(found[i].when, bool) else F.lit(found[i].when)
        earlier = lambda i: reduce(Column.__or__, (at(j) for j in range(i)), F.lit(False))
        tests = [(at(i) & ~earlier(i), b) for i, b in enumerate(found) if b.what != KEEP and b.when is not True]
        if any(b.what == KEEP for b in found) or not found:
            tests += [(b.when, b) for b in again if b.what != KEEP and isinstance(b.when, Column)]
        return tests

    def _fixed(self, branch: Branch, key: str | Column, path: str) -> Masked:
        if branch.what == KEEP:
            raise AssertionError("a kept leaf is decided before")
        self.counts.append((path, branch.rule, F.lit(True)))
        return Masked(branch.value, [F.lit(True)], [self._key(None, key)] if branch.what == BLOCK and self.tracks else [], gone=branch.what == REMOVED)

    def _gone(self, value: Column, kind: T.DataType, key: str) -> bool:
        """Is a field removed in every row?"""
        return self.removes and any(b.when is True and b.what == REMOVED for b in branches(value, key, kind, self.profile)[:1])

    def _key(self, when: Column | None, key: str | Column) -> Column:
        name = F.array(F.lit(key) if isinstance(key, str) else key)
        return name if when is None else F.when(when, name).otherwise(F.array().cast("array<string>"))

    def _container(self, value, kind, key: str, path: str, found: list[Branch]) -> Masked:
        null = F.lit(None).cast(kind)
        if found and found[0].when is True and found[0].what != KEEP:
            if found[0].what == OVERSIZE:
                self.counts.append((path, found[0].rule, value.isNotNull()))
                return Masked(null, [value.isNotNull()], notes=self._note(path, F.when(value.isNotNull(), found[0].note)))
            return self._fixed(found[0], key, path)
        # Whatever its own key says, the container is tried again without a key.
        again = branches(value, "", kind, self.profile)
        if again and again[0].when is True and again[0].what != KEEP:
            self.counts.append((path, again[0].rule, value.isNotNull()))
            return Masked(null, [value.isNotNull()], notes=self._note(path, F.when(value.isNotNull(), again[0].note if again[0].note is not None else again[0].value)))
        inner = self._inside(value, kind, path)
        out, redacted, keys, notes = inner.value, list(inner.redacted), list(inner.keys), list(inner.notes)
        tests = self._tests(found, again)
        taken = reduce(Column.__or__, (F.coalesce(w, F.lit(False)) for w, _ in tests), F.lit(False))
        if not isinstance(kind, T.StructType) and inner.redacted:
            self.counts.append((path, INSIDE, _any(inner.redacted) & ~taken))
        for when, b in tests:
            when = F.coalesce(when, F.lit(False))
            self.counts.append((path, b.rule, when))
            out = F.when(when, F.lit(None)).otherwise(out)  # of whatever type the inside has now
            keys = [F.when(when, F.array().cast("array<string>")).otherwise(k) for k in keys]
            if b.what == BLOCK and self.tracks:
                keys.insert(0, self._key(when, key))
            notes = [(p, F.when(~when, n)) for p, n in notes]
            if b.note is not None:
                notes = self._note(path, F.when(when, b.note)) + notes
            redacted.insert(0, when)
        return Masked(out, redacted, keys, notes, inner.same and not tests)

    def _note(self, path: str, message: Column) -> list[tuple[str, Column]]:
        return [(path, message)]

    def _inside(self, value: Column, kind: T.DataType, path: str) -> Masked:
        if not isinstance(kind, T.StructType):
            said = told(value, kind, self.profile)
            one = self._elements(value, kind, None if said is None else self._early(said))
            if one is None:
                return Masked(value, same=True)
            out, redacted, keys = self._joined(self._stage(one), kind)
            return Masked(out, [redacted], [keys] if self.tracks else [])
        parts = [self.mask(value[f.name], f.dataType, f.name, f"{path}.{f.name}") for f in kind.fields]
        if all(p.same for p in parts):
            return Masked(value, same=True)
        there = value.isNotNull()
        return Masked(
            F.when(there, _struct([p.value.alias(f.name) for p, f in zip(parts, kind.fields) if not p.gone])),
            [there & _any(p.redacted) for p in parts if p.redacted],
            [F.when(there, k).otherwise(F.array().cast("array<string>")) for p in parts for k in p.keys],
            [(n, F.when(there, m)) for p in parts for n, m in p.notes],
        )


def mask_frame(df: DataFrame, profile: Profile, keep: tuple[str, ...] = (), observation: Observation | str | None = None) -> DataFrame:
    """``df`` with its columns masked; columns in ``keep`` are left alone (a row's own identity).

    observation: is filled, while the masked table is written, with the rows, and those
    masked by each rule at each path (see ``reports``); in streams a name for listeners.

    A profile that blocks the empty key, as ``*`` does, masks the row as a whole: its
    columns are null and the note has the replacement.
    """
    if not profile.enabled:
        return df
    if twice := sorted({c for c in df.columns if df.columns.count(c) > 1}):
        raise ValueError(f"columns of one name can't be told apart: {', '.join(twice)}")
    masker = Masker(profile)
    fields = [f for f in df.schema.fields if f.name not in keep]
    if BLOCKED in profile.strategies and is_blocked("", profile) and not (SAFE in profile.strategies and "" in profile.safe_keys):
        made = {f.name: F.lit(None).cast(f.dataType) for f in fields}
        marks = {REDACTED: F.lit(True)} if profile.mark_redacted else {}
        marks |= {KEYS: F.array(F.lit(""))} if masker.tracks else {}
        return _with_marks(df, made, marks | {NOTES: F.create_map(F.lit(""), F.lit(profile.replacement))})
    parts = {f.name: masker.mask(F.col(quoted(f.name)), f.dataType, f.name, f.name) for f in fields}
    marks = {}
    if profile.mark_redacted:
        marks[REDACTED] = _any([r for p in parts.values() for r in p.redacted])
        if masker.tracks:
            marks[KEYS] = _names([k for p in parts.values() for k in p.keys])
    notes = [n for p in parts.values() for n in p.notes]
    if notes:
        entries = F.array(*(F.struct(F.lit(path).alias("key"), message.alias("value")) for path, message in notes))
        marks[NOTES] = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    staged = df.select("*", *masker.early) if masker.early else df
    staged = staged.select("*", *masker.staged) if masker.staged else staged
    if observation is not None:
        staged = observed(staged, observation, masker.counts)
    columns = [c for c in df.columns if c not in parts or not parts[c].gone]
    return _with_marks(staged, {c: p.value for c, p in parts.items()}, marks, columns)


def _with_marks(df: DataFrame, made: dict[str, Column], marks: dict[str, Column], columns: list[str] | None = None) -> DataFrame:
    """The columns, as ``made`` has them, without those whose names the marks take; then the marks."""
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    same = (lambda c: c) if sensitive else str.lower
    taken = {same(c) for c in marks}
    out = [made[c].alias(c) if c in made else F.col(quoted(c)) for c in (columns or df.columns) if same(c) not in taken]
    return df.select(*out, *(m.alias(name) for name, m in marks.items()))
