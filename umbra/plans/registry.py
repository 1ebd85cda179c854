"""Custom strategies: by name, as Spark columns or as Python code for documents."""

from __future__ import annotations

import importlib
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql.types import DataType

from umbra.profiles import ALL_RULES, Profile


class ColumnStrategy:
    """A rule in typed mode.  ``predicate`` says for which values (a column, or a plain
    truth that is known at plan time), ``replace`` what becomes of them.

    With ``removes`` they go instead: map entries, list items, and columns and struct
    fields that the predicate names at plan time.  A field that it names row by row is
    null in those rows, as a schema has no other way to say it.  The row is marked.
    """

    removes = False

    def predicate(self, value: Column, key: str | Column, kind: DataType, profile: Profile) -> Column | bool:
        raise NotImplementedError

    def replace(self, value: Column, key: str | Column, kind: DataType, profile: Profile) -> Column:
        raise NotImplementedError


class PyStrategy:
    """A rule in document mode, over JSON values.  ``handle`` may return ``REMOVE``, and
    may note itself in ``context``: ``redacted`` and ``keys``."""

    def should_handle(self, value: Any, key: str, profile: Profile) -> bool:
        raise NotImplementedError

    def handle(self, value: Any, key: str, profile: Profile, context: Any) -> Any:
        raise NotImplementedError


_strategies: dict[str, ColumnStrategy | PyStrategy] = {}


def register(name: str, strategy: ColumnStrategy | PyStrategy) -> None:
    """``name`` can then stand in a profile's strategies; it goes before a built-in of that name."""
    _strategies[name] = strategy


def unregister(name: str) -> None:
    _strategies.pop(name, None)


def load_custom(classes: Mapping[Any, Any]) -> None:
    """Register ``{name: "module.Class"}``; entries that aren't strategies are passed over."""
    for name, path in classes.items():
        if not isinstance(name, str) or not isinstance(path, str) or "." not in path:
            continue
        module, _, cls = path.rpartition(".")
        try:
            found = getattr(importlib.import_module(module), cls)
        except (ImportError, AttributeError, ValueError):
            continue
        if isinstance(found, type) and issubclass(found, (ColumnStrategy, PyStrategy)):
            register(name, found())


def resolve(profile: Profile) -> list[str | ColumnStrategy | PyStrategy]:
    """The profile's rules in order; names that are neither known nor registered are dropped."""
    return [rule for _, rule in named(profile)]


def named(profile: Profile) -> list[tuple[str, str | ColumnStrategy | PyStrategy]]:
    """The same with the names that the profile gives them."""
    return [(name, _strategies.get(name, name)) for name in profile.strategies if name in _strategies or name in ALL_RULES]
