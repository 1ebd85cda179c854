"""Key rules: exact safe keys, exact or wildcard blocked keys; case is ASCII case."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.profiles import Profile, lower_ascii


def wildcard_regex(pattern: str) -> str:
    """An anchored regex in which ``*`` is any run of characters but line feeds; the rest is literal."""
    literal = lambda s: re.sub(r"([^0-9A-Za-z_])", r"\\\1", s)
    return "^" + ".*".join(literal(p) for p in pattern.split("*")) + "$"


def is_safe(key: str, profile: Profile) -> bool:
    return lower_ascii(key) in profile.safe_keys


def is_blocked(key: str, profile: Profile) -> bool:
    key = lower_ascii(key)
    return any(
        re.search(wildcard_regex(p).encode(), key.encode("utf-8", "surrogatepass"), re.IGNORECASE) is not None if "*" in p else key == p for p in profile.blocked_keys
    )


def _lower(key: Column) -> Column:
    return F.translate(key, string.ascii_uppercase, string.ascii_lowercase)


def safe_column(key: Column, profile: Profile) -> Column:
    return _lower(key).isin(*profile.safe_keys) if profile.safe_keys else F.lit(False)


def blocked_column(key: Column, profile: Profile) -> Column:
    """For keys known only at run time, as in maps."""
    found = F.lit(False)
    if exact := [p for p in profile.blocked_keys if "*" not in p]:
        found = _lower(key).isin(*exact)
    if wild := [wildcard_regex(p) for p in profile.blocked_keys if "*" in p]:
        found = found | _lower(key).rlike("(?di)" + "|".join(wild))
    return found


def blocked_sql(key: str, profile: Profile) -> str:
    """The same as an SQL expression."""
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    low = f"translate({key}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    exact = [quoted(p) for p in profile.blocked_keys if "*" not in p]
    wild = [wildcard_regex(p) for p in profile.blocked_keys if "*" in p]
    tests = ([f"{low} IN ({', '.join(exact)})"] if exact else []) + ([f"{low} RLIKE {quoted('(?di)' + '|'.join(wild))}"] if wild else [])
    return " OR ".join(tests) or f"CASE WHEN {key} IS NOT NULL THEN false END"
