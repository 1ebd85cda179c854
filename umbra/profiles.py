"""Masking profiles: which rules apply, in which order, with which settings.

A profile is a frozen value on the driver; plans are built from it.  ``PROFILES`` holds
the four built-in ones as plain configuration, so that they can be read, changed and
registered like a user's own.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from umbra.functions.dialect import Pattern, parse

REDACTED = "[REDACTED]"
#: A handler that returns this drops the key (and in a document's root is the result).
REMOVE = "__UMBRA_REMOVE__"

SAFE, BLOCKED, LARGE_OBJECT, LARGE_STRING, REGEX, ENTROPY = "safe_keys", "blocked_keys", "large_object", "large_string", "regex_patterns", "shannon_entropy"
ALL_RULES = (SAFE, BLOCKED, LARGE_OBJECT, LARGE_STRING, REGEX, ENTROPY)

# Keys, patterns and exclusions of the built-in profiles.
_SAFE = [
    "id", "uuid", "user_id", "order_id", "session_id", "request_id", "created_at", "updated_at", "timestamp", "level", "event", "message",
    "trace_id", "channel", "duration_ms", "memory_mb", "controlled_block", "controlled_block_id", "attempt", "status", "breaker_tripped",
    "uncaught", "title", "type", "method", "path", "url", "ip", "user_agent", "operation", "action", "source", "target", "version",
    "platform", "environment",
]
_SAFE_STRICT = [
    "id", "uuid", "created_at", "updated_at", "timestamp", "level", "event", "message",
]
_BLOCKED = [
    "password", "*token*", "*key*", "*secret*", "authorization", "auth_token", "bearer_token", "access_token", "refresh_token",
    "session_id", "private_key", "client_secret", "full_name", "first_name", "last_name", "email", "ssn", "ein", "social_security_number",
    "tax_id", "credit_card", "card_number", "cvv", "pin",
]
_BLOCKED_STRICT = [*_BLOCKED, "secret", "phone", "address", "user_agent", "ip", "name", "username"]
_BLOCKED_FAST = [
    "password", "secret", "*token*", "*key*", "authorization", "private_key", "client_secret",
]
_PATTERNS = {
    "email": r"/[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+/",
    "phone_simple": r"/\b\d{3}[.-]?\d{3}[.-]?\d{4}\b/",
    "ssn": r"/\b\d{3}-?\d{2}-?\d{4}\b/",
    "credit_card": r"/\b(?:\d[ -]*?){13,16}\b/",
    "url_with_auth": r"/https?:\/\/[^:\/\s]+:[^@\/\s]+@[^\s]+/",
    "phone": r"/\+?[\d\s\-\(\)]{7,15}/",
    "ipv4": r"/\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b/",
    "uuid": r"/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}/i",
    "jwt": r"/^[A-Za-z0-9-_]+\.[A-Za-z0-9-_]+\.[A-Za-z0-9-_]*$/",
    "api_key_stripe": r"/sk_(?:test_|live_)[a-zA-Z0-9]{24,}/",
    "api_key_generic": r"/(?:api[_-]?key|access[_-]?token|secret[_-]?key)[\s=:]+[a-zA-Z0-9_-]{16,}/",
    "jwt_token": r"/eyJ[a-zA-Z0-9_-]*\.eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]+/",
    "base64_key": r"/(?:key|token|secret)[\s=:]+[A-Za-z0-9+\/]{32,}={0,2}/",
    "aws_access_key": r"/AKIA[0-9A-Z]{16}/",
    "aws_secret_key": r"/[0-9a-zA-Z\/+]{40}/",
    "github_token": r"/gh[pousr]_[A-Za-z0-9_]{36}/",
    "password_assignment": r"/password[\s=:]+[^\s\n\r]+/",
    "simple_token": r"/^[A-Za-z0-9]{32,}$/",
}
#: Long strings that match this exclusion, spelled exactly so, are not excluded by it.
HEX_EXCLUSION, HEX_LENGTH = "/^[0-9a-f]+$/i", 32
_EXCLUSIONS = {
    "url": r"/^https?:\/\//",
    "path": r"/^[\/\\].+[\/\\]/",
    "date": r"/^\d{4}-\d{2}-\d{2}/",
    "uuid": r"/^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$/i",
    "hex": HEX_EXCLUSION,
    "blank": r"/^\s*$/",
    "agent": r"/^Mozilla\/\d\.\d|^[A-Za-z]+\/\d+\.\d+|AppleWebKit|Chrome|Safari|Firefox|Opera|Edge/",
    "ip": r"/^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$/",
    "mac": r"/^[0-9a-f]{2}:[0-9a-f]{2}:[0-9a-f]{2}:[0-9a-f]{2}:[0-9a-f]{2}:[0-9a-f]{2}$/i",
    "sql": r"/^(SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|TRUNCATE|SHOW|DESCRIBE|EXPLAIN)\s+/i",
    "word": r"/^[a-zA-Z]{1,15}$/",
    "words": r"/^[A-Za-z]+\s+[A-Za-z]+(\s+[A-Za-z]+)*$/",
    "number": r"/^\d+$/",
    "capitals": r"/^[A-Z]{2,}$/",
    "small": r"/^[a-z]{2,}$/",
}


def _pick(table: dict[str, str], names: list[str]) -> dict[str, str]:
    return {n: table[n] for n in names}


PROFILES: dict[str, dict[str, Any]] = {
    "default": {
        "strategies": list(ALL_RULES),
        "safe_keys": _SAFE,
        "blocked_keys": _BLOCKED,
        "patterns": _pick(_PATTERNS, ["email", "phone_simple", "ssn", "credit_card", "url_with_auth"]),
        "mark_redacted": True,
        "track_redacted_keys": False,
        "non_redactable_object_behavior": "preserve",
        "max_value_length": 5000,
        "redact_large_objects": True,
        "max_object_size": 100,
        "shannon_entropy": {"enabled": True, "threshold": 4.8, "min_length": 25, "exclusion_patterns": [*_pick(_EXCLUSIONS, ["url", "path", "date", "uuid", "hex", "blank", "agent", "ip", "mac", "sql"]).values()]},
    },
    "strict": {
        "strategies": list(ALL_RULES),
        "safe_keys": _SAFE_STRICT,
        "blocked_keys": _BLOCKED_STRICT,
        "patterns": _pick(_PATTERNS, ["email", "phone", "ssn", "credit_card", "url_with_auth", "ipv4", "uuid", "jwt"]),
        "mark_redacted": True,
        "track_redacted_keys": True,
        "non_redactable_object_behavior": "redact",
        "max_value_length": 1000,
        "redact_large_objects": True,
        "max_object_size": 25,
        "shannon_entropy": {"enabled": True, "threshold": 4.0, "min_length": 15, "exclusion_patterns": [*_pick(_EXCLUSIONS, ["url", "date"]).values()]},
    },
    "file_scan": {
        "strategies": [REGEX, ENTROPY],
        "safe_keys": [],
        "blocked_keys": [],
        "patterns": _pick(_PATTERNS, ["email", "phone_simple", "ssn", "credit_card", "url_with_auth", "api_key_stripe", "api_key_generic", "jwt_token", "base64_key", "aws_access_key", "aws_secret_key", "github_token", "password_assignment"]),
        "mark_redacted": True,
        "track_redacted_keys": False,
        "non_redactable_object_behavior": "preserve",
        "max_value_length": None,
        "redact_large_objects": False,
        "max_object_size": 100,
        "shannon_entropy": {
            "enabled": True,
            "threshold": 4.8,
            "min_length": 25,
            "exclusion_patterns": [*_pick(_EXCLUSIONS, ["url", "path", "date", "uuid", "blank", "agent", "ip", "mac", "sql", "word", "words", "number", "capitals", "small"]).values()],
        },
    },
    "performance": {
        "strategies": [SAFE, BLOCKED, REGEX],
        "safe_keys": _SAFE,
        "blocked_keys": _BLOCKED_FAST,
        "patterns": _pick(_PATTERNS, ["email", "simple_token"]),
        "mark_redacted": False,
        "track_redacted_keys": False,
        "non_redactable_object_behavior": "preserve",
        "max_value_length": None,
        "redact_large_objects": False,
        "max_object_size": None,
        "shannon_entropy": {"enabled": False},
    },
}

SCAN = {"profile": "file_scan", "exclude_patterns": ["*.lock", "*.min.js", "vendor/*", "node_modules/*"], "max_file_size": 10_485_760}
#: Environment variables ``UMBRA_<name>`` that change the default profile, the scan or the choice of profile.
_ENV = {
    "ENABLED": ("enabled",),
    "REPLACEMENT": ("replacement",),
    "MARK_REDACTED": ("mark_redacted",),
    "TRACK_KEYS": ("track_redacted_keys",),
    "OBJECT_BEHAVIOR": ("non_redactable_object_behavior",),
    "MAX_VALUE_LENGTH": ("max_value_length",),
    "LARGE_OBJECTS": ("redact_large_objects",),
    "MAX_OBJECT_SIZE": ("max_object_size",),
    "SHANNON_ENABLED": ("shannon_entropy", "enabled"),
    "SHANNON_THRESHOLD": ("shannon_entropy", "threshold"),
    "SHANNON_MIN_LENGTH": ("shannon_entropy", "min_length"),
}


def lower_ascii(key: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)


@dataclass(frozen=True)
class Entropy:
    enabled: bool = False
    threshold: float = 4.8
    min_length: int = 25
    #: (as given, parsed); what isn't valid never excludes.
    exclusions: tuple[tuple[str, Pattern], ...] = ()


@dataclass(frozen=True)
class Profile:
    name: str = "default"
    enabled: bool = True
    strategies: tuple[str, ...] = ()
    safe_keys: tuple[str, ...] = ()
    blocked_keys: tuple[str, ...] = ()
    patterns: tuple[tuple[str, Pattern], ...] = ()
    replacement: str = REDACTED
    mark_redacted: bool = True
    track_redacted_keys: bool = False
    non_redactable_object_behavior: str = "preserve"
    max_value_length: int | None = None
    redact_large_objects: bool = True
    max_object_size: int = 100
    entropy: Entropy = field(default_factory=Entropy)


def _value(text: str) -> Any:
    """What an environment variable means: true, false, null, empty or the text."""
    words = {"true": True, "(true)": True, "false": False, "(false)": False, "null": None, "(null)": None, "empty": "", "(empty)": ""}
    return words.get(text.lower(), text)


def with_environment(config: Mapping[str, Any], env: Mapping[str, str] | None = None) -> dict[str, Any]:
    env = os.environ if env is None else env
    out = dict(config)
    for name, path in _ENV.items():
        if f"UMBRA_{name}" in env:
            value = _value(env[f"UMBRA_{name}"])
            if len(path) == 1:
                out[path[0]] = value
            else:
                out[path[0]] = {**out.get(path[0], {}), path[1]: value}
    return out


def scan_settings(env: Mapping[str, str] | None = None) -> dict[str, Any]:
    env = os.environ if env is None else env
    size = env.get("UMBRA_SCAN_MAX_FILE_SIZE", "")
    return SCAN | ({"profile": env["UMBRA_SCAN_PROFILE"]} if "UMBRA_SCAN_PROFILE" in env else {}) | ({"max_file_size": int(size)} if size.isdigit() else {})


def available_profiles(profiles: Mapping[str, Any] | None = None) -> list[str]:
    return list(PROFILES if profiles is None else profiles)


def profile_exists(name: str, profiles: Mapping[str, Any] | None = None) -> bool:
    return name in (PROFILES if profiles is None else profiles)


def load(name: str | None = None, profiles: Mapping[str, Any] | None = None, env: Mapping[str, str] | None = None) -> Profile:
    """The profile of that name, or the default one; values of the wrong type fall back to defaults."""
    env = os.environ if env is None else env
    name = env.get("UMBRA_DEFAULT_PROFILE", "default") if name is None else name
    known = PROFILES if profiles is None else profiles
    if name not in known:
        raise ValueError(f"Redaction profile '{name}' not found in configuration.")
    config = known[name]
    if not isinstance(config, Mapping):
        raise ValueError(f"Invalid configuration for profile '{name}'.")
    return from_config(with_environment(config, env) if name == "default" and profiles is None else config, name)


def from_config(config: Mapping[str, Any], name: str = "custom") -> Profile:
    def typed(key: str, kind: type, default: Any) -> Any:
        value = config.get(key, default)
        return value if isinstance(value, kind) and not (kind is int and isinstance(value, bool)) else default

    def strings(key: str) -> tuple[str, ...]:
        value = config.get(key)
        value = value.values() if isinstance(value, Mapping) else value
        return tuple(lower_ascii(v) for v in value if isinstance(v, str)) if isinstance(value, (list, tuple, set, type({}.values()))) else ()

    given = config.get("patterns")
    given = given.items() if isinstance(given, Mapping) else enumerate(given) if isinstance(given, (list, tuple)) else ()
    rules = config.get("strategies")
    return Profile(
        name=name,
        enabled=typed("enabled", bool, True),
        strategies=tuple(s for s in rules if isinstance(s, str)) if isinstance(rules, (list, tuple)) else (),
        safe_keys=strings("safe_keys"),
        blocked_keys=strings("blocked_keys"),
        patterns=tuple((str(k), p) for k, v in given if (p := parse(v)) is not None),
        replacement=typed("replacement", str, REDACTED),
        mark_redacted=typed("mark_redacted", bool, True),
        track_redacted_keys=typed("track_redacted_keys", bool, False),
        non_redactable_object_behavior=typed("non_redactable_object_behavior", str, "preserve"),
        max_value_length=_positive(config.get("max_value_length")),
        redact_large_objects=typed("redact_large_objects", bool, True),
        max_object_size=typed("max_object_size", int, 100),
        entropy=_entropy(config.get("shannon_entropy")),
    )


def _positive(value: Any) -> int | None:
    """A number above 0, also as text, as an integer; anything else is no limit."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return None
    try:
        number = float(value)
    except ValueError:
        return None
    return int(number) if number > 0 and number != float("inf") else None


def _number(value: Any, default: float) -> float:
    try:
        return default if value is None or isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return default


def _entropy(config: Any) -> Entropy:
    if not isinstance(config, Mapping):
        return Entropy()
    patterns = config.get("exclusion_patterns")
    patterns = [p for p in patterns if isinstance(p, str)] if isinstance(patterns, (list, tuple)) else []
    return Entropy(
        enabled=bool(config.get("enabled", False)),
        threshold=_number(config.get("threshold"), 4.8),
        min_length=int(_number(config.get("min_length"), 25)),
        exclusions=tuple((p, parsed) for p in patterns if (parsed := parse(p)) is not None),
    )
