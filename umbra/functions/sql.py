"""SQL functions over the same rules, as SQL wherever the engine can say it."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from umbra.functions.dialect import Pattern, search
from umbra.functions.entropy import byte_entropy_udf
from umbra.functions.many import any_found_udf, many
from umbra.operators.document import DocumentMasker, mask_raw_document
from umbra.operators.keys import blocked_sql, is_blocked, is_safe
from umbra.plans.registry import resolve
from umbra.profiles import BLOCKED, ENTROPY, HEX_EXCLUSION, HEX_LENGTH, LARGE_STRING, REGEX, SAFE, Profile, load


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(spark: SparkSession, value: str, pattern: Pattern) -> str:
    if pattern.deep:  # Java would overflow: a function in Python

        @F.pandas_udf("boolean")
        def found(values):
            return values.map(lambda v: None if v is None else pattern.found_in(v))

        name = f"umbra_search_{abs(hash(pattern))}"
        spark.udf.register(name, found)
        return f"{name}(CAST({value} AS BINARY))"
    seen = f"decode(CAST({value} AS BINARY), 'ISO-8859-1')" if pattern.bytewise else value
    hit = f"{seen} RLIKE {literal(pattern.java(pattern.bytewise))}"
    return f"(contains({value}, {literal(pattern.needs)}) AND {hit})" if pattern.needs else f"({hit})"


def _any_found(spark: SparkSession, value: str, patterns: tuple[Pattern, ...]) -> str:
    if not many(patterns):
        return " OR ".join(_found(spark, value, p) for p in patterns)
    name = f"umbra_search_{abs(hash(patterns))}"
    spark.udf.register(name, any_found_udf(patterns))
    return f"{name}(CAST({value} AS BINARY))"


def _common(spark: SparkSession, value: str, p: Profile) -> str:
    one = lambda text, pattern: f"({_found(spark, value, pattern)}" + (f" AND octet_length({value}) < {HEX_LENGTH})" if text == HEX_EXCLUSION else ")")
    return " OR ".join(one(*e) for e in p.entropy.exclusions) or "false"


def _masked(spark: SparkSession, p: Profile) -> str:
    """The chain over a text without a key, as one CASE."""
    new, cases, e = literal(p.replacement), [], p.entropy
    for rule in resolve(p) if p.enabled else []:
        if rule == SAFE and is_safe("", p):
            cases.append("WHEN true THEN value")
        elif rule == BLOCKED and is_blocked("", p):
            cases.append(f"WHEN true THEN {new}")
        elif rule == LARGE_STRING and p.max_value_length is not None:
            cases.append(f"WHEN octet_length(value) > {p.max_value_length} THEN concat({new}, ' (String with ', octet_length(value), ' characters)')")
        elif rule == REGEX and p.patterns:
            cases.append(f"WHEN {_any_found(spark, 'value', tuple(x for _, x in p.patterns))} THEN {new}")
        elif rule == ENTROPY and e.enabled:
            worth = f"octet_length(value) >= {e.min_length} AND NOT ({_common(spark, 'value', p)})"
            cases.append(f"WHEN umbra_byte_entropy(CAST(CASE WHEN {worth} THEN value END AS BINARY)) >= {e.threshold} THEN {new}")
    return f"CASE {' '.join(cases)} ELSE value END" if cases else "value"


def register(spark: SparkSession, profile: Profile | None = None) -> None:
    """``byte_entropy(text)``, ``is_common_pattern(text)``, ``key_blocked(key)``, ``mask_text(text)``
    and ``mask_json(document)``, the last four by ``profile`` (or the default one).

    Documents and entropy are worked on in Python, in Arrow batches; the others are SQL
    functions, so that the optimizer sees through them.  Custom strategies take part in
    ``mask_json`` only.  A profile without an entropy rule has no common patterns.
    """
    p = load() if profile is None else profile

    @F.pandas_udf("binary")
    def mask_json(values):
        masker = DocumentMasker(p)
        return values.map(lambda v: None if v is None else mask_raw_document(v, masker))

    spark.udf.register("umbra_byte_entropy", byte_entropy_udf())
    spark.udf.register("umbra_mask_json", mask_json)
    for name, argument, kind, body in (
        ("byte_entropy", "value", "DOUBLE", "umbra_byte_entropy(CAST(value AS BINARY))"),
        ("mask_json", "value", "STRING", "CAST(umbra_mask_json(CAST(value AS BINARY)) AS STRING)"),
        ("is_common_pattern", "value", "BOOLEAN", _common(spark, "value", p)),
        ("key_blocked", "key", "BOOLEAN", blocked_sql("key", p)),
        ("mask_text", "value", "STRING", _masked(spark, p)),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument} STRING) RETURNS {kind} RETURN {body}")


def pattern_hits(value: Column, profile: Profile) -> Column:
    """The names of the profile's patterns that a text has, in the profile's order."""
    hits = F.array(*(F.when(search(value, p), F.lit(name)) for name, p in profile.patterns)) if profile.patterns else F.array().cast("array<string>")
    return F.filter(hits, lambda x: x.isNotNull())
