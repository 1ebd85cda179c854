"""The registered queries over the library's own operators, and their DuckDB statements.

The statements are written from the rules themselves: they share the profiles' fixed
values with the library, not its code.
"""

from __future__ import annotations

import re
import sys
import uuid
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from umbra.functions.dialect import search
from umbra.functions.entropy import byte_entropy, is_common_pattern
from umbra.functions.sql import pattern_hits
from umbra.functions.sql import register as register_sql
from umbra.operators.document import mask_json
from umbra.operators.records import mask_documents
from umbra.operators.reports import report as report_of
from umbra.operators.rules import mask_text, with_masked
from umbra.operators.parts import scan_files
from umbra.operators.scanning import report, scan_contents, scan_documents, status_table, summary
from umbra.operators.typed import mask_frame
from umbra.plans.registry import ColumnStrategy, PyStrategy, load_custom, named, register
from umbra.profiles import ALL_RULES, BLOCKED, ENTROPY, LARGE_OBJECT, LARGE_STRING, PROFILES, REGEX, REMOVE, SAFE, Profile, available_profiles, from_config, load, profile_exists
from umbra.sources.allfiles import digest_files, shared_folder
from umbra.streaming.logs import batch_lines, log_lines, tap

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def variant(base: str, **changes) -> Profile:
    return from_config({**PROFILES[base], **changes}, base)


def keyed(safe: list[str] = (), blocked: list[str] = (), **more) -> Profile:
    return from_config({"strategies": [SAFE, BLOCKED], "safe_keys": list(safe), "blocked_keys": list(blocked), "track_redacted_keys": True} | more, "keys")


# --- SQL pieces ------------------------------------------------------------------------------


def re2(delimited: str) -> str:
    """A pattern of the fixed values in RE2's spelling, as an SQL literal."""
    body, _, flags = delimited[1:].rpartition("/")
    body = re.sub(r"(?<!\\)\$", lambda m: r"(?:\n?\z)", body).replace(r"\/", "/")
    return "'" + (f"(?{flags})" if flags else "") + body.replace("'", "''") + "'"


def hits(value: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({value}, {re2(p)})" for p in patterns) + ")"


def common(value: str, exclusions) -> str:
    one = lambda p: f"(regexp_matches({value}, {re2(p)})" + (f" AND strlen({value}) < 32)" if p == "/^[0-9a-f]+$/i" else ")")
    return "(" + " OR ".join(map(one, exclusions)) + ")"


def entropies(source: str, key: str, value: str) -> str:
    """(key, h) for every row of ``source`` with a text that isn't empty."""
    return f"""(SELECT k, -sum(p * log2(p)) AS h FROM (
      SELECT k, count(*)::DOUBLE / any_value(n) AS p FROM (
        SELECT k, n, unnest(regexp_extract_all(hex(encode(v)), '..')) AS b FROM (SELECT {key} AS k, {value} AS v, strlen({value}) AS n FROM {source}))
      GROUP BY k, b) GROUP BY k)"""


def chain_sql(source: str, key: str, value: str, profile: str, columns: str) -> str:
    """A text under the empty key, through all the profile's rules over values."""
    c = PROFILES[profile]
    e = c["shannon_entropy"]
    limit = c["max_value_length"]
    large = f"WHEN strlen(v) > {limit} THEN 2 " if limit and LARGE_STRING in c["strategies"] else ""
    entropy = f"WHEN strlen(v) >= {e['min_length']} AND NOT {common('v', e['exclusion_patterns'])} AND coalesce(h, 0) >= {e['threshold']} THEN 1 " if e["enabled"] else ""
    return f"""
WITH s AS (SELECT *, {key} AS k, {value} AS v FROM {source}),
d AS (SELECT s.*, CASE {large}WHEN {hits("v", c["patterns"].values())} THEN 1 {entropy}ELSE 0 END AS rule
      FROM s LEFT JOIN {entropies(source, key, value)} e ON s.k = e.k)
SELECT {columns}, CASE rule WHEN 1 THEN '[REDACTED]' WHEN 2 THEN '[REDACTED] (String with ' || strlen(v) || ' characters)' ELSE v END AS masked,
       rule > 0 AS redacted
FROM d"""


# --- patterns, lengths, entropy --------------------------------------------------------------


def _flags(profile: str, source: str, key: str, value: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = load(profile, PROFILES)
        return table(spark, sf_dir, source).select(key, *(search(F.col(value), pattern).alias(name) for name, pattern in p.patterns))

    flags = ", ".join(f"regexp_matches({value}, {re2(p)}) AS {n}" for n, p in PROFILES[profile]["patterns"].items())
    query(f"SELECT {key}, {flags} FROM {source}", f"regex_flags_{profile}" + ("_pages" if source == "pages" else ""))(run)


for _p in PROFILES:
    _flags(_p, "documents", "doc_id", "text")
_flags("file_scan", "pages", "page_id", "html")


@query(
    f"""SELECT doc_id, CASE WHEN {hits("text", PROFILES["file_scan"]["patterns"].values())} THEN '[REDACTED]' ELSE text END AS text_masked,
    {hits("text", PROFILES["file_scan"]["patterns"].values())} AS _redacted FROM documents"""
)
def regex_mask_file_scan(spark, sf_dir):
    p = variant("file_scan", strategies=[REGEX])
    return with_masked(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), p, "text_masked", "_redacted").drop("text")


@query(
    "SELECT doc_id, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(text, {re2(p)}) THEN '{n}' END" for n, p in PROFILES["strict"]["patterns"].items())
    + "], lambda x: x IS NOT NULL) AS hits FROM documents",
    "pattern_hits",
)
def _pattern_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pattern_hits(F.col("text"), load("strict", PROFILES)).alias("hits"))


@query(
    """SELECT doc_id, CASE WHEN strlen(text) > 5000 THEN '[REDACTED] (String with ' || strlen(text) || ' characters)' ELSE text END AS text,
    strlen(text) > 5000 AS _redacted FROM documents"""
)
def large_string_mask(spark, sf_dir):
    p = variant("default", strategies=[LARGE_STRING])
    return mask_frame(table(spark, sf_dir, "documents").select("doc_id", "text"), p, keep=("doc_id",))


@query(f"SELECT doc_id, coalesce(round(h, 6), 0) AS entropy FROM documents LEFT JOIN {entropies('documents', 'doc_id', 'text')} e ON doc_id = k", "byte_entropy")
def _byte_entropy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(byte_entropy(F.col("text")), 6).alias("entropy"))


_default_ex = PROFILES["default"]["shannon_entropy"]["exclusion_patterns"]
_scan_ex = PROFILES["file_scan"]["shannon_entropy"]["exclusion_patterns"]


@query(
    f"""SELECT 'page' AS kind, page_id AS id, {common("url", _default_ex)} AS common FROM pages
    UNION ALL SELECT 'document', doc_id, {common("text", _scan_ex)} FROM documents"""
)
def common_pattern_flags(spark, sf_dir):
    def flags(name, kind, key, value, profile):
        return table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), is_common_pattern(F.col(value), load(profile, PROFILES).entropy).alias("common"))

    return flags("pages", "page", "page_id", "url", "default").union(flags("documents", "document", "doc_id", "text", "file_scan"))


_strict_e = PROFILES["strict"]["shannon_entropy"]


@query(
    f"""SELECT doc_id, CASE WHEN hit THEN '[REDACTED]' ELSE text END AS text, hit AS _redacted FROM (
      SELECT doc_id, text, strlen(text) >= 15 AND NOT {common("text", _strict_e["exclusion_patterns"])} AND coalesce(h, 0) >= 4.0 AS hit
      FROM documents LEFT JOIN {entropies("documents", "doc_id", "text")} e ON doc_id = k)"""
)
def entropy_mask_strict(spark, sf_dir):
    p = variant("strict", strategies=[ENTROPY], track_redacted_keys=False)
    return mask_frame(table(spark, sf_dir, "documents").select("doc_id", "text"), p, keep=("doc_id",))


def _chain(profile: str, source: str, key: str, value: str, columns: tuple[str, ...]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = load(profile, PROFILES)
        return with_masked(table(spark, sf_dir, source).select(*columns, value), F.col(value), p, "masked", "redacted").drop(value)

    query(chain_sql(source, key, value, profile, ", ".join(columns)), f"full_chain_{profile}_{source}")(run)


for _p in PROFILES:
    _chain(_p, "documents", "doc_id", "text", ("doc_id",))
_chain("default", "conversations", "conv_id || '/' || turn", "text", ("conv_id", "turn"))
_chain("file_scan", "pages", "page_id", "html", ("page_id",))


# A user's own patterns: groups with names, quotes, late flags, single bytes.
_USER = {"year": r"/\b(?<c>19|20)(?P<d>\d\d)\b/", "quoted": r"{\Q(c)\E|\Qa.b\E}", "late": r"/secret(?i)key[=:]/", "again": r"/\b(\w)\g{1}\1/", "bytes": r"/^.{1000,}$/s", "bad": "/(/"}


@query(
    """SELECT doc_id, CASE WHEN hit THEN '***' ELSE text END AS text, hit AS _redacted FROM (
      SELECT doc_id, text, regexp_matches(text, '\\b(19|20)\\d\\d\\b') OR contains(text, '(c)') OR contains(text, 'a.b') OR regexp_matches(text, 'secret(?i:key)[=:]')
        OR regexp_matches(text, '\\b(""" + "|".join(c * 3 for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz") + """)') OR strlen(text) >= 1000 AS hit FROM documents)"""
)
def user_patterns_mask(spark, sf_dir):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # one of them is not valid
        p = from_config({"strategies": [REGEX], "patterns": _USER, "replacement": "***"})
    return mask_frame(table(spark, sf_dir, "documents").select("doc_id", "text"), p, keep=("doc_id",))


# 500 patterns by rule, against one that says the same: numbers in addresses and in calls.
_MANY = {f"page{n}": f"@/{n}\\?page=\\d@" for n in range(250)} | {f"call{n}": f"/\\btrack\\({n}\\)/i" for n in range(250)}
_NUMBER = "([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9])"


@query(
    f"""SELECT page_id, CASE WHEN u THEN '[REDACTED]' ELSE url END AS url, CASE WHEN h THEN '[REDACTED]' ELSE html END AS html, u OR h AS _redacted FROM (
      SELECT *, {" , ".join(f"regexp_matches({c}, '/{_NUMBER}[?]page=[0-9]') OR regexp_matches({c}, '(?i)\\btrack[(]{_NUMBER}[)]') AS {a}" for c, a in (("url", "u"), ("html", "h")))} FROM pages)"""
)
def many_patterns_mask(spark, sf_dir):
    """Five hundred patterns of a user, in one pass over each text."""
    p = from_config({"strategies": [REGEX], "patterns": _MANY})
    return mask_frame(table(spark, sf_dir, "pages").select("page_id", "url", "html"), p, keep=("page_id",))


@query(
    f"""SELECT doc_id, CASE WHEN strlen(text) > 800 THEN '[X] (String with ' || strlen(text) || ' characters)' WHEN {hits("text", [PROFILES["default"]["patterns"]["email"]])} THEN '[X]' ELSE text END AS text,
    '[X]' AS source, lang FROM documents"""
)
def odd_configuration_mask(spark, sf_dir):
    """A profile from configuration of the wrong types: what can't be used falls back to the defaults."""
    odd = {
        "enabled": "yes", "strategies": ["nothing", 7, BLOCKED, LARGE_STRING, REGEX], "safe_keys": "id", "blocked_keys": {"a": "SOURCE", "b": 3}, "patterns": {"email": PROFILES["default"]["patterns"]["email"], "n": 5},
        "replacement": "[X]", "mark_redacted": False, "track_redacted_keys": 1, "max_value_length": "800", "max_object_size": "50", "shannon_entropy": "on",
    }
    return mask_frame(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), from_config(odd), keep=("doc_id",))


@query(
    f"""SELECT conv_id, turn, CASE WHEN strlen(text) > 300 THEN '(gone) (String with ' || strlen(text) || ' characters)' WHEN {hits("text", PROFILES["default"]["patterns"].values())} THEN '(gone)' ELSE text END AS masked,
    strlen(text) > 300 OR {hits("text", PROFILES["default"]["patterns"].values())} AS redacted FROM conversations"""
)
def environment_mask(spark, sf_dir):
    """The default profile as environment variables change it."""
    p = load(None, env={"UMBRA_REPLACEMENT": "(gone)", "UMBRA_MAX_VALUE_LENGTH": "300", "UMBRA_SHANNON_ENABLED": "false"})
    return with_masked(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), F.col("text"), p, "masked", "redacted").drop("text")


@query(
    " UNION ALL ".join(
        f"""SELECT '{n}' AS profile, conv_id, turn, CASE WHEN {hits("text", c["patterns"].values())} THEN '[REDACTED]' ELSE text END AS text FROM conversations"""
        for n, c in PROFILES.items()
    )
)
def profile_list(spark, sf_dir):
    """A table masked by the patterns of every profile that there is."""
    said = table(spark, sf_dir, "conversations")
    made = [said.select(F.lit(n).alias("profile"), "conv_id", "turn", mask_text(F.col("text"), variant(n, strategies=[REGEX])).alias("text")) for n in available_profiles() if profile_exists(n)]
    return reduce(DataFrame.union, made)


@query(
    f"""SELECT page_id, coalesce(round(h, 6), 0) AS entropy, {common("url", _default_ex)} AS common, url LIKE '%1' AS blocked,
    CASE WHEN strlen(url) > 5000 THEN '[REDACTED] (String with ' || strlen(url) || ' characters)' WHEN {hits("url", PROFILES["default"]["patterns"].values())}
      OR (strlen(url) >= 25 AND NOT {common("url", _default_ex)} AND coalesce(h, 0) >= 4.8) THEN '[REDACTED]' ELSE url END AS masked
    FROM pages LEFT JOIN {entropies("pages", "page_id", "url")} e ON page_id = k"""
)
def sql_functions(spark, sf_dir):
    """The registered SQL functions in a statement."""
    register_sql(spark, load("default", PROFILES))
    table(spark, sf_dir, "pages").createOrReplaceTempView("umbra_pages")
    return spark.sql(
        """SELECT page_id, round(byte_entropy(url), 6) AS entropy, is_common_pattern(url) AS common,
        key_blocked(CASE WHEN url LIKE '%1' THEN 'My_Token' ELSE 'note' END) AS blocked, mask_text(url) AS masked FROM umbra_pages"""
    )


# --- keys ------------------------------------------------------------------------------------


@query("""SELECT c_custkey, '[REDACTED]' AS c_name, c_nationkey, '[REDACTED]' AS c_acctbal, c_mktsegment, true AS _redacted, ['c_name', 'c_acctbal'] AS _redacted_keys FROM customer""")
def blocked_exact(spark, sf_dir):
    return mask_frame(table(spark, sf_dir, "customer"), keyed(blocked=["c_name", "C_ACCTBAL", "name"]))


@query(
    """SELECT '[REDACTED]' AS o_orderkey, '[REDACTED]' AS o_custkey, o_orderstatus, '[REDACTED]' AS o_totalprice, o_orderdate, o_orderpriority,
    true AS _redacted, ['o_orderkey', 'o_custkey', 'o_totalprice'] AS _redacted_keys FROM orders"""
)
def blocked_wildcard(spark, sf_dir):
    return mask_frame(table(spark, sf_dir, "orders"), keyed(blocked=["*key*", "o_*price", "o_*_x", "order*"]))


@query("SELECT s_suppkey, s_name, '[REDACTED]' AS s_nationkey, s_acctbal, true AS _redacted, ['s_nationkey'] AS _redacted_keys FROM supplier")
def safe_over_blocked(spark, sf_dir):
    return mask_frame(table(spark, sf_dir, "supplier"), keyed(["s_suppkey", "s_name"], ["*key", "s_name"]))


@query("SELECT '[REDACTED]' AS \"S_NAME\", s_suppkey AS \"S_SuppKey\", true AS _redacted, ['S_NAME'] AS _redacted_keys FROM supplier")
def key_case_insensitive(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("S_NAME"), F.col("s_suppkey").alias("S_SuppKey"))
    return mask_frame(rows, keyed(["S_SUPPKEY"], ["*NAME*", "*key"]))


_ssn = [PROFILES["strict"]["patterns"]["ssn"]]


@query(
    f"""SELECT '[REDACTED]' AS c_acctbal, c_custkey, CASE WHEN {hits("c_name", _ssn)} THEN '[REDACTED]' ELSE c_name END AS c_name, c_mktsegment,
    true AS _redacted, ['c_acctbal'] AS _redacted_keys FROM customer"""
)
def redacted_flag_and_keys(spark, sf_dir):
    p = from_config({"strategies": [SAFE, BLOCKED, REGEX], "safe_keys": ["c_custkey"], "blocked_keys": ["*acctbal"], "patterns": {"ssn": _ssn[0]}, "track_redacted_keys": True})
    return mask_frame(table(spark, sf_dir, "customer").select("c_acctbal", "c_custkey", "c_name", "c_mktsegment"), p)


@query(
    """SELECT '[REDACTED]' AS c_custkey, c_name, '[REDACTED]' AS c_nationkey, c_acctbal, c_mktsegment FROM customer""",
    "performance_profile_customer",
)
def _performance(spark, sf_dir):
    return mask_frame(table(spark, sf_dir, "customer"), load("performance", PROFILES))


# --- nested ----------------------------------------------------------------------------------


@query(
    """SELECT l_orderkey, CASE WHEN len(v) > 4 THEN NULL ELSE v END AS lines, len(v) > 4 AS _redacted,
    CASE WHEN len(v) > 4 THEN '[REDACTED] (Array with ' || len(v) || ' items)' END AS note
    FROM (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS v FROM lineitem GROUP BY l_orderkey)"""
)
def large_array_notes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("lines"))
    p = from_config({"strategies": [LARGE_OBJECT], "max_object_size": 4})
    out = mask_frame(lines, p, keep=("l_orderkey",))
    return out.select("l_orderkey", "lines", "_redacted", F.element_at("_redaction_notes", "lines").alias("note"))


@query(
    """SELECT event_id, map {'user_id': user_id::VARCHAR, 'event_type': event_type, 'auth_token': '[REDACTED]', 'props': props} AS m,
    true AS _redacted, ['auth_token'] AS _redacted_keys FROM events"""
)
def map_keys_mask(spark, sf_dir):
    cells = [F.lit("user_id"), F.col("user_id").cast("string"), F.lit("event_type"), F.col("event_type"), F.lit("auth_token"), F.col("event_id").cast("string"), F.lit("props"), F.col("props")]
    rows = table(spark, sf_dir, "events").select("event_id", F.create_map(*cells).alias("m"))
    return mask_frame(rows, keyed(["user_id"], ["*token*", "user_*"]), keep=("event_id",))


@query(
    """SELECT event_id, [event_type, '[REDACTED]', props] AS parts, true AS _redacted, ['1'] AS _redacted_keys FROM events"""
)
def list_index_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.array("event_type", F.col("user_id").cast("string"), "props").alias("parts"))
    return mask_frame(rows, keyed(blocked=["1", "7"]), keep=("event_id",))


@query(
    """SELECT o_orderkey, struct_pack(id := o_custkey, owner := struct_pack(name := '[REDACTED]', status := o_orderstatus), total := '[REDACTED]') AS "order",
    '[REDACTED]' AS secret, true AS _redacted, ['name', 'total', 'secret'] AS _redacted_keys FROM orders"""
)
def nested_struct_mask(spark, sf_dir):
    owner = F.struct(F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("status"))
    order = F.struct(F.col("o_custkey").alias("id"), owner.alias("owner"), F.col("o_totalprice").alias("total"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", order.alias("order"), F.struct("o_orderdate").alias("secret"))
    return mask_frame(rows, keyed(["id", "order"], ["name", "total", "secret", "id"]), keep=("o_orderkey",))


# --- documents -------------------------------------------------------------------------------


@query("""SELECT event_id, '{"id":' || event_id || ',"k":"[REDACTED]","_redacted":true,"_redacted_keys":["k"]}' AS doc FROM events""")
def json_doc_mask(spark, sf_dir):
    doc = F.concat(F.lit('{"id": '), F.col("event_id"), F.lit(", "), F.expr("substring(props, 2)"))
    rows = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    return mask_documents(rows, "doc", keyed(blocked=["k"]))


@query(
    """SELECT s_suppkey, '{"id":' || s_suppkey || ',"list":["x","[REDACTED]"],"user":{"name":"' || s_name || '","api_key":"[REDACTED]"},"_redacted":true,"_redacted_keys":["api_key"]}' AS doc
    FROM supplier"""
)
def json_nested_mask(spark, sf_dir):
    p = from_config({"strategies": list(ALL_RULES), "safe_keys": ["id", "user"], "blocked_keys": ["*key*"], "patterns": {"e": "/@/"}, "track_redacted_keys": True})
    doc = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.array(F.lit("x"), F.lit("a@b")).alias("list"), F.struct(F.col("s_name").alias("name"), F.lit(1).alias("api_key")).alias("user")))
    return mask_documents(table(spark, sf_dir, "supplier").select("s_suppkey", doc.alias("doc")), "doc", p)


def _json_chain(profile: str, size: int) -> str:
    """conversations as documents, masked by a profile's rules over texts."""
    c = PROFILES[profile]
    e = c["shannon_entropy"]
    return f"""
WITH d AS (SELECT *, CASE WHEN strlen(text) > {size} THEN 2 WHEN {hits("text", c["patterns"].values())} THEN 1
    WHEN strlen(text) >= {e["min_length"]} AND NOT {common("text", e["exclusion_patterns"])} AND coalesce(h, 0) >= {e["threshold"]} THEN 1 ELSE 0 END AS rule
  FROM (SELECT *, conv_id || '/' || turn AS id FROM conversations) c LEFT JOIN {entropies("conversations", "conv_id || '/' || turn", "text")} e ON c.id = e.k)
SELECT conv_id, turn, '{{"turn":' || turn || ',"role":' || to_json(role) || ',"said":{{"text":' || CASE rule WHEN 1 THEN '"[REDACTED]"'
    WHEN 2 THEN '"[REDACTED] (String with ' || strlen(text) || ' characters)"' ELSE to_json(text) END || '}},"api_key":"[REDACTED]","_redacted":true'
    || '{',"_redacted_keys":["api_key"]' if c["track_redacted_keys"] else ""}}}' AS doc FROM d"""


def _json_records(profile: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        record = F.struct("turn", "role", F.struct("text").alias("said"), F.lit("k").alias("api_key"))
        rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(record).alias("doc"))
        return mask_documents(rows, "doc", load(profile, PROFILES))

    query(_json_chain(profile, PROFILES[profile]["max_value_length"]), f"json_records_{profile}")(run)


_json_records("default")
_json_records("strict")


@query("""SELECT event_id, '{"in":{"pin":"[REDACTED]","user":' || user_id || '},"k":"[REDACTED]"}' AS doc, true AS _redacted FROM events""")
def variant_mask(spark, sf_dir):
    """A VARIANT column's contents, which no schema names (its keys come in their own order)."""
    doc = F.concat(F.lit('{"k":1,"in":{"user":'), F.col("user_id"), F.lit(',"pin":"'), F.col("event_type"), F.lit('"}}'))
    rows = table(spark, sf_dir, "events").select("event_id", F.parse_json(doc).alias("v"))
    masked = mask_frame(rows, keyed(blocked=["k", "pin"], track_redacted_keys=False), keep=("event_id",))
    return masked.select("event_id", F.to_json("v").alias("doc"), "_redacted")


def _list_chain(profile: str) -> str:
    """The profile's rules over conversations' texts as items of a list, and as values of a map."""
    c = PROFILES[profile]
    e, size = c["shannon_entropy"], c["max_value_length"]
    return f"""
SELECT conv_id, turn, [new, role] AS items, map {{'said': new, 'api_key': '[REDACTED]'}} AS cells
FROM (SELECT *, CASE WHEN strlen(text) > {size} THEN '[REDACTED] (String with ' || strlen(text) || ' characters)' WHEN {hits("text", c["patterns"].values())} THEN '[REDACTED]'
    WHEN strlen(text) >= {e["min_length"]} AND NOT {common("text", e["exclusion_patterns"])} AND coalesce(h, 0) >= {e["threshold"]} THEN '[REDACTED]' ELSE text END AS new
  FROM (SELECT *, conv_id || '/' || turn AS id FROM conversations) c LEFT JOIN {entropies("conversations", "conv_id || '/' || turn", "text")} e ON c.id = e.k)"""


def _nested_chain(profile: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = F.create_map(F.lit("said"), F.col("text"), F.lit("api_key"), F.col("role"))
        rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array("text", "role").alias("items"), cells.alias("cells"))
        return mask_frame(rows, load(profile, PROFILES), keep=("conv_id", "turn")).select("conv_id", "turn", "items", "cells")

    query(_list_chain(profile), f"nested_chain_{profile}")(run)


_nested_chain("default")
_nested_chain("strict")


@query(
    f"""WITH d AS (SELECT CASE WHEN strlen(text) > 900 THEN '{LARGE_STRING}' WHEN {hits("text", PROFILES["default"]["patterns"].values())} THEN '{REGEX}' END AS rule FROM conversations)
    SELECT path, rule, rows FROM (SELECT NULL AS path, 'rows' AS rule, count(*) AS rows FROM d UNION ALL SELECT 'role', '{BLOCKED}', count(*) FROM d
    UNION ALL SELECT 'said.text', '{LARGE_STRING}', count(*) FILTER (rule = '{LARGE_STRING}') FROM d
    UNION ALL SELECT 'said.text', '{REGEX}', count(*) FILTER (rule = '{REGEX}') FROM d)"""
)
def mask_report(spark, sf_dir):
    """What a masking job counted while its rows went to a sink."""
    p = variant("default", strategies=[BLOCKED, LARGE_STRING, REGEX], blocked_keys=["role"], max_value_length=900)
    seen = Observation()
    rows = table(spark, sf_dir, "conversations").select("role", F.struct("text").alias("said"))
    mask_frame(rows, p, observation=seen).write.format("noop").mode("overwrite").save()
    return report_of(spark, seen)

_BAD = {
    "preserve": "'{' || event_type",
    "remove": "'__UMBRA_REMOVE__'",
    "empty_array": """'{"_redacted":true}'""",
    "redact": "'[REDACTED] (Non-redactable object string)'",
}


def _policy(policy: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = from_config({"strategies": list(ALL_RULES), "non_redactable_object_behavior": policy})
        good = F.concat(F.lit('{"id":'), F.col("event_id"), F.lit("}"))
        doc = F.when(F.col("user_id") % 3 == 0, good).otherwise(F.concat(F.lit("{"), F.col("event_type")))
        return table(spark, sf_dir, "events").select("event_id", mask_json(doc, p).alias("doc"))

    query(f"SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '{{\"id\":' || event_id || '}}' ELSE {_BAD[policy]} END AS doc FROM events", f"non_redactable_policy_{policy}")(run)


for _p in _BAD:
    _policy(_p)


# A row in three is no document: half a surrogate pair, a number beyond doubles, a byte that is no text.
_ODD = """CASE event_id % 4 WHEN 0 THEN {good} WHEN 1 THEN {pair} WHEN 2 THEN {number} ELSE {byte} END"""


@query(
    "SELECT event_id, hex(" + _ODD.format(good="""'{"user":' || user_id || ',"pin":"[REDACTED]","_redacted":true}'""", pair="'[REDACTED] (Non-redactable object string)'", number="'[REDACTED] (Non-redactable object string)'", byte="'[REDACTED] (Non-redactable object string)'") + """) AS doc,
    CASE WHEN event_id % 4 = 3 AND user_id % 2 = 1 THEN hex('[REDACTED]') WHEN event_id % 4 = 3 THEN '7B22753A22' || hex(user_id::VARCHAR) || 'FF7D' ELSE hex(event_type) END AS text
    FROM events"""
)
def any_bytes_mask(spark, sf_dir):
    """Documents and texts of any bytes, shown in hexadecimal."""
    user = F.col("user_id").cast("string")
    good = F.concat(F.lit('{"user":'), user, F.lit(',"pin":7}')).cast("binary")
    byte = F.concat(F.lit('{"u:"').cast("binary"), user.cast("binary"), F.unhex(F.lit("FF7D")))
    kind = F.col("event_id") % 4
    doc = F.when(kind == 0, good).when(kind == 1, F.lit('{"a":"\\ud800"}').cast("binary")).when(kind == 2, F.lit('{"a":1e999}').cast("binary")).otherwise(byte)
    text = F.when(kind == 3, byte).otherwise(F.col("event_type").cast("binary"))
    rows = table(spark, sf_dir, "events").select("event_id", doc.cast("string").alias("doc"), text.cast("string").alias("text"))
    p = keyed(blocked=["pin"], strategies=list(ALL_RULES), patterns={"odd": r"/[13579]\xff\}$/"}, non_redactable_object_behavior="redact", track_redacted_keys=False)
    masked = mask_documents(rows, "doc", p).withColumn("text", mask_text(F.col("text"), p))
    return masked.select("event_id", *(F.hex(F.col(c).cast("binary")).alias(c) for c in ("doc", "text")))


# --- scans -----------------------------------------------------------------------------------

_scan_e = PROFILES["file_scan"]["shannon_entropy"]
_SCANNED = f"""(SELECT url, html, {hits("html", PROFILES["file_scan"]["patterns"].values())}
    OR (strlen(html) >= 25 AND NOT {common("html", _scan_ex)} AND coalesce(h, 0) >= {_scan_e["threshold"]}) AS hit
  FROM pages LEFT JOIN {entropies("pages", "page_id", "html")} e ON page_id = k)"""


def _scanned(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return scan_contents(pages, load("file_scan", PROFILES))


@query(
    f"""SELECT url AS path, CASE WHEN hit THEN 'findings' ELSE 'clean' END AS status, hit::INTEGER AS findings_count,
    CASE WHEN hit THEN 'full_content_redacted' END AS type, CASE WHEN hit THEN strlen(html) END AS original_length, 'file_scan' AS profile FROM {_SCANNED}"""
)
def scan_findings(spark, sf_dir):
    first = F.get("findings", 0)
    return report(_scanned(spark, sf_dir)).select("path", "status", "findings_count", first["type"].alias("type"), first["original_length"].alias("original_length"), "profile")


@query(f"SELECT count(*) AS files_scanned, count(*) FILTER (WHERE hit) AS files_with_findings FROM {_SCANNED}")
def scan_summary(spark, sf_dir):
    return summary(_scanned(spark, sf_dir))


@query(
    f"""SELECT CASE WHEN hit THEN 'FINDINGS' ELSE 'CLEAN' END AS status, hit::INTEGER::VARCHAR AS findings,
    CASE WHEN strlen(url) > 60 THEN '...' || right(url, 57) ELSE url END AS file_path FROM {_SCANNED}"""
)
def scan_status_table(spark, sf_dir):
    return status_table(_scanned(spark, sf_dir))


@query()
def file_source(spark, sf_dir):
    """The tables' own files through the file source, every one whatever its size."""
    return digest_files(spark, [sf_dir], max_size=sys.maxsize).select(F.substring_index("path", "/", -1).alias("name"), "length", "sha256")


@query()
def scan_in_parts(spark, sf_dir):
    """Findings in the tables' own files, byte ranges of 256 KiB in tasks of their own."""
    found = scan_files(spark, [sf_dir], load("file_scan", PROFILES), max_size=sys.maxsize, part=1 << 18)
    kinds = F.transform("findings", lambda f: f["type"])
    return found.select(F.substring_index("path", "/", -1).alias("name"), F.array_join(kinds, ",").alias("types"), "skipped", "profile")


@query("SELECT event_id::VARCHAR AS path, event_type || '_token' AS type, 1 AS findings_count FROM events")
def scan_document_keys(spark, sf_dir):
    """Findings in documents: the keys masked by name."""
    doc = F.concat(F.lit('{"n":1,"in":{"'), F.col("event_type"), F.lit('_token":2}}'))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), doc.alias("doc"))
    found = scan_documents(rows, keyed(blocked=["*token*"]), "path", "doc")
    return found.select("path", F.get("findings", 0)["type"].alias("type"), F.size("findings").alias("findings_count"))


# --- logs, custom rules, streams -------------------------------------------------------------


def _records(events: DataFrame) -> DataFrame:
    context = F.struct(F.col("user_id"), F.lit("t-1").alias("api_token"), F.lit(None).cast("string").alias("note"))
    return events.select("event_id", F.col("ts").alias("datetime"), F.lit("app").alias("channel"), F.upper("event_type").alias("level"), F.col("props").alias("message"), context.alias("context"))


_LINE = """'[' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '] app.' || upper(event_type) || ': ' || props
    || ' {"user_id":' || user_id || ',"api_token":"[REDACTED]","note":null,"_redacted":true}' || chr(10)"""


@query(f"SELECT {_LINE} AS line FROM events", "log_lines")
def _log_lines(spark, sf_dir):
    return log_lines(_records(table(spark, sf_dir, "events")), load("default", PROFILES))


@query(f"SELECT {_LINE} AS line FROM events ORDER BY event_id LIMIT 1")
def log_batch_first(spark, sf_dir):
    """A batch of which only the first record is formatted."""
    return batch_lines(_records(table(spark, sf_dir, "events")), load("default", PROFILES), order="event_id", first_only=True)


@query(f"SELECT {_LINE} AS line FROM events")
def log_tap(spark, sf_dir):
    """Log records of a stream, masked batch by batch; what was written is read back."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = f"{shared_folder(spark)}/tap-{uuid.uuid4().hex}"
    writer = tap(_records(stream), load("default", PROFILES), lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("line string").parquet(f"{folder}/out").select("line")


class RoleRule(ColumnStrategy):
    """Names who spoke only as far as a role's first letter."""

    def predicate(self, value, key, kind, profile):
        return key == "role" and value.isNotNull()

    def replace(self, value, key, kind, profile):
        return F.concat(F.substring(value, 1, 1), F.lit("***"))


@query("SELECT conv_id, turn, left(role, 1) || '***' AS role, role IS NOT NULL AS _redacted FROM conversations")
def custom_strategy_mask(spark, sf_dir):
    register("role_rule", RoleRule())
    p = from_config({"strategies": ["role_rule", BLOCKED, "unknown"], "blocked_keys": ["role"]})
    return mask_frame(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), p)


class HandlerRule(PyStrategy):
    """Named by its class in a configuration: ``gone`` goes, and a list becomes a text, which is wrapped at the root."""

    def should_handle(self, value, key, profile):
        return key == "gone" or (isinstance(value, list) and key in ("", "items"))

    def handle(self, value, key, profile, context):
        context.redacted = True
        return REMOVE if key == "gone" else f"{len(value)} items"


@query(
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"id":' || event_id || ',"items":"2 items","in":{},"_redacted":true}'
    ELSE '{"_redacted_array":"1 items","_redacted":true}' END AS doc, 'handler_rule,blocked_keys' AS rules FROM events"""
)
def handler_mask(spark, sf_dir):
    """A strategy loaded from a class's name, with removal and wrapping; and the rules that the profile then has."""
    load_custom({"handler_rule": f"{__name__}.HandlerRule", "broken": "no.such.Class", "other": "umbra.profiles.Profile"})
    p = from_config({"strategies": ["handler_rule", "broken", "other", BLOCKED], "blocked_keys": ["pin"]})
    whole = F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(',"gone":{"pin":1},"items":['), F.col("user_id"), F.lit(',2],"in":{"gone":1}}'))
    doc = F.when(F.col("event_id") % 2 == 0, whole).otherwise(F.concat(F.lit("["), F.col("user_id"), F.lit("]")))
    return table(spark, sf_dir, "events").select("event_id", mask_json(doc, p).alias("doc"), F.lit(",".join(n for n, _ in named(p))).alias("rules"))


class DropRule(ColumnStrategy):
    """Whatever is called ``drop_*`` goes, and list items and map values that say so."""

    removes = True

    def predicate(self, value, key, kind, profile):
        if isinstance(key, str):
            return key.startswith("drop_")
        said = (value == "error") if kind.typeName() == "string" else F.lit(False)
        return key.startswith("drop_") | F.coalesce(said, F.lit(False))


@query(
    """SELECT event_id, struct_pack(kept := event_type) AS pair, map_from_entries(list_filter([ROW('type', event_type), ROW('auth_token', '[REDACTED]')], lambda e: e[2] <> 'error')) AS m,
    list_filter([event_type, 'x'], lambda e: e <> 'error') AS items, true AS _redacted FROM events"""
)
def removal_mask(spark, sf_dir):
    register("drop_rule", DropRule())
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    m = F.create_map(F.lit("type"), kind, F.lit("drop_user"), user, F.lit("auth_token"), F.lit("t"))
    rows = table(spark, sf_dir, "events").select("event_id", F.struct(kind.alias("kept"), user.alias("drop_user")).alias("pair"), m.alias("m"), F.array(kind, F.lit("x")).alias("items"), user.alias("drop_me"))
    return mask_frame(rows, from_config({"strategies": ["drop_rule", BLOCKED], "blocked_keys": ["*token"]}), keep=("event_id",))


@query("SELECT event_id, '[REDACTED]' AS user_id, event_type, props, true AS _redacted FROM events")
def mask_stream(spark, sf_dir):
    """The masking of a stream, run over all that is there; its output is read back."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    masked = mask_frame(stream.select("event_id", "user_id", "event_type", "props"), keyed(blocked=["user_id"], track_redacted_keys=False))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = masked.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.start(f"{folder}/out").awaitTermination()
    return spark.read.schema(masked.schema).parquet(f"{folder}/out")
