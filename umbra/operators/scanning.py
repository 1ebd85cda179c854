"""Findings in whole contents, and reports of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.operators.document import mask_json
from umbra.operators.rules import DECISION, Text, branches, hits, with_decision
from umbra.profiles import REDACTED, Profile

#: One character stands for one byte, so patterns and lengths mean bytes whatever they are.
BYTES = Text("ISO-8859-1")
LENGTH = "_umbra_length"
FINDING = "struct<type:string,reason:string,original_length:bigint,profile:string>"


#: Type and reason of what a content as a whole can be found to be.
DECIDED = {"whole": ("full_content_redacted", "Entire content was redacted"), "large": ("large_string", "Content was collapsed for its length")}


def finding(kind: str, reason: str, length: Column, profile: Profile) -> Column:
    return F.array(
        F.struct(F.lit(kind).alias("type"), F.lit(reason).alias("reason"), length.cast("long").alias("original_length"), F.lit(profile.name).alias("profile"))
    )


def scan_contents(df: DataFrame, profile: Profile, path: str = "path", content: str = "content", compat: bool = False) -> DataFrame:
    """path, findings, profile, skipped, error for each row, its content (binary or string) one value.

    A content that was masked as a whole is a finding; so is one that was collapsed for
    its length, unless ``compat``, where only the plain replacement ``[REDACTED]``
    counts.  A null content was skipped: its error is the ``error`` column's or "File
    unreadable".
    """
    raw = F.col(f"`{content}`")
    if dict(df.dtypes)[content] == "binary":
        value, length, text = F.decode(raw, BYTES.charset), F.octet_length(raw), BYTES
    else:
        value, length, text = raw, F.octet_length(raw), Text()
    none = F.array().cast(f"array<{FINDING}>")
    whole, large = (finding(*DECIDED[d], F.col(LENGTH), profile) for d in ("whole", "large"))
    rules = branches(value, "", T.StringType(), profile, text) if profile.enabled else []
    own = value == F.lit(profile.replacement)
    plain, other = [F.lit(False)], [F.lit(False)]  # of the branches: those that leave the replacement, and those that leave something else
    for i in hits(rules):
        here = F.col(DECISION) == i
        became = F.lit(True) if rules[i - 1].plain else rules[i - 1].value == F.lit(profile.replacement)
        plain.append(here & became)
        other.append(here & ~became & (rules[i - 1].value != value))
    plain, other = reduce(Column.__or__, plain), reduce(Column.__or__, other)
    if compat:
        found = F.when((plain & F.lit(profile.replacement == REDACTED)) | ((F.col(DECISION) == 0) & (value == REDACTED)), whole)
    else:
        found = F.when(plain & ~own, whole).when(other, large)
    said = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    skipped = raw.isNull()
    # The content is decided on once; no later step holds its masked text.
    decided = with_decision(df, rules, value, profile, text).withColumn(LENGTH, length)
    return decided.select(
        F.col(f"`{path}`").alias("path"),
        F.when(skipped, none).otherwise(F.coalesce(found, none)).alias("findings"),
        F.lit(profile.name).alias("profile"),
        skipped.alias("skipped"),
        F.when(skipped, F.coalesce(said, F.lit("File unreadable"))).alias("error"),
    )


def scan_documents(df: DataFrame, profile: Profile, path: str, document: str) -> DataFrame:
    """The same for a column of JSON documents: a finding for each key masked by name."""
    masked = F.get_json_object(mask_json(F.col(f"`{document}`"), profile), "$._redacted_keys")
    keys = F.from_json(masked, "array<string>")
    made = F.transform(
        keys,
        lambda k: F.struct(k.alias("type"), F.lit("Key was redacted").alias("reason"), F.lit(None).cast("long").alias("original_length"), F.lit(profile.name).alias("profile")),
    )
    return df.select(
        F.col(f"`{path}`").alias("path"),
        F.coalesce(made, F.array().cast(f"array<{FINDING}>")).alias("findings"),
        F.lit(profile.name).alias("profile"),
        F.col(f"`{document}`").isNull().alias("skipped"),
        F.lit(None).cast("string").alias("error"),
    )


def has_findings() -> Column:
    return F.size("findings") > 0


def report(results: DataFrame) -> DataFrame:
    """path, status, findings_count, findings, profile, error, as the JSON output has them."""
    status = F.when(F.col("skipped"), "skipped").when(has_findings(), "findings").otherwise("clean")
    return results.select("path", status.alias("status"), F.size("findings").alias("findings_count"), "findings", "profile", "error")


def status_table(results: DataFrame) -> DataFrame:
    """status, findings, file_path, as the table output has them; long paths keep their end."""
    status = F.when(F.col("skipped"), "SKIPPED").when(has_findings(), "FINDINGS").otherwise("CLEAN")
    count = F.when(F.col("skipped"), "-").otherwise(F.size("findings").cast("string"))
    path = F.col("path")
    raw = F.encode(path, "UTF-8")  # lengths are bytes; a character cut in two at the start is left out
    tail = F.decode(F.encode(F.regexp_replace(F.decode(F.substring(raw, -57, 57), "ISO-8859-1"), "^[\\x80-\\xbf]+", ""), "ISO-8859-1"), "UTF-8")
    end = F.when(F.octet_length(path) > 60, F.concat(F.lit("..."), tail)).otherwise(path)
    return results.select(status.alias("status"), count.alias("findings"), end.alias("file_path"))


def summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("files_scanned"), F.count_if(has_findings()).alias("files_with_findings"))
