"""Allow and block lists for URLs, and a classifier for those that no rule names.

Rules fit a host with all its subdomains and paths by their start; the longest decides.
What rules decide also teaches a multinomial naive Bayes model: hosts are cut into
names, names into words by a unigram Viterbi pass over the words of the pages
themselves, and words of hosts and tokens of paths are the model's features.  Hosts
and paths are each scored once, however many pages share them.
"""

from __future__ import annotations

import re
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import cut, inputs, join_per_key
from umbra.llm.divergence import terms
from umbra.llm.segmentation import UNIT, segmented, word_counts

ALLOW, BLOCK = "allow", "block"
#: Runs of letters (ASCII, or beyond it) and of digits.
_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_TOKENS = _LETTERS + "|[0-9]+"
_TAG = re.compile(rb"<[^<>]*>?")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def lower(value: Column) -> Column:
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first "://" and "/", "?", "#" or the end, and what follows up to "?", "#" or the end; else empty."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or null; of equally long ones the first given."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    fits = [(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), r) for r in sorted(rules, key=lambda r: -len(r.text))]
    first = lambda of: F.coalesce(*(F.when(hit, F.lit(of(r))) for hit, r in fits))
    return first(lambda r: r.text), first(lambda r: r.verdict)


def shapes(text: Column, kind: str) -> Column:
    """Tokens with their kind; a run of digits counts by its length."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({_TOKENS})"), F.lit(1)), lambda t: F.concat(F.lit(kind), F.when(t.rlike("^[0-9]"), F.concat(F.lit("#"), F.length(t))).otherwise(t)))


def page_words(html: bytes) -> list[bytes]:
    """Words outside of tags."""
    return terms(_TAG.sub(b" ", html))


def host_tokens(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, token) with repeats: the last label as it stands, of the others the words of their names."""
    labels = F.split("host", r"\.")
    last = F.element_at(labels, -1)
    front = F.array_join(F.slice(labels, 1, F.size(labels) - 1), ".")
    names = hosts.select("host", F.explode(F.regexp_extract_all(front, F.lit(f"({_LETTERS})"), F.lit(1))).alias("name"))
    split = cut(segmented(names.select("name").distinct(), words))
    of_names = join_per_key(names, split, "name", "inner").select("host", F.explode("words").alias("token")).select("host", F.concat(F.lit("h:"), "token").alias("token"))
    numbers = hosts.select("host", F.explode(F.regexp_extract_all(front, F.lit("([0-9]+)"), F.lit(1))).alias("t")).select("host", F.concat(F.lit("h:#"), F.length("t")).alias("token"))
    return of_names.union(numbers).union(hosts.select("host", F.explode(shapes(last, "h:")).alias("token")))


def weights(counts: DataFrame, pages: dict[str, int], alpha: float) -> tuple[DataFrame, int]:
    """(token, weight) and the prior, in whole UNITs of the log odds of blocking; counts: token, allow, block."""
    sums = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (ALLOW, BLOCK)), F.count("*").alias("v")).first()
    odds = lambda c, total: F.log((F.col(c) + alpha) / F.lit(total + alpha * sums.v))
    table = counts.select("token", F.round(UNIT * (odds(BLOCK, sums[BLOCK]) - odds(ALLOW, sums[ALLOW]))).cast("long").alias("weight"))
    import math

    return table, round(UNIT * math.log((pages.get(BLOCK, 0) + 1) / (pages.get(ALLOW, 0) + 1)))


def judge_urls(
    df: DataFrame,
    rules: list[Rule],
    alpha: float = 1.0,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row for each row of ``df``: page_id, host, path, rule, verdict, score, host_words.

    rule is the longest one that fits, or null; verdict its own, or else "block" where
    the log odds ``score`` (in whole millionths, null beside a rule) are over zero and
    "allow" where not.  Tokens that no ruled page has say nothing.  Without ruled pages
    all others are allowed; with ruled pages of one verdict only, the prior and the
    smoothing decide.

    A null url, or one without "://", has an empty host and path and the prior's
    verdict.  Null and empty pages have no words; without any words a name is split as
    unknown, that is not at all.  Names of over 63 characters stay whole.  Repeated rows
    and ids count as often as they stand; an empty table gives no rows.
    """
    rows = inputs(df, page_id=(id_col, "long"), url=(url_col, "string"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruling = ruled(F.col("host"), F.col("path"), rules)
    rows = cut(rows.select("*", rule.alias("rule"), ruling.alias("ruling")))

    html = inputs(df, html=(html_col, "string")).where("html is not null").select(F.col("html").cast("binary"))
    words = cut(word_counts(html, page_words))
    by_host = cut(rows.groupBy("host").agg(*(F.count_if(F.col("ruling") == v).alias(v) for v in (ALLOW, BLOCK))))
    # A host's words with their numbers: an array of a row a token, bounded by the host's length.
    tokens = cut(host_tokens(by_host.select("host"), words))
    per_host = join_per_key(tokens, by_host, "host", "inner").groupBy("token").agg(*(F.sum(v).alias(v) for v in (ALLOW, BLOCK)))
    per_path = rows.where("ruling is not null").select("ruling", F.explode(shapes(lower(F.col("path")), "p:")).alias("token"))
    per_path = per_path.groupBy("token").agg(*(F.count_if(F.col("ruling") == v).alias(v) for v in (ALLOW, BLOCK)))
    counts = cut(per_host.union(per_path).where(f"{ALLOW} + {BLOCK} > 0"))
    pages = by_host.agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in (ALLOW, BLOCK))).first().asDict()
    model, prior = weights(counts, pages, alpha)
    model = cut(model)

    of_hosts = join_per_key(tokens, model, "token").groupBy("host").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("host_score"), F.sort_array(F.collect_list(F.substring("token", 3, 1 << 30))).alias("host_words"))
    paths = rows.where("ruling is null").select("path").distinct()
    of_paths = join_per_key(paths.select("path", F.explode(shapes(lower(F.col("path")), "p:")).alias("token")), model, "token", "inner").groupBy("path").agg(F.sum("weight").alias("path_score"))
    out = join_per_key(join_per_key(rows, cut(of_hosts), "host"), cut(of_paths), "path")
    score = F.when(F.col("ruling").isNull(), F.lit(prior) + F.coalesce("host_score", F.lit(0)) + F.coalesce("path_score", F.lit(0)))
    verdict = F.coalesce("ruling", F.when(score > 0, BLOCK).otherwise(ALLOW))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"), F.coalesce("host_words", F.array().cast("array<string>")).alias("host_words"))
