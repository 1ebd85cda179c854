"""Host-level quality rules with an empirical beta prior.

Each document is measured once, over its whole text, and held against the rules.
Failures are summed by host; the rates are shrunk towards the corpus rate by a beta
prior whose strength is fitted to the spread between hosts by moments, so that a host
of three documents isn't condemned by two of them.  A host's verdict then comes back to
its documents: a rejected host loses all, a suspect one is held to the strict limits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import arrow_batches, cut, inputs, join_per_key

WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Limits:
    """Shares in percent; a document fails a rule beyond its limit."""

    min_words: int = 10
    repeat_words: int = 20
    symbols: int = 10
    dup_lines: int = 30
    strict_symbols: int = 5
    strict_dup_lines: int = 15
    suspect_rate: float = 0.4
    reject_rate: float = 0.6


def repeat_words(words: list, window: int = WINDOW) -> int:
    """Words in windows that occur at least twice, first occurrences included.

    Windows are told apart exactly: numbers of shorter windows are paired and renumbered.
    """
    import numpy as np

    n = len(words)
    if n <= window:
        return 0
    seen: dict = {}
    one = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    ranks, width = one, 1
    while width < window:
        step = min(width, window - width)
        tail = ranks if step == width else one
        if step not in (1, width):
            step, tail = 1, one
        keys = ranks[: n - width - step + 1] * (n + 1) + tail[width : n - step + 1]
        _, ranks, counts = np.unique(keys, return_inverse=True, return_counts=True)
        width += step
    starts = np.flatnonzero(counts[ranks] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """COUNTS of a whole text; null and empty texts have none of anything."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeat_words(words),
        lines,
    )


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    def run(iterator):
        import pyarrow as pa

        for batch, (texts,) in arrow_batches(iterator, ["_t"]):
            columns = list(zip(*map(measure, texts))) or [()] * len(COUNTS)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "host")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "host", *COUNTS])

    rows = inputs(df, doc_id=(id_col, "long"), host=(host_col, "string"), _t=(text_col, "string"))
    return rows.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) by moments from host rows (n_docs, n_failed); one aggregate row reaches the driver.

    The spread between hosts is the spread of their rates less what chance alone gives.
    The prior's strength stays within 1 and 1,000,000 documents; without documents it is (0.5, 0.5).
    """
    a = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("h")).first()
    if not a.n:
        return 0.5, 0.5
    m = a.f / a.n
    v = hosts.agg((F.sum(F.col("n_docs") * F.pow(F.col("n_failed") / F.col("n_docs") - F.lit(m), 2)) / a.n).alias("v")).first().v
    chance = m * (1 - m)
    between = v - chance * a.h / a.n
    strength = min(max(chance / between - 1, 1.0), 1e6) if between > chance * 1e-6 else (1e6 if chance else 1.0)
    return m * strength, (1 - m) * strength


def judge(df: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each row of ``df``: doc_id, host, COUNTS, base_failed, failed, host_rate, host_verdict, kept.

    base_failed: too few words or too many repeated; failed: that, or too many symbols
    or lines that repeat an earlier one.  kept is false if base_failed, if the host is
    rejected, or if the document fails the symbol or line rule at the limits its host's
    verdict sets.  Rows without a host share one; null, empty and blank texts have no
    words and fail; repeated rows count as often as they stand; an empty table gives none.
    """
    rows = cut(measured(df, id_col, text_col, host_col))
    share = lambda part, whole, limit: 100 * F.col(part) > limit * F.col(whole)
    base = (F.col("n_words") < limits.min_words) | share("n_repeat_words", "n_words", limits.repeat_words)
    soft = share("n_symbols", "n_words", limits.symbols) | share("n_dup_lines", "n_lines", limits.dup_lines)
    strict = share("n_symbols", "n_words", limits.strict_symbols) | share("n_dup_lines", "n_lines", limits.strict_dup_lines)
    rows = rows.select(
        "*", base.alias("base_failed"), (base | soft).alias("failed"), soft.alias("_soft"), strict.alias("_strict"), F.coalesce(F.concat(F.lit("+"), "host"), F.lit("-")).alias("_host")
    )
    hosts = cut(rows.groupBy("_host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("int")).alias("n_failed")))
    alpha, beta = beta_prior(hosts)
    rate = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    verdict = F.when(F.col("host_rate") > limits.reject_rate, "reject").when(F.col("host_rate") > limits.suspect_rate, "suspect").otherwise("trust")
    hosts = cut(hosts.select("_host", rate.alias("host_rate")).withColumn("host_verdict", verdict))
    kept = ~F.col("base_failed") & F.when(F.col("host_verdict") == "reject", False).when(F.col("host_verdict") == "suspect", ~F.col("_strict")).otherwise(~F.col("_soft"))
    return join_per_key(rows, hosts, "_host").select("doc_id", "host", *COUNTS, "base_failed", "failed", "host_rate", "host_verdict", kept.alias("kept"))
