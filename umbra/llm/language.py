"""Language identification by Bayesian fusion of four kinds of evidence.

text      a multinomial over hashed byte trigrams for each language, counted over every
          document that declares it; a text counts as at most TEXT_WEIGHT independent
          trigrams, as neighbouring ones are not independent
declared  P(declared language | language), the markup's statement
suffix    P(last label of the address | language)
host      P(language | host), smoothed towards the host's domain, and that towards the
          corpus, without the document's own share

The last three are grouped sums of the texts' own posteriors over all documents, so a
declaration is trusted as far as it has agreed with texts.  A further class, "und", has
all trigrams alike; it takes texts that no language explains.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import arrow_batches, cut, inputs, join_per_key

LANGUAGES = ("en", "de", "fr", "es")
UNKNOWN = "und"
BUCKETS = 1 << 14
TEXT_WEIGHT = 50
HOST_STRENGTH, DOMAIN_STRENGTH, EVIDENCE_STRENGTH = 20.0, 50.0, 10.0
LEAST_CONFIDENCE = 0.5


def trigrams(text: str):
    """The bucket of every three neighbouring bytes of the lower-cased text."""
    import numpy as np

    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64)


def text_model(rows: DataFrame, languages: tuple[str, ...]):
    """log P(bucket | language), one row a language and one for UNKNOWN; counted over all rows of ``rows``."""
    import numpy as np

    def count(iterator):
        import pyarrow as pa

        total = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for _, (texts, declared) in arrow_batches(iterator, ["_t", "declared"]):
            for t, d in zip(texts, declared):
                if t and d in languages:
                    total[languages.index(d)] += np.bincount(trigrams(t), minlength=BUCKETS)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[at], pa.int64())], ["l", "b", "n"])

    counts = np.zeros((len(languages), BUCKETS))
    for r in rows.select("_t", "declared").mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).collect():
        counts[r.l, r.b] = r.n  # languages x buckets rows at most
    smooth = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    return np.log(np.vstack([smooth, np.full(BUCKETS, 1 / BUCKETS)]))


def scored(rows: DataFrame, model) -> DataFrame:
    """``rows`` without the text: with n_grams and ll, the weighted log-likelihoods."""
    import numpy as np

    shared = rows.sparkSession.sparkContext.broadcast(model.astype(np.float32).T.copy())  # buckets x languages
    keep = [c for c in rows.columns if c != "_t"]

    def run(iterator):
        import pyarrow as pa

        table = shared.value
        for batch, (texts,) in arrow_batches(iterator, ["_t"]):
            n, ll = [], []
            for t in texts:
                grams = trigrams(t or "")
                n.append(len(grams))
                mean = sum_of(table, grams) / max(len(grams), 1)
                ll.append((mean * min(len(grams), TEXT_WEIGHT)).tolist())
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(ll, pa.list_(pa.float64()))], [*keep, "n_grams", "ll"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_t")
    return rows.mapInArrow(run, schema + ", n_grams long, ll array<double>")


def sum_of(table, grams):
    """The table's rows summed, a block of ``grams`` at a time."""
    import numpy as np

    total = np.zeros(table.shape[1])
    for i in range(0, len(grams), 1 << 16):
        total += table[grams[i : i + (1 << 16)]].sum(axis=0, dtype=np.float64)
    return total


def _softmax(x: Column) -> Column:
    """exp of an array of logs, the largest as 1; still to be divided by its sum."""
    return F.transform(x, lambda v: F.exp(v - F.array_max(x)))


def _normal(x: Column, total: Column) -> Column:
    return F.transform(x, lambda v: v / total)


def identify(
    df: DataFrame,
    languages: tuple[str, ...] = LANGUAGES,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str = "lang",
    host_col: str = "source",
) -> DataFrame:
    """One row for each row of ``df``: doc_id, lang, confidence, text_lang, n_grams, kept.

    lang is the language (or "und") of the largest posterior, confidence that posterior,
    text_lang the language of the text alone; of equal ones the first of ``languages``.
    A text of fewer than three bytes (null and empty ones too) is "und" with confidence
    0.  kept: a language was found with LEAST_CONFIDENCE.  Missing declarations and
    hosts, and columns that ``df`` lacks, are no evidence; declarations are compared by
    their first subtag in lower case.  Ids may be null or repeat.  An empty table gives
    no rows.
    """
    names = (*languages, UNKNOWN)
    size = len(names)
    rows = inputs(df, doc_id=(id_col, "long"), _t=(text_col, "string"), declared=(declared_col, "string"), host=(host_col, "string"))
    subtag = F.regexp_extract(F.lower(F.trim("declared")), "^([a-z]+)", 1)
    host = F.lower("host")
    rows = rows.select(
        "doc_id",
        "_t",
        F.when(F.length(subtag) > 0, subtag).alias("declared"),
        F.coalesce(F.concat(F.lit("+"), host), F.lit("-")).alias("host"),
        F.coalesce(F.concat(F.lit("+"), F.regexp_extract(host, r"([^.]+\.)?[^.]+$", 0)), F.lit("-")).alias("domain"),
        F.when(F.instr(host, ".") > 0, F.regexp_extract(host, r"[^.]+$", 0)).alias("suffix"),
    )
    model = text_model(rows, languages)
    rows = scored(rows, model).withColumn("e", _softmax(F.col("ll"))).withColumn("s", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    rows = cut(rows.select("doc_id", "declared", "host", "domain", "suffix", "n_grams", "ll", _normal(F.col("e"), F.col("s")).alias("r")))
    # Texts without trigrams say nothing about their host or declaration.
    said = rows.where("n_grams > 0")
    sums = [F.sum(F.col("r")[i]).alias(f"c{i}") for i in range(size)]
    whole = said.agg(*sums).first()
    whole = [whole[i] or 0.0 for i in range(size)]
    share = [(w + 1) / (sum(whole) + size) for w in whole]

    def grouped(key: str) -> DataFrame:
        return said.where(F.col(key).isNotNull()).groupBy(key).agg(*sums).select(key, F.array(*(F.col(f"c{i}") for i in range(size))).alias("c"))

    def likelihood(key: str) -> DataFrame:
        """log P(key | language), smoothed towards the key's share of the corpus."""
        n = sum(whole) or 1.0
        own = F.aggregate("c", F.lit(0.0), lambda a, v: a + v) / n
        logs = [F.log((F.col("c")[i] + EVIDENCE_STRENGTH * F.col("own")) / F.lit(whole[i] + EVIDENCE_STRENGTH)) for i in range(size)]
        return grouped(key).withColumn("own", own).select(key, F.array(*logs).alias(f"{key}_log"))

    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    domains = grouped("domain").select("domain", F.transform("c", lambda v, i: v + DOMAIN_STRENGTH * F.get(F.array(*map(F.lit, share)), i)).alias("c"))
    domains = domains.select("domain", F.col("c").alias("dc"), total(F.col("c")).alias("dn"))
    hosts = grouped("host").select("host", F.col("c").alias("hc"), total(F.col("c")).alias("hn"))
    out = rows
    for key, side in (("domain", domains), ("host", hosts), ("declared", likelihood("declared")), ("suffix", likelihood("suffix"))):
        out = join_per_key(out, cut(side), key)

    one = F.when(F.col("n_grams") > 0, 1.0).otherwise(0.0)

    def evidence(i: int) -> Column:
        own = F.col("r")[i] * one
        base = (F.coalesce(F.col("dc")[i], F.lit(DOMAIN_STRENGTH * share[i])) - own) / (F.coalesce("dn", F.lit(DOMAIN_STRENGTH)) - one)
        prior = (F.greatest(F.coalesce(F.col("hc")[i], F.lit(0.0)) - own, F.lit(0.0)) + HOST_STRENGTH * base) / (F.coalesce("hn", F.lit(0.0)) - one + HOST_STRENGTH)
        logs = [F.coalesce(F.col(f"{k}_log")[i], F.lit(0.0)) for k in ("declared", "suffix")]
        return F.col("ll")[i] + F.log(F.greatest(prior, F.lit(1e-9))) + reduce(Column.__add__, logs)

    out = out.withColumn("p", F.array(*(evidence(i) for i in range(size)))).withColumn("e", _softmax(F.col("p")))
    best = lambda x: F.get(F.array(*map(F.lit, names)), (F.array_position(x, F.array_max(x)) - 1).cast("int"))
    some = F.col("n_grams") > 0
    out = out.select(
        "doc_id",
        F.when(some, best(F.col("p"))).otherwise(UNKNOWN).alias("lang"),
        F.when(some, F.array_max("e") / total(F.col("e"))).otherwise(0.0).alias("confidence"),
        F.when(some, best(F.col("ll"))).otherwise(UNKNOWN).alias("text_lang"),
        "n_grams",
    )
    return out.withColumn("kept", (F.col("lang") != UNKNOWN) & (F.col("confidence") >= LEAST_CONFIDENCE))


def page_inputs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(doc_id, text, lang, source) of web pages: text without markup, the html element's language, the address's host."""
    page = inputs(pages, doc_id=(id_col, "long"), u=(url_col, "string"), h=(html_col, "string"))
    bare = F.regexp_replace("h", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.regexp_extract("h", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    host = F.regexp_extract("u", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    return page.select("doc_id", bare.alias("text"), F.when(declared != "", declared).alias("lang"), F.when(host != "", host).alias("source"))
