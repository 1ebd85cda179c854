"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.common import cut, table
from umbra.llm.divergence import audit
from umbra.llm.hard_negatives import mine
from umbra.llm.language import identify, page_inputs
from umbra.llm.licences import TEMPLATES, THRESHOLD, scan
from umbra.llm.line_dedup import PER, line_classes
from umbra.llm.neighbours import nearest
from umbra.llm.oracles import HARD_NEGATIVES, QUALITY_RULES, SOURCE_AUDIT, licences
from umbra.llm.packing import pack
from umbra.llm.quality_model import score, train
from umbra.llm.quality_rules import judge
from umbra.llm.sentencepieces import decode, encode
from umbra.llm.sharding import shard_by_bytes
from umbra.llm.simhash import near_duplicates
from umbra.llm.url_filter import ALLOW, BLOCK, Rule, judge_urls

N_SHARDS = 8
#: Fixed by the query's contract.
URL_RULES = [Rule(ALLOW, "org", "/"), Rule(BLOCK, "example.org", "/es/"), Rule(BLOCK, "example.org", "/en/1"), Rule(ALLOW, "com", "/fr/"), Rule(BLOCK, "com", "/de/")]


def tokenizer(name: str) -> str:
    """The path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"), N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *counts, "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).withColumn("confidence", F.round("confidence", 6))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over web pages, with the markup's language and the address's suffix."""
    return identify(page_inputs(table(spark, sf_dir, "pages"))).withColumnRenamed("doc_id", "page_id").withColumn("confidence", F.round("confidence", 6))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(table(spark, sf_dir, "documents"), per=PER, short=True).drop("row")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cut(score(docs, train(docs, table(spark, sf_dir, "labels"))))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 6))


def op8_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the ids' number and checksum, and whether decoding them gives the text back."""
    model = tokenizer("piece_bpe_32k.model")
    out = decode(encode(table(spark, sf_dir, "documents"), model), model)
    digest = out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        "n_chunks",
        F.octet_length("decoded").cast("long").alias("decoded_bytes"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )
    return cut(digest)  # texts go through two steps in Python: in small batches


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where vec_id is divisible by 7 a row counts as one of the next label (fixed by the query's contract)."""
    df = table(spark, sf_dir, "embeddings")
    return mine(df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES).withColumn("host_words", F.array_join("host_words", " "))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality_rules": op2_quality_rules,
    "op3_language": op3_language,
    "language_of_pages": language_of_pages,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_model": op5_quality_model,
    "op6_packing": op6_packing,
    "op7_licences": op7_licences,
    "op8_sentencepieces": op8_sentencepieces,
    "op9_neighbours": op9_neighbours,
    "op10_simhash": op10_simhash,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_source_audit": op12_source_audit,
    "op13_url_filter": op13_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_source_audit": SOURCE_AUDIT,
    "op2_quality_rules": QUALITY_RULES,
    "op7_licences": licences(TEMPLATES, THRESHOLD),
}
