"""No input stops a job: bytes that are no text, half surrogate pairs, numbers beyond doubles, odd names."""

import json
import random

import pytest
from pyspark.sql import functions as F

from umbra.functions.entropy import byte_entropy, entropy_of
from umbra.functions.sql import register
from umbra.operators.document import Context, DocumentMasker, mask_json, mask_raw_document
from umbra.operators.rules import mask_text
from umbra.operators.typed import mask_frame
from umbra.profiles import PROFILES, REMOVE, from_config, load
from umbra.streaming.logs import log_lines

BAD = [b"\xff\xfe plain", b"mail a@b.cd \xff", b"\xc3\x28" * 40, bytes(range(256)), b'{"a":"\xff"}', b'{"a":"\\ud800"}', b'{"a":"\\ud83d\\ude00"}', b'{"a":1e999}', b'{"a":-1e999,"password":"x"}', b"[" * 2000, b"\xed\xa0\x80", b"", b"\x00"]


def rows(spark, extra=()):
    cells = [*BAD, *extra]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(cells)], "i int, b binary")
    return cells, df.select("i", F.col("b").cast("string").alias("t"))


def masker_of_texts(masker, text):
    """A text without a key of its own, as document mode masks it."""
    return json.dumps({"v": masker._apply(text, "", Context())[1]})


@pytest.mark.parametrize("name", list(PROFILES))
def test_no_bytes_stop_a_job(spark, name):
    rng = random.Random(7)
    fuzz = [bytes(rng.randrange(256) for _ in range(rng.randrange(80))) for _ in range(60)]
    fuzz += [json.dumps({"k": rng.choice(["\ud800", "x", 1e300]), "n": [1, {"a": "\udfff"}]}).replace("1e+300", "1e999").encode() for _ in range(20)]
    cells, df = rows(spark, fuzz)
    p = load(name, PROFILES)
    out = {r.i: r for r in df.select("i", mask_text(F.col("t"), p).cast("binary").alias("m"), mask_json(F.col("t"), p).cast("binary").alias("d"), byte_entropy(F.col("t")).alias("h")).collect()}
    masker = DocumentMasker(p)
    for i, b in enumerate(cells):
        assert bytes(out[i].d) == mask_raw_document(b, masker)
        assert out[i].h == entropy_of(b)
        if b.isascii():
            text = json.loads(masker_of_texts(masker, b.decode()))["v"]
            assert bytes(out[i].m).decode() == text
    typed = mask_frame(df.withColumn("list", F.array("t")).withColumn("m", F.create_map(F.lit("x"), F.col("t"))), p)
    assert typed.count() == len(cells) and len(typed.collect()) == len(cells)
    logs = df.select(F.lit("2024-01-01").cast("timestamp").alias("datetime"), F.lit("a").alias("channel"), F.lit("I").alias("level"), F.col("t").alias("message"), F.col("t").alias("context"))
    assert logs.transform(lambda d: log_lines(d, p)).select(F.octet_length("line")).agg(F.count("*")).first()[0] == len(cells)
    register(spark, p)
    df.createOrReplaceTempView("any_bytes")
    assert len(spark.sql("select octet_length(mask_text(t)), octet_length(mask_json(t)), byte_entropy(t), is_common_pattern(t) from any_bytes").collect()) == len(cells)


def test_bytes_are_masked_as_bytes(spark):
    """A pattern over bytes finds them in text that is none; a value no rule takes stays as it was."""
    cells, df = rows(spark)
    p = from_config({"strategies": list(PROFILES["default"]["strategies"]), "patterns": {"pair": r"/\xff\xfe/", "mail": "/@/"}})
    out = {r.i: bytes(r.m) for r in df.select("i", mask_text(F.col("t"), p).cast("binary").alias("m")).collect()}
    for i, b in enumerate(cells):
        assert out[i] == (b"[REDACTED]" if b"\xff\xfe" in b or b"@" in b else b)


@pytest.mark.parametrize("policy,want", [("preserve", None), ("remove", REMOVE.encode()), ("redact", b"[REDACTED] (Non-redactable object string)"), ("empty_array", b'{"_redacted":true}')])
def test_what_is_no_document_meets_the_policy(spark, policy, want):
    cells, df = rows(spark)
    p = from_config({**PROFILES["default"], "non_redactable_object_behavior": policy})
    out = {r.i: bytes(r.m) for r in df.select("i", mask_json(F.col("t"), p).cast("binary").alias("m")).collect()}
    for i, b in enumerate(cells):
        good = b == b'{"a":"\\ud83d\\ude00"}'
        assert out[i] == ('{"a":"\U0001f600"}'.encode() if good else b if want is None else want)
