"""Strings inside arrays and maps: entropy and deep patterns over Arrow's child buffers."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from umbra.operators.document import DocumentMasker, mask_text_document
from umbra.operators.nested import deep_patterns, told
from umbra.operators.typed import mask_frame
from umbra.profiles import ALL_RULES, PROFILES, from_config, load

DEEP = {"strategies": list(ALL_RULES), "patterns": {"deep": "/x(?:a|bc)*y/", "mail": "/@/"}, "shannon_entropy": {"enabled": True, "threshold": 4.5, "min_length": 20, "exclusion_patterns": ["/^(?:ab|a)*!$/"]}, "track_redacted_keys": True}


def value(rng):
    return rng.choice(
        [None, "", "plain", "a@b.cd", "x" + "abc" * 3000 + "y", "x" + "abc" * 3000 + "z", "ab" * 4000 + "!", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFG") for _ in range(60)), "é" * 30, "tail\n"]
    )


SCHEMA = "id int, list array<string>, map map<string, string>, deep array<struct<n: int, s: string, in: struct<t: string>, l: array<string>>>, mm map<string, array<string>>"


def rows(n):
    rng, out = random.Random(9), []
    for i in range(n):
        some = lambda k: [value(rng) for _ in range(rng.randrange(k))]
        deep = [None if rng.random() < 0.1 else (rng.randrange(9), value(rng), None if rng.random() < 0.2 else (value(rng),), some(3)) for _ in range(rng.randrange(3))]
        out.append((i, None if i % 9 == 0 else some(4), {f"k{j}": v for j, v in enumerate(some(4))}, deep, {"a": some(3), "b": None}))
    return out


@pytest.mark.parametrize("name", ["deep", "default", "strict", "file_scan"])
def test_typed_mode_equals_document_mode(spark, name):
    p = from_config(DEEP) if name == "deep" else load(name, PROFILES)
    assert bool(deep_patterns(p)) == (name == "deep")
    df = spark.createDataFrame(rows(60), SCHEMA).repartition(3)
    out = mask_frame(df.withColumn("_was", F.struct(*df.columns)), p, keep=("id", "_was"))
    masker = DocumentMasker(p)
    for r in out.collect():
        for c in ("list", "map", "deep", "mm"):
            old = r["_was"].asDict(True)[c]
            if old is None:
                assert r[c] is None
                continue
            want = masker._walk(old, c, type("C", (), {"redacted": False, "keys": [], "note_key": lambda self, k: None})())
            assert r.asDict(True)[c] == want, (c, old)


def test_slices_and_nulls_of_batches(spark):
    """Batches that start inside a child buffer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        test_typed_mode_equals_document_mode(spark, "deep")
    finally:
        spark.conf.set(key, before)


def test_linear_in_the_bytes(spark):
    """Arrays of strings of 100 kB, of many different bytes, and four times as many."""
    p, took = load("default", PROFILES), []
    p = from_config({**PROFILES["default"], "max_value_length": None})
    text = "".join(chr(33 + i * 7 % 90) for i in range(100_000))
    for n in (20, 80):
        df = spark.range(n).select(F.array(*(F.concat(F.lit(text), F.col("id").cast("string"), F.lit(str(k))) for k in range(5))).alias("list"))
        start = time.time()
        assert mask_frame(df, p).where("_redacted").count() == n
        took.append(time.time() - start)
    assert took[1] < 6 * took[0] + 2


def test_nothing_to_say(spark):
    df = spark.createDataFrame([([1], ["a"])], "n array<int>, s array<string>")
    assert told(F.col("n"), df.schema["n"].dataType, load("default", PROFILES)) is None
    assert told(F.col("s"), df.schema["s"].dataType, load("performance", PROFILES)) is None
    assert json.loads(mask_text_document('["a"]', DocumentMasker(load("default", PROFILES)))) == ["a"]
