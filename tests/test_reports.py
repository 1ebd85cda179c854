"""Counts that come with the job that writes the masked table; VARIANT columns."""

import json

from pyspark.sql import Observation
from pyspark.sql import functions as F

from umbra.operators.document import Context, DocumentMasker
from umbra.operators.records import mask_documents, shape_of
from umbra.operators.reports import report
from umbra.operators.typed import INSIDE, mask_frame
from umbra.profiles import ALL_RULES, BLOCKED, LARGE_OBJECT, LARGE_STRING, REGEX, from_config

P = from_config({"strategies": list(ALL_RULES), "blocked_keys": ["pin"], "patterns": {"m": "/@/"}, "max_value_length": 20, "max_object_size": 3, "track_redacted_keys": True, "non_redactable_object_behavior": "redact"})


def found(spark, observation):
    return {(r.path, r.rule): r.rows for r in report(spark, observation).collect()}


def test_counts_come_with_the_write(spark, tmp_path):
    rows = [(i, "p", "a@b" if i % 3 == 0 else "x" * (30 if i % 5 == 0 else 3), ["y@z"] * (i % 6), ("a@b" if i % 7 == 0 else None,)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, pin string, t string, l array<string>, s struct<u: string>")
    seen = Observation("typed")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("masked", "one write")
    mask_frame(df, P, observation=seen).write.parquet(str(tmp_path / "out"))
    assert len(tracker.getJobIdsForGroup("masked")) == 1
    assert found(spark, seen) == {
        (None, "rows"): 100,
        ("pin", BLOCKED): 100,
        ("t", REGEX): 34,
        ("t", LARGE_STRING): sum(i % 5 == 0 and i % 3 != 0 for i in range(100)),
        ("l", INSIDE): sum(1 <= i % 6 <= 3 for i in range(100)),
        ("l", LARGE_OBJECT): sum(i % 6 > 3 for i in range(100)),
        ("s.u", REGEX): 15,
        ("s.u", LARGE_STRING): 0,
    }


def test_undecodable_documents_are_counted(spark):
    docs = ['{"pin":1}', '{"pin":2}', "{", "[1", None, '{"a":1e999}', '{"x":"\\ud800"}', "7"]
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    for shapes in (None, [shape_of({"pin": 1})], []):
        seen = Observation()
        out = mask_documents(df, "doc", P, observation=seen, shapes=shapes)
        plain = [r.doc for r in mask_documents(df, "doc", P).collect()]
        assert [r.doc for r in out.collect()] == plain
        assert found(spark, seen) == {(None, "rows"): 8, ("doc", "undecodable: redact"): 4}


def test_variant_columns(spark):
    docs = ['{"pin":7,"a":{"t":"a@b","n":[1,{"pin":null}]}}', '{"a":"x"}', '"a@b"', "[1,2,3,4]", "5", "null", None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").select("i", F.parse_json("d").alias("v"), F.struct(F.parse_json("d").alias("w")).alias("s"), F.parse_json("d").alias("pin"))
    out = mask_frame(df, P)
    assert out.schema["v"].dataType.typeName() == "variant" and out.schema["pin"].dataType.typeName() == "string"
    masker = DocumentMasker(P)
    for r in out.select("i", F.to_json("v").alias("v"), F.to_json("s.w").alias("w"), "pin", "_redacted", "_redacted_keys").collect():
        assert r.pin == "[REDACTED]" and r["_redacted"] and set(r["_redacted_keys"]) == {"pin"}
        for name in ("v", "w"):
            want = None if docs[r.i] is None else masker.entry(json.loads(docs[r.i]), name, Context())
            assert (None if r[name] is None else json.loads(r[name])) == want
