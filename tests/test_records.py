"""Documents of known shapes: the engine gives what document mode gives, row by row."""

import json
import random

import pytest
from pyspark.sql import functions as F

from umbra.operators import records
from umbra.operators.document import mask_json
from umbra.operators.records import Unfit, mask_documents, observed, shape_of, shape_of_type
from umbra.plans.registry import PyStrategy, register, unregister
from umbra.profiles import PROFILES, REMOVE, from_config, load
from umbra.streaming.logs import log_lines

def both(df, profile, **kw):
    """(by shape, in document mode) for every row."""
    out = mask_documents(df, "doc", profile, "new", **kw).withColumn("old", mask_json(F.col("doc"), profile, kw.get("compat", False)))
    return [(r.doc, r.new, r.old) for r in out.collect()]


def texts():
    rng, out = random.Random(3), []
    words = ["a@b.cd", "plain", "token 123-45-6789", "x" * 1200, "é ü", 'quote " and \\ and /', "tab\tline\n", "ctrl\x01", "", "555-123-4567", "aB3$xY9!kL2@mN5#pQ8^wZ1&rT4*", "a, b: c", REMOVE]
    for i in range(300):
        s = lambda: rng.choice(words)
        doc = {"id": i, "password": s(), "note": s(), "n": rng.choice([1.5, 0.1, 2.0, 1e20, 12345.125, -0.0, 1]), "in": {"api_key": s(), "t": s(), "on": rng.random() < 0.5}, "list": [s(), s()], "nil": None}
        if i % 7 == 0:
            doc["list"].append("z")
        if i % 11 == 0:
            doc = dict(reversed(doc.items()))
        if i % 13 == 0:
            doc.pop("note")
        if i % 17 == 0:
            doc["in"] = None
        if i % 19 == 0:
            doc["id"] = "seven"
        out.append(json.dumps(doc, ensure_ascii=rng.random() < 0.3, separators=rng.choice([(",", ":"), (", ", ": ")])))
    odd = ["", "[]", "{}", "7", '"text"', "null", "{", '{"a":', '{"id":1,"id":2}', "[1,2", None, '{"a":NaN}', '{"id": 007}', '{ "id" : 1 }', '{"0":1,"1":"a@b.cd"}', '{"_redacted":1}', "[" * 600 + "]" * 600]
    return out + odd


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("name", ["default", "strict", "performance", "own"])
def test_equals_document_mode(spark, name, compat):
    own = {**PROFILES["strict"], "blocked_keys": ["0", "api_*", "id"], "safe_keys": ["t"], "max_object_size": 6}
    profile = from_config(own, "own") if name == "own" else load(name, PROFILES)
    df = spark.createDataFrame([(t,) for t in texts()], "doc string").repartition(3)
    shapes = observed(df, "doc")
    assert len(shapes) == 2
    for doc, new, old in both(df, profile, compat=compat):
        assert new == old, doc
    for doc, new, old in both(df, profile, compat=compat, shapes=[shape_of(json.loads(t)) for t in texts()[1:4]]):
        assert new == old, doc


def test_rows_of_a_shape_never_reach_python(spark, monkeypatch):
    monkeypatch.setattr(records, "mask_json", lambda value, *_: F.when(value.isNotNull(), F.lit("PYTHON")))
    docs = [json.dumps({"id": i, "password": "p", "said": {"text": f"mail, a{i}@b.cd: \"q\" é"}, "list": [1.5, 2.25]}, ensure_ascii=False, separators=s) for i in range(50) for s in ((",", ":"), (", ", ": "))]
    df = spark.createDataFrame([(t,) for t in docs] + [("{",)], "doc string")
    out = [r.doc for r in mask_documents(df, "doc", load("default", PROFILES)).collect()]
    assert out.count("PYTHON") == 1 and out.count('{"id":7,"password":"[REDACTED]","said":{"text":"[REDACTED]"},"list":[1.5,2.25],"_redacted":true}') == 2


def test_whole_documents_and_custom_rules_stay_in_document_mode(spark):
    class Shout(PyStrategy):
        def should_handle(self, value, key, profile):
            return value == "hush"

        def handle(self, value, key, profile, context):
            return "HUSH"

    register("shout", Shout())
    try:
        p = from_config({"strategies": ["shout"]})
        df = spark.createDataFrame([('{"a":"hush"}',)], "doc string")
        assert both(df, p)[0][1] == '{"a":"HUSH"}'
    finally:
        unregister("shout")
    everything = from_config({**PROFILES["default"], "blocked_keys": ["*"]})
    df = spark.createDataFrame([('{"a":"x","b":1}',), ('{"a":"y","b":2}',)], "doc string")
    assert all(new == old for _, new, old in both(df, everything))
    off = from_config({**PROFILES["default"], "enabled": False})
    assert all(new == old for _, new, old in both(df, off))


def test_shapes():
    assert shape_of({"a": [{"b": 1}, {"b": 2}]}).size == 6
    for bad in ({}, {"a": 1, "A": 2}, {"a": [1, "x"]}, {"_redacted": 1}):
        with pytest.raises(Unfit):
            shape_of(bad)


def test_struct_contexts_of_logs(spark):
    """A context that is a struct gives the line that its JSON gives."""
    rows = [
        (1, "t", 1.5, ("a@b.cd", "deep")), (2, None, None, None), (3, "é", 2.0, ("x/y", "z")), (4, "ctrl\x02", 1e30, ("\"q\"", None)), (5, REMOVE, 0.25, ("tab\t", "n\n")),
    ]
    schema = "user_id int, api_token string, score double, who struct<mail: string, key: string>"
    df = spark.createDataFrame([(r,) for r in rows] + [(None,)], f"context struct<{schema}>")
    df = df.select(F.lit("2024-01-01 00:00:00").cast("timestamp").alias("datetime"), F.lit("app").alias("channel"), F.lit("INFO").alias("level"), F.lit("m").alias("message"), "context")
    for name in ("default", "strict", "performance"):
        p = load(name, PROFILES)
        typed = [r.line for r in log_lines(df, p).collect()]
        text = [r.line for r in log_lines(df.withColumn("context", F.to_json("context", {"ignoreNullFields": "false"})), p).collect()]
        assert typed == text
    assert shape_of_type(df.schema["context"].dataType).size == 7
