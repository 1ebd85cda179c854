"""Typed mode and document mode, also against each other and a plain model."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from umbra.operators.document import DocumentMasker, decode, encode, mask_json, mask_text_document
from umbra.operators.rules import with_masked
from umbra.operators.scanning import scan_contents, summary
from umbra.operators.typed import mask_frame
from umbra.plans.registry import ColumnStrategy, PyStrategy, load_custom, register, unregister
from umbra.profiles import ALL_RULES, PROFILES, REMOVE, from_config, load

EMAIL = PROFILES["default"]["patterns"]["email"]


def profile(**more):
    return from_config({"strategies": list(ALL_RULES), "safe_keys": ["id", "user_id"], "blocked_keys": ["password", "secret", "*token*"], "patterns": {"email": EMAIL}, "track_redacted_keys": True} | more)


def doc(value, p=None, compat=False):
    return json.loads(mask_text_document(json.dumps(value), DocumentMasker(p or profile()), compat))


def test_metadata_and_order():
    out = mask_text_document('{"b":1,"PassWord":2,"a":{"secret":[1],"x":{"password":null}},"id":"a@b.co"}', DocumentMasker(profile()))
    assert out == '{"b":1,"PassWord":"[REDACTED]","a":{"secret":"[REDACTED]","x":{"password":"[REDACTED]"}},"id":"a@b.co","_redacted":true,"_redacted_keys":["PassWord","secret","password"]}'
    assert doc({"m": "a@b.co"}) == {"m": "[REDACTED]", "_redacted": True}
    assert doc({"password": 1}, profile(mark_redacted=False)) == {"password": "[REDACTED]"}
    assert doc({"password": 1, "_redacted": 5}, profile(track_redacted_keys=False)) == {"password": "[REDACTED]", "_redacted": True}
    assert doc({"a": 1}) == {"a": 1} and doc({"password": 1}, profile(enabled=False)) == {"password": 1}


def test_safe_keys_protect_scalars_only():
    assert doc({"id": {"password": 1, "m": "a@b.co"}})["id"] == {"password": "[REDACTED]", "m": "[REDACTED]"}
    assert doc({"id": [1] * 5}, profile(max_object_size=3))["id"] == {"_large_object_redacted": "[REDACTED] (Array with 5 items)"}


def test_roots():
    p = profile()
    assert doc("a@b.co") == "[REDACTED]" and doc(5) == 5 and doc(None) is None and doc([1, 2]) == [1, 2]
    assert doc([1, "a@b.co"]) == {"0": 1, "1": "[REDACTED]", "_redacted": True}
    assert doc({"a": [1, "a@b.co"]}) == {"a": [1, "[REDACTED]"], "_redacted": True}
    assert doc({"x": 1}, profile(blocked_keys=["*"])) == {"_redacted_array": "[REDACTED]", "_redacted": True, "_redacted_keys": [""]}
    assert doc(list(range(200)), p) == {"_large_object_redacted": "[REDACTED] (Array with 200 items)", "_redacted": True}
    assert doc({"a": REMOVE, "b": 1}) == {"b": 1}  # dropped without a mark


def test_policies():
    for policy, want in (("preserve", "{bad"), ("remove", REMOVE), ("redact", "[REDACTED] (Non-redactable object string)"), ("empty_array", '{"_redacted":true}'), ("other", "{bad")):
        assert mask_text_document("{bad", DocumentMasker(profile(non_redactable_object_behavior=policy))) == want
    assert mask_text_document("[NaN]", DocumentMasker(profile())) == "[NaN]"
    deep = "[" * 600 + "]" * 600
    assert mask_text_document(deep, DocumentMasker(profile(non_redactable_object_behavior="remove"))) == REMOVE
    assert mask_text_document("[" * 100_000, DocumentMasker(profile(non_redactable_object_behavior="remove"))) == REMOVE


def test_spelling():
    assert encode({"a": "é/", "b": 10.0, "c": {}, "d": {"0": 1, "1": 2}}) == '{"a":"é/","b":10.0,"c":{},"d":{"0":1,"1":2}}'
    assert encode({"a": "é/", "b": 10.0, "c": {}, "d": {"0": 1, "1": 2}}, True) == '{"a":"\\u00e9\\/","b":10,"c":[],"d":[1,2]}'
    assert encode({"a": "/"}, True, slashes=True) == '{"a":"/"}' and decode('{"a":1,"a":2}') == {"a": 2}


class Shout(PyStrategy):
    def should_handle(self, value, key, profile):
        return key == "loud" or (isinstance(value, list) and len(value) > 2)

    def handle(self, value, key, profile, context):
        context.redacted = True
        return REMOVE if key == "loud" else "[LIST]"


class Upper(ColumnStrategy):
    def predicate(self, value, key, kind, profile):
        return key == "loud"

    def replace(self, value, key, kind, profile):
        return F.upper(value)


def test_custom_strategies(spark):
    register("shout", Shout())
    p = from_config({"strategies": ["shout", "nothing"]})
    assert doc({"loud": 1, "a": 2}, p) == {"a": 2, "_redacted": True}
    assert doc([1, 2, 3, 4], p) == {"_redacted_array": "[LIST]", "_redacted": True}
    assert doc({"x": [1, 2, 3]}, p) == {"x": "[LIST]", "_redacted": True}
    unregister("shout")
    register("upper", Upper())
    row = mask_frame(spark.createDataFrame([("a", "b")], "loud string, x string"), from_config({"strategies": ["upper"]})).first()
    assert row.loud == "A" and row.x == "b" and row._redacted
    unregister("upper")
    load_custom({"ok": "tests.test_masking.Shout", "no": "tests.test_masking.nothing", 3: "x.y", "bad": "nowhere.Thing", "str": "builtins.str", "plain": "x"})
    assert doc({"loud": 1}, from_config({"strategies": ["ok", "no", "bad", "str"]})) == {"_redacted": True}
    unregister("ok")


def test_typed_nesting(spark):
    df = spark.sql(
        """select 1 id, 5 password, named_struct('id', 'a@b.co', 'password', named_struct('x', 1), 'm', 'a@b.co') s, array('a@b.co', null, 'ok') arr,
        map('id', 'a@b.co', 'My_Token', 'y', 'n', 'plain') m, array(1, 2, 3, 4) big, map('a', array(named_struct('password', 1, 'q', 'a@b.co'))) deep,
        cast(null as string) none, cast(null as struct<password:int>) gone, map('my_token', 7, 'n', 8) ints, array(array('a@b.co')) two"""
    )
    out = mask_frame(df, profile(max_object_size=3)).first().asDict(True)
    assert out == {
        "id": 1,
        "password": "[REDACTED]",
        "s": {"id": "a@b.co", "password": "[REDACTED]", "m": "[REDACTED]"},
        "arr": ["[REDACTED]", None, "ok"],
        "m": {"id": "a@b.co", "My_Token": "[REDACTED]", "n": "plain"},
        "big": None,
        "deep": {"a": [{"password": "[REDACTED]", "q": "[REDACTED]"}]},
        "none": None,
        "gone": None,
        "ints": {"my_token": None, "n": 8},
        "two": [["[REDACTED]"]],
        "_redacted": True,
        "_redacted_keys": ["password", "My_Token", "my_token"],
        "_redaction_notes": {"big": "[REDACTED] (Array with 4 items)"},
    }


def test_typed_sizes_and_marks(spark):
    df = spark.sql("select named_struct('a', 1, 'b', 2, 'c', 3) s, named_struct('x', array(1, 2, 3), 'y', 'z') t")
    out = mask_frame(df, profile(max_object_size=2)).first().asDict(True)
    assert out["s"] is None and out["t"] == {"x": None, "y": "z"} and out["_redacted_keys"] == []
    assert out["_redaction_notes"] == {"s": "[REDACTED] (Object struct with 3 properties)", "t.x": "[REDACTED] (Array with 3 items)"}
    plain = mask_frame(df, profile(mark_redacted=False))
    assert plain.columns == ["s", "t", "_redaction_notes"]
    assert mask_frame(df, profile(enabled=False)).columns == df.columns
    all_gone = mask_frame(df, profile(blocked_keys=["*"])).first()
    assert all_gone.s is None and all_gone._redaction_notes == {"": "[REDACTED]"} and all_gone._redacted
    rows = mask_frame(spark.createDataFrame([("x", 1), ("a@b.co", 2)], "t string, n int"), load("default")).orderBy("n").collect()
    assert [(r.t, r._redacted) for r in rows] == [("x", False), ("[REDACTED]", True)]


def test_masks_are_pruned_and_narrow(spark):
    df = spark.createDataFrame([("a@b.co", "x", 1)], "a string, b string, n int")
    plan = mask_frame(df, load("performance")).select("b").groupBy().count()._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan
    whole = mask_frame(df, load("performance"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in whole and "Python" not in whole


def test_masking_a_masked_table(spark):
    df = spark.sql("select array(1, 2, 3, 4) a, 'x' _redaction_notes, 5 _redacted, array('k') _redacted_keys, 'a@b.co' t")
    p = profile(max_object_size=3, track_redacted_keys=False)
    once = mask_frame(df, p)
    assert once.columns == ["a", "_redacted_keys", "t", "_redacted", "_redaction_notes"]
    again = mask_frame(once, p)
    assert sorted(again.columns) == sorted(once.columns) and again.first()._redacted_keys == ["k"]
    assert mask_frame(once, profile()).columns.count("_redacted_keys") == 1


def test_each_pattern_stands_in_a_plan_once(spark):
    p = load("file_scan")
    df = spark.createDataFrame([("a@b.co", 1)], "t string, n int")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(with_masked(df, F.col("t"), p, "m", "f")).count("RLIKE") == 13 + 14
    assert plan(mask_frame(df, p)).count("RLIKE") == 13 + 14
    assert plan(summary(scan_contents(df.select(F.col("t").alias("path"), F.col("t").alias("content")), p))).count("RLIKE") == 13 + 14
    nested = mask_frame(spark.sql("select array(named_struct('m', map('k', array('a@b.co')))) a"), from_config({"strategies": ["regex_patterns"], "patterns": {"e": EMAIL}}))
    assert plan(nested).count("RLIKE") == 1 and nested.first().asDict(True) == {"a": [{"m": {"k": ["[REDACTED]"]}}], "_redacted": True}


KEYS = st.sampled_from(["id", "user_id", "password", "my_token", "note", "A"])
TEXTS = st.sampled_from(["", "x", "a@b.co", "long " * 12, "a1b2c3d4a1b2c3d4", "é" * 20])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS, TEXTS, st.dictionaries(KEYS, TEXTS, max_size=5)), min_size=1, max_size=6))
def test_typed_and_document_mode_agree(spark, rows):
    p = profile(max_value_length=50, max_object_size=4, redact_large_objects=False, shannon_entropy={"enabled": True, "threshold": 3.0, "min_length": 10})
    df = spark.createDataFrame([(i, a, (b, c), m) for i, (a, b, c, m) in enumerate(rows)], "id int, note string, s struct<password:string,text:string>, m map<string,string>")
    typed = mask_frame(df, p).orderBy("id").collect()
    texts = df.select("id", mask_json(F.to_json(F.struct("id", "note", "s", "m")), p).alias("d")).orderBy("id").collect()
    for t, d in zip(typed, texts):
        want = json.loads(d.d)
        got = t.asDict(True)
        keys, flag = want.pop("_redacted_keys", []), want.pop("_redacted", False)
        assert {k: got[k] for k in want} == want and got["_redacted"] is flag and sorted(got["_redacted_keys"]) == sorted(keys)
