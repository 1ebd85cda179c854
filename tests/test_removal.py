"""Removal in typed mode, held against handlers that return the marker in document mode; odd column names."""

import json

import pytest
from pyspark.sql import functions as F

from umbra.operators.document import DocumentMasker
from umbra.operators.rules import mask_text
from umbra.operators.typed import mask_frame
from umbra.plans.registry import ColumnStrategy, PyStrategy, register, unregister
from umbra.profiles import BLOCKED, REGEX, REMOVE, from_config


class Typed(ColumnStrategy):
    removes = True

    def predicate(self, value, key, kind, profile):
        said = F.coalesce(value == "drop", F.lit(False)) if kind.typeName() == "string" else F.lit(False)
        if isinstance(key, str):
            return True if key.startswith("rm") else (said if kind.typeName() == "string" else False)
        return key.startswith("rm") | said


class Document(PyStrategy):
    def should_handle(self, value, key, profile):
        return key.startswith("rm") or value == "drop"

    def handle(self, value, key, profile, context):
        context.redacted = True
        return REMOVE


@pytest.fixture
def profile():
    register("typed_rm", Typed())
    register("document_rm", Document())
    yield lambda name: from_config({"strategies": [name, BLOCKED, REGEX], "blocked_keys": ["pin"], "patterns": {"m": "/@/"}, "track_redacted_keys": True})
    unregister("typed_rm")
    unregister("document_rm")


SCHEMA = "id int, rm_col int, rm_box struct<a: int>, box struct<pin: int, rm_a: string, b: string>, m map<string, string>, l array<string>, deep array<struct<rm_x: int, y: string, z: map<string, int>>>, mm map<string, struct<rm_q: int, w: string>>"
ROWS = [
    (1, 5, (1,), (7, "x", "a@b"), {"rm_k": "v", "k": "drop", "j": "a@b"}, ["drop", "u", "a@b"], [(1, "drop", {"rm": 1, "n": 2}), (2, "t", {})], {"rm_e": (1, "x"), "e": (2, "drop")}),
    (2, None, None, None, None, None, None, None),
    (3, 6, (2,), (8, None, "plain"), {}, [], [], {}),
    (4, 6, (2,), (8, "drop", "drop"), {"a": None}, [None, "drop"], [None, (3, None, None)], {"f": None}),
]


def plain(value, want):
    """A list that lost items is keyed by what is left of them in document mode, and a field removed row by row is null in typed mode."""
    if isinstance(want, dict) and isinstance(value, list):
        return [plain(v, w) for v, w in zip(value, want.values())] if len(value) == len(want) else value
    if isinstance(value, dict) and isinstance(want, dict):
        return {k: plain(v, want.get(k)) for k, v in value.items() if k in want or v is not None}
    if isinstance(value, list) and isinstance(want, list):
        return [plain(v, w) for v, w in zip(value, want)]
    return value


def bare(want):
    if isinstance(want, dict):
        inner = {k: bare(v) for k, v in want.items()}
        return list(inner.values()) if inner and all(k.isdigit() for k in inner) else inner
    return [bare(v) for v in want] if isinstance(want, list) else want


def test_typed_removal_equals_document_mode(spark, profile):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = mask_frame(df, profile("typed_rm"))
    assert out.columns == ["id", "box", "m", "l", "deep", "mm", "_redacted", "_redacted_keys"]
    assert out.schema["box"].dataType.names == ["pin", "b"] and out.schema["deep"].dataType.elementType.names == ["y", "z"]
    masker = DocumentMasker(profile("document_rm"))
    rows = {r.id: r.asDict(True) for r in df.collect()}
    for r in out.collect():
        want = masker.mask(json.loads(json.dumps(rows[r.id])))
        have = r.asDict(True)
        marked, keys = have.pop("_redacted"), have.pop("_redacted_keys")
        assert marked == want.pop("_redacted", False)
        found = want.pop("_redacted_keys", [])
        assert [k for k in keys] == found
        for c in have:
            if r.id == 4 and c == "l":
                assert have[c] == [None]
                continue
            assert plain(have[c], want[c]) == bare(want[c]), (r.id, c)


def test_a_text_of_its_own(spark, profile):
    df = spark.createDataFrame([("drop",), ("keep",), (None,)], "t string")
    assert [r[0] for r in df.select(mask_text(F.col("t"), profile("typed_rm"))).collect()] == [REMOVE, "keep", None]


def test_odd_column_names(spark):
    p = from_config({"strategies": [BLOCKED], "blocked_keys": ["a`b", "pin"]})
    df = spark.createDataFrame([(1, 2, "x", True)], "`a``b` int, `c.d` int, pin string, _Redacted boolean")
    out = mask_frame(df, p)
    assert out.columns == ["a`b", "c.d", "pin", "_redacted"]
    assert tuple(out.first()) == ("[REDACTED]", 2, "[REDACTED]", True)
    with pytest.raises(ValueError, match="one name"):
        mask_frame(df.select("pin", "pin"), p)
