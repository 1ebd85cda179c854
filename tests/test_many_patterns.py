"""Many patterns over one text: the automaton's candidates give what trying every pattern gives."""

import random
import time
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from umbra.functions.dialect import parse
from umbra.functions.many import FEW, Searcher, required
from umbra.functions.sql import register
from umbra.operators.document import DocumentMasker, mask_text_document
from umbra.operators.typed import mask_frame
from umbra.profiles import PROFILES, REGEX, from_config

ODD = [
    "/foo|bar/", "/(?:foo|ba(?:r|z))+q/", "/a?b?c?/", "/x*/", "/(?i)Key[=:]/", "/key(?i:NAME)/", "/se(?=cr)cret/", "/(?<!a)bcd(?!e)/", "/\\bword\\b/i",
    "/(ab)\\1/", "/ab{2,3}c/", "/a{0,2}bc/", "/é+x/", "/é/i", "/É/iu", "/k/iu", "/é[^a]b/u", "/^tok\\d+$/m", "/[kK]ey/", "/a(?:|b)c/", "/ab+?cd/", "/(?:ab|cd)(?:ef|gh)/",
    "/./s", "/\\x00zero/", "/(?:abc)*def/", "/(?:ab){2}x/", "/q(?:uu|u)x/", "/\\d{4}-\\d\\d/", "{\\Qa.b\\E}", "/\\xe9/", "/a#b/x", "/one two/x",
]
PIECES = ["foo", "bar", "baz", "q", "a", "b", "c", "x", "KEY=", "key", "name", "NAME", "secret", "bcd", "word", " ", "abab", "abbc", "é", "É", "K", "tok12", "\n", "ef", "gh", "\0zero", "def", "ababx", "quux", "2024-01", "a.b", "onetwo"]


def odd():
    return tuple(p for t in ODD if (p := parse(t)) is not None)


@given(st.lists(st.sampled_from(PIECES), max_size=6).map(lambda s: "".join(s).encode()) | st.binary(max_size=12))
@settings(max_examples=300, deadline=None)
def test_answers_are_those_of_every_pattern(raw):
    for pattern in odd():
        assert Searcher((pattern,)).found_in(raw) == pattern.found_in(raw), pattern
        literals = required(pattern)
        assert not pattern.found_in(raw) or literals is None or any(t in raw.lower() for t in literals)
    together = odd()[:12]
    assert Searcher(together).found_in(raw) == any(p.found_in(raw) for p in together)


def test_literals():
    of = lambda t: required(parse(t))
    assert of("/foo|bar/") == {b"foo", b"bar"}
    assert of("/secretKEY[=:]/i") == {b"secretkey"}
    assert of("/ab+c/") == {b"ab"}
    assert of("/(?:foo|b*)/") is None
    assert of("/é/u") == {"é".encode()}
    assert of("/K/iu") is None


def wide(n):
    return {f"p{i}": f"/\\bacct{i}[=:]\\d+/i" if i % 2 else f"/tok{i}-(?:[a-z]+|\\d+)*!/" for i in range(n)}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    parts = ["acct3=9", "acct33:1", "ACCT1=5", "acct2=1", "tok4-ab!", "tok40-77!", "tok3-a!", "plain words", "é", "tok6-" + "ab1" * 4000 + "!", ""]
    return [None if i % 17 == 0 else " ".join(rng.choice(parts) for _ in range(rng.randrange(4))) for i in range(200)]


def test_typed_nested_sql_and_document_mode_agree(spark, texts):
    profile = from_config({"strategies": [REGEX], "patterns": wide(60), "mark_redacted": False})
    assert len(profile.patterns) > FEW
    hit = lambda t: t is not None and any(p.found_in(t.encode()) for _, p in profile.patterns)
    df = spark.createDataFrame([(i, t, [t, "plain"], {"k": t}, [(t,)]) for i, t in enumerate(texts)], "id int, t string, l array<string>, m map<string, string>, s array<struct<t: string>>")
    for r in mask_frame(df, profile, keep=("id",)).collect():
        want = "[REDACTED]" if hit(texts[r.id]) else texts[r.id]
        assert (r.t, list(r.l), dict(r.m), r.s[0].t) == (want, [want, "plain"], {"k": want}, want)
    masker = DocumentMasker(profile)
    assert mask_text_document('{"a": "acct3=9", "b": "acct2=9"}', masker) == '{"a":"[REDACTED]","b":"acct2=9"}'
    register(spark, profile)
    got = df.select("id", F.expr("mask_text(t)").alias("t")).collect()
    assert all(r.t == ("[REDACTED]" if hit(texts[r.id]) else texts[r.id]) for r in got)


def test_invalid_bytes_do_not_stop_a_job(spark):
    profile = from_config({"strategies": [REGEX], "patterns": wide(60), "mark_redacted": False})
    df = spark.range(3).select("id", F.concat(F.lit("acct1=5 "), F.unhex(F.lit("ff80")).cast("string")).alias("t"))
    assert {r.t for r in mask_frame(df, profile, keep=("id",)).collect()} == {"[REDACTED]"}


def test_work_hardly_grows_with_patterns():
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(rng.choices(letters, k=6)) for _ in range(200)).encode() for _ in range(400)]
    few, most = Searcher(tuple(p for t in PROFILES["file_scan"]["patterns"].values() if (p := parse(t)))), Searcher(tuple(map(parse, wide(500).values())))

    def seconds(s):
        start = time.process_time()
        for t in texts:
            s.found_in(t)
        return time.process_time() - start

    assert min(seconds(most) for _ in range(3)) <= 3 * min(seconds(few) for _ in range(3))


def test_invalid_patterns_are_left_out():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        profile = from_config({"strategies": [REGEX], "patterns": wide(40) | {"bad": "/(/"}})
    assert len(profile.patterns) == 40
