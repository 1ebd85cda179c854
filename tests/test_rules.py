"""The semantics of keys, patterns, lengths and entropy, value by value."""

import math

import pytest
from pyspark.sql import functions as F

from umbra.functions.dialect import Unsupported, parse, search
from umbra.functions.entropy import byte_entropy, byte_entropy_native, entropy_of
from umbra.operators.keys import blocked_column, is_blocked, is_safe
from umbra.operators.rules import mask_text
from umbra.profiles import PROFILES, Profile, available_profiles, from_config, load, profile_exists, scan_settings


def test_profiles_are_complete():
    sizes = {n: (len(p.strategies), len(p.safe_keys), len(p.blocked_keys), len(p.patterns), p.max_value_length, p.max_object_size, len(p.entropy.exclusions)) for n in PROFILES for p in [load(n)]}
    assert sizes == {
        "default": (6, 36, 24, 5, 5000, 100, 10),
        "strict": (6, 8, 31, 8, 1000, 25, 2),
        "file_scan": (2, 0, 0, 13, None, 100, 14),
        "performance": (3, 36, 7, 2, None, 100, 0),
    }
    assert available_profiles() == list(PROFILES) and profile_exists("strict") and not profile_exists("x")


def test_missing_and_invalid_profiles():
    with pytest.raises(ValueError, match="Redaction profile 'x' not found in configuration."):
        load("x")
    with pytest.raises(ValueError, match="Invalid configuration for profile 'y'."):
        load("y", {"y": 3})


def test_coercion():
    p = from_config({"enabled": "no", "replacement": 5, "safe_keys": ["ID", 7, "X"], "blocked_keys": "all", "patterns": {"a": "/x/", "b": 3, "c": "/(/", "d": "x"}, "max_object_size": "50", "max_value_length": "12"})
    assert p.enabled and p.replacement == "[REDACTED]" and p.safe_keys == ("id", "x") and p.blocked_keys == () and [n for n, _ in p.patterns] == ["a"]
    assert p.max_object_size == 100 and p.max_value_length == 12
    assert [from_config({"max_value_length": v}).max_value_length for v in (0, -1, None, "x", True, 3.9, [])] == [None] * 5 + [3, None]
    assert from_config({"max_object_size": None}).max_object_size == 100 and from_config({}).entropy.enabled is False


def test_environment():
    env = {"UMBRA_REPLACEMENT": "***", "UMBRA_ENABLED": "false", "UMBRA_SHANNON_THRESHOLD": "3.5", "UMBRA_MAX_VALUE_LENGTH": "7", "UMBRA_MAX_OBJECT_SIZE": "9", "UMBRA_TRACK_KEYS": "true"}
    p = load("default", env=env)
    assert (p.replacement, p.enabled, p.entropy.threshold, p.max_value_length, p.max_object_size, p.track_redacted_keys) == ("***", False, 3.5, 7, 100, True)
    assert load(None, env={"UMBRA_DEFAULT_PROFILE": "strict"}).name == "strict"
    assert scan_settings({"UMBRA_SCAN_PROFILE": "default", "UMBRA_SCAN_MAX_FILE_SIZE": "10"}) == {"profile": "default", "max_file_size": 10, "exclude_patterns": ["*.lock", "*.min.js", "vendor/*", "node_modules/*"]}


WILD = ["*token*", "user_*_token", "*_key_*", "a.b*", "exact", ""]


@pytest.mark.parametrize(
    "key,blocked",
    [("token", True), ("MY_TOKEN_X", True), ("user_token", True), ("user_a_", False), ("key_data", False), ("a_key_b", True), ("A.Bc", True), ("axbc", False), ("EXACT", True), ("exactly", False), ("", True), ("x", False)],
)
def test_blocked_keys(spark, key, blocked):
    p = from_config({"blocked_keys": WILD})
    assert is_blocked(key, p) is blocked
    assert spark.range(1).select(blocked_column(F.lit(key), p)).first()[0] is blocked


def test_safe_keys_are_exact():
    p = from_config({"safe_keys": ["id", "*name*"]})
    assert is_safe("ID", p) and not is_safe("user_name", p) and is_safe("*NAME*", p)
    assert not is_safe("İD", p)  # ASCII case only


@pytest.mark.parametrize("text,bits", [("", 0.0), ("a", 0.0), ("aa", 0.0), ("aaaa", 0.0), ("ab", 1.0), ("abcd", 2.0), ("αβγδ", 2.0), ("a1b2c3d4" * 8, 3.0)])
def test_entropy(spark, text, bits):
    row = spark.createDataFrame([(text,)], "t string").select(byte_entropy(F.col("t")), byte_entropy_native(F.col("t"))).first()
    assert entropy_of(text.encode()) == bits == row[0] == row[1]


def test_entropy_of_a_key():
    assert math.isclose(entropy_of(b"sk-1234567890abcdef1234567890abcdef12345678"), 4.169541, abs_tol=1e-6)


SUBJECTS = ["é555-123-4567", "x\n", "x", "x\r", "x\ny", "a.b", "ab]c", "[[x", "a&&b", "SELECT  1", "ÀB", "a b c", "a  b cc\n", "tok_9", "日本 a@b.co", "a\x0bb", "a "]


@pytest.mark.parametrize(
    "pattern",
    [r"/\b\d{3}-\d{3}-\d{4}\b/", "/^x$/", "/^x.$/s", "/^x$/D", "/x$/m", "#a.b#", "/[]b]/", "/[[x]+/", "/[a&&b]{3}/", "/^select\\s+/i", r"/^[A-Za-z]+(\s+[A-Za-z]+)*$/", r"/(?:a|b)+ /", "/\\Bk/", "/[[:digit:]]/", "{tok_\\d}", r"/a\sb/", "/a.$/", PROFILES["default"]["patterns"]["email"]],
)
def test_both_engines_agree(spark, pattern):
    p = parse(pattern)
    want = [p.found_in(s.encode()) for s in SUBJECTS]
    rows = spark.createDataFrame(list(enumerate(SUBJECTS)), "i int, s string").select("i", search(F.col("s"), p).alias("m")).orderBy("i").collect()
    assert [r.m for r in rows] == want


ODD = ["2024 b", "aB", "ab", "a.b", "foo", "xx", "éé", "é", "\u20ac", "a\r\nb", "AbC abC", "jj", "日本", "", "a1", "\u0436", "x\ny\n"]


@pytest.mark.parametrize(
    "pattern",
    [r"/(?<y>\d{4})/", r"/(?P<y>\d{4})/", r"/\p{L}+/", r"/\p{L}+/u", r"/\p{Lu}b/u", r"/a(?i)b/", r"/(x(?i)A|b)c/", r"/\x{20AC}/u", r"/\R/", r"/\Qa.b\E/", r"/^.{4}$/", r"/^.{2}$/u", r"/(?P<a>x)(?P=a)/", r"/(j)\g{-1}/", r"/(?<q>j)\k<q>/",
     r"/(?x) a [.] b # quoted/", r"/[[:^ascii:]]{4}/", "/é{2}/", "/[é]$/", r"/\Hb/", r"/^y$/m", r"/\N$/", r"/(?>a+)b/", r"/\ba\B/", r"/\W{3}/"],
)
def test_user_patterns_mean_the_same_to_both_engines(spark, pattern):
    p = parse(pattern)
    want = [p.found_in(s.encode()) for s in ODD]
    df = spark.createDataFrame(list(enumerate(ODD)), "i int, s string")
    assert [r.m for r in df.select("i", search(F.col("s"), p).alias("m")).orderBy("i").collect()] == want
    raw = df.select("i", search(F.decode(F.encode("s", "UTF-8"), "ISO-8859-1"), p, "ISO-8859-1").alias("m"))  # a file's bytes
    assert p.unicode or [r.m for r in raw.orderBy("i").collect()] == want


def test_bytes_count():
    found = lambda pattern, text: parse(pattern).found_in(text.encode())
    assert found("/^.{4}$/", "éé") and not found("/^.{2}$/", "éé") and found("/^.{2}$/u", "éé")
    assert found(r"/\bx\b/", "éx") and not found(r"/\bx\b/u", "éx")


@pytest.mark.parametrize("pattern", [r"/foo\Kbar/", r"/(a)(?(1)b|c)/", r"/(?R)/", "/(*ACCEPT)/", r"/\X/", r"/(?<=a|bc)d/", r"/\p{Greek}/"])
def test_what_cannot_be_expressed_is_refused_by_name(pattern):
    with pytest.raises(Unsupported, match="pattern"):
        from_config({"patterns": {"p": pattern}})


def test_invalid_patterns_are_named():
    with pytest.warns(UserWarning, match="not valid and never matches"):
        assert from_config({"patterns": {"p": "/(/"}}).patterns == ()


def test_literals_that_matches_need():
    assert [parse(p).needs for p in ("/ab+c/", "/a?bc/", "/(x)yz|q/", "/AB/i", r"{\d+://x}", "/(?:key|token)=/", r"/a(?!bcd)e/")] == ["ab", "bc", "", "", "://x", "=", "a"]


@pytest.mark.filterwarnings("ignore:pattern")
@pytest.mark.parametrize("bad", ["", "abc", "/a", "/(/", "/a/q", "a/b/", "\\a\\", None, 5, "/[/", "1a1"])
def test_invalid_patterns(bad):
    assert parse(bad) is None


def test_long_texts_do_not_overflow(spark):
    text = "word and " * 20_000
    p = load("file_scan")
    user = from_config({"strategies": ["regex_patterns"], "patterns": {"deep": "/^(?:[a-z]+ )+!$/"}})
    assert user.patterns[0][1].deep and not parse("/^(a|b)$/").deep
    rows = spark.createDataFrame([(text,), (text + "!",), (None,)], "t string").select(mask_text(F.col("t"), p), mask_text(F.col("t").substr(1, 3000), user)).collect()
    assert rows[0][0] == text and rows[2][0] is None


@pytest.mark.parametrize(
    "profile,text,masked",
    [
        ("default", "mail a@b.co", True),
        ("default", "555-123-4567", True),
        ("default", "Operation " + "x9Kq2LmZ7vRt4WpY8sDf1GhJ3bNc6", False),  # an unanchored exclusion
        ("file_scan", "API_KEY=aaaaaaaaaaaaaaaa", False),  # patterns heed case
        ("file_scan", "API_KEY=abcdefghijklmnop1234", True),  # 28 different bytes: entropy
        ("file_scan", "api_key=abcdefghijklmnop1234", True),
        ("strict", "       ", True),  # the loose phone pattern
        ("performance", "A" * 32, True),
        ("performance", "A" * 31, False),
    ],
)
def test_profiles_on_texts(spark, profile, text, masked):
    row = spark.createDataFrame([(text,)], "t string").select(mask_text(F.col("t"), load(profile))).first()
    assert (row[0] == "[REDACTED]") is masked and (masked or row[0] == text)


ENTROPY = {"strategies": ["shannon_entropy"], "shannon_entropy": {"enabled": True, "threshold": 3.0, "min_length": 10, "exclusion_patterns": ["/^[0-9a-f]+$/i", "/^https?:/"]}}


@pytest.mark.parametrize("text,masked", [("a1b2c3d4" * 8, True), ("a1b2c3d4e5f6", False), ("http://abcdefghijk", False), ("abcdefgh!", False), ("abcdefgh!?", True), ("αβγδαβγδ", False)])
def test_entropy_rule(spark, text, masked):
    row = spark.createDataFrame([(text,)], "t string").select(mask_text(F.col("t"), from_config(ENTROPY))).first()
    assert (row[0] == "[REDACTED]") is masked


def test_lengths_are_bytes(spark):
    p = from_config({"strategies": ["large_string"], "max_value_length": 6})
    rows = spark.createDataFrame([("éééé",), ("éée",), ("abcdef",)], "t string").select(mask_text(F.col("t"), p)).collect()
    assert [r[0] for r in rows] == ["[REDACTED] (String with 8 characters)", "éée", "abcdef"]


def test_first_match_wins_and_disabled(spark):
    p = from_config({"strategies": ["regex_patterns", "large_string"], "patterns": {"a": "/a/"}, "max_value_length": 3})
    q = from_config({"strategies": ["large_string", "regex_patterns"], "patterns": {"a": "/a/"}, "max_value_length": 3})
    df = spark.createDataFrame([("aaaa",)], "t string")
    assert df.select(mask_text(F.col("t"), p)).first()[0] == "[REDACTED]" and "String with 4" in df.select(mask_text(F.col("t"), q)).first()[0]
    assert df.select(mask_text(F.col("t"), from_config({"enabled": False, "strategies": ["regex_patterns"], "patterns": {"a": "/a/"}}))).first()[0] == "aaaa"
    assert Profile().strategies == ()
