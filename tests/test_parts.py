"""A scan in parts finds what a scan of the whole files does, for all sizes of parts."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from umbra.functions.dialect import parse
from umbra.operators import parts as P
from umbra.operators.scanning import scan_contents
from umbra.plans.registry import ColumnStrategy, register, unregister
from umbra.profiles import from_config, load
from umbra.scan import main
from umbra.sources.allfiles import read_files

BOUNDED = [r"/\bA\d{3,5}\b/", r"/(?<=key)[ab]{2}(?!c)/", r"/^ab/", r"/ba$/", r"/^a.b$/m", r"/\Aab|ba\z/", r"/(?<!a)\Bb{3}/", r"/x?/", r"/(?i)KEY/", r"/[^a\n]{4}/s"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"A1", b"23", b"4", b"key", b"\n", b"c", b"\xe9", b" "]), min_size=1, max_size=40), st.integers(1, 9), st.sampled_from(BOUNDED))
def test_bounded_patterns_in_windows(pieces, part, text):
    content, pattern = b"".join(pieces), parse(text)
    assert P.reach(pattern) is not None
    seen = [P.found_in_part(content, i, min(i + part, len(content)), pattern) for i in range(0, len(content), part)]
    assert any(seen) == pattern.found_in(content)


def test_what_is_searched_whole():
    assert P.reach(parse("/a{3}b?/")) == (4, 2)
    assert P.reach(parse("/(?<=abc)d/"))[1] == 5
    assert P.reach(parse("/a+/")) is None and P.reach(parse("/(?=a*)b/")) is None and P.reach(parse("/é/u")) is None
    assert P.reach(parse("/a{9999999}/")) is None  # a window isn't to outgrow its part
    p = from_config({"strategies": ["regex_patterns"], "patterns": [r"/\d{4}/", r"/a+b/i"]})
    assert P.whole_patterns(p) == ["a+b i"]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top, rng = tmp_path_factory.mktemp("parts"), random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    prose = " ".join(word(rng.randrange(2, 9)) for _ in range(900))
    secrets = ["078-05-1120", "4111 1111 1111 1111", "me@example.org", "AKIA" + "Z" * 16, "password = hunter2", "eyJhb.eyJzd.abc"]
    files = {"empty": b"", "redacted": b"[REDACTED]", "prose": prose.encode(), "random": rng.randbytes(6000), "hex": b"0f" * 3000, "url": b"https://x/" + rng.randbytes(5000), "edge": b"a" * 4095 + b" 078-05-1120"}
    for i, s in enumerate(secrets):
        at = prose.index(" ", rng.randrange(3000))
        files[f"secret{i}"] = f"{prose[:at]} {s} {prose[at:]}".encode()
        files[f"last{i}"] = f"{prose} {s}".encode()
    for name, content in files.items():
        (top / name).write_bytes(content)
    return str(top)


PROFILES = [
    load("file_scan"),
    from_config({"strategies": ["large_string", "regex_patterns"], "max_value_length": 4000, "patterns": [r"/\d{3}-\d\d-\d{4}/", r"/é|me@/u"]}),
    from_config({"strategies": ["regex_patterns", "large_string"], "max_value_length": 4000, "patterns": [r"/\b\d{3}-\d\d-\d{4}\b/"], "replacement": "***"}),
    from_config({"strategies": ["shannon_entropy"], "shannon_entropy": {"enabled": True, "threshold": 2.9, "exclusion_patterns": ["/^https?:/", "/^[0-9a-f]+$/i"]}}),
    from_config({"strategies": ["blocked_keys"], "blocked_keys": ["*"]}),
    from_config({"strategies": ["safe_keys", "regex_patterns"], "patterns": ["/a/"]}),
    from_config({"enabled": False, "strategies": ["regex_patterns"], "patterns": ["/a/"]}),
]


@pytest.mark.parametrize("which,part", [(i, 700) for i in range(len(PROFILES))] + [(0, 1), (0, 4096), (0, 1 << 20), (3, 64)])
def test_parts_find_what_the_whole_does(spark, tree, which, part):
    for compat in (False, True) if part == 700 else (False,):
        whole = scan_contents(read_files(spark, [tree]), PROFILES[which], compat=compat)
        parted = P.scan_files(spark, [tree], PROFILES[which], part=part, compat=compat)
        assert parted.dtypes == whole.dtypes
        assert sorted(map(str, parted.collect())) == sorted(map(str, whole.collect()))


def test_files_that_are_gone_and_none_at_all(spark, tree, tmp_path):
    large = spark.createDataFrame([(f"{tmp_path}/gone", 5000), (f"{tree}/edge", 4107)], "path string, length long")
    found = {os.path.basename(r.path): r for r in P.scan_large(large, load("file_scan"), 512).collect()}
    assert found["gone"].skipped and found["gone"].error == "File unreadable" and found["gone"].findings == []
    assert not found["edge"].skipped and found["edge"].findings[0].original_length == 4107
    assert P.scan_large(large.limit(0), load("file_scan"), 512).collect() == []


def test_custom_rules_read_the_whole(spark, tree):
    class Long(ColumnStrategy):
        def predicate(self, value, key, kind, profile):
            return value.startswith("https")

        def replace(self, value, key, kind, profile):
            return value.substr(1, 5)

    register("long_rule", Long())
    try:
        p = from_config({"strategies": ["long_rule"]})
        with pytest.raises(ValueError, match="custom rule"):
            P.scan_large(spark.createDataFrame([], "path string, length long"), p)
        rows = P.scan_files(spark, [tree], p, part=64).collect()
        assert [os.path.basename(r.path) for r in rows if r.findings] == ["url"]
    finally:
        unregister("long_rule")


def test_cli_in_parts(spark, tree, capsys, monkeypatch):
    main([tree, "--output", "json"], spark)
    whole = capsys.readouterr().out
    monkeypatch.setattr(P.scan_files, "__defaults__", tuple(256 if d == P.PART else d for d in P.scan_files.__defaults__))
    main([tree, "--output", "json"], spark)
    assert capsys.readouterr().out == whole and "full_content_redacted" in whole
