import re

from hypothesis import given, settings
from hypothesis import strategies as st

from umbra.llm.quality_rules import Limits, judge, measure

W = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = W.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if W.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab c\n\t#é\x1c|"), max_size=60))
def test_measures(text):
    assert measure(text) == plain(text)


def test_long_repeats():
    assert measure("a b c d e f g " * 1000)[4] == 7000 and measure(None) == (0,) * 6


def test_odd_rows(odd):
    rows = judge(odd).collect()
    assert len(rows) == odd.count()
    by_text = {(r.doc_id): r for r in rows}
    assert by_text[1].kept and not by_text[3].kept and not by_text[4].kept and by_text[7].base_failed
    assert all(r.host_rate is not None for r in rows)


def test_host_verdicts(spark):
    good = "one two three four five six seven eight nine ten eleven {}"
    rows = [(i, good.format(i), "good") for i in range(60)]
    rows += [(100 + i, good.format(i) if i % 10 == 0 else "bad", "bad") for i in range(60)]
    rows += [(200, "bad", "small"), (201, good.format(1), "small")]
    rows += [(300 + i, good.format("#") if i == 0 else good.format(i), "good") for i in range(2)]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), Limits()).collect()}
    assert all(got[i].kept for i in range(60)) and got[300].kept
    assert not any(got[100 + i].kept for i in range(60)) and got[100].host_verdict == "reject"
    assert 0.4 < got[201].host_rate < 0.6 and got[201].kept


def test_empty(none):
    assert judge(none).count() == 0
