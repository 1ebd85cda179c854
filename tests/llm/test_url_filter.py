import math
import re
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from umbra.llm.queries import URL_RULES
from umbra.llm.segmentation import LONGEST, UNIT, known_cost, unknown_cost, viterbi
from umbra.llm.url_filter import judge_urls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RUN = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
TOKEN = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+|[0-9]+")


def cheapest(name, known, total):
    """Every way to cut a name."""
    best = None
    for k in range(len(name)):
        for cuts in combinations(range(1, len(name)), k):
            ends = [*cuts, len(name)]
            pieces = [name[a:b] for a, b in zip([0, *cuts], ends)]
            if max(map(len, pieces)) > LONGEST:
                continue
            cost = sum(known_cost(known[p], total) if p in known else unknown_cost(len(p), total) for p in pieces)
            key = (cost, len(pieces))
            best = min(best, key) if best else key
    return best


@given(st.text("ab", min_size=1, max_size=9), st.dictionaries(st.text("ab", min_size=2, max_size=5), st.integers(1, 900), max_size=8))
@settings(max_examples=200, deadline=None)
def test_viterbi_is_the_cheapest_cut(name, words):
    total = 1000 + sum(words.values())
    known = {(i, len(w)): n for w, n in words.items() for i in range(len(name)) if name.startswith(w, i)}
    found = viterbi(name, known, total)
    cost = sum(known_cost(words[p], total) if p in words else unknown_cost(len(p), total) for p in found)
    assert "".join(found) == name and (cost, len(found)) == cheapest(name, words, total)


def test_names_fall_into_words(spark):
    html = "<p>free bets and casino wins, win a casino; garden tools for the garden</p><script src='freebets'></script>" * 5
    rows = [(1, "https://freebetscasino.example.net/x", html), (2, "https://gardentools.example.net/", html)]
    out = {r.page_id: r.host_words for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), []).collect()}
    assert {"free", "bets", "casino"} <= set(out[1]) and {"garden", "tools", "net"} <= set(out[2])


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def tokens(text, kind):
    return [kind + (f"#{len(t)}" if t[0] in "0123456789" else t) for t in TOKEN.findall(text)]


def brute(rows, rules):
    words = Counter()
    for _, _, html in rows:
        words.update(w for w in RUN.findall(re.sub("<[^<>]*>?", " ", html or "").translate(LOWER)) if 2 <= len(w) <= LONGEST)
    total = sum(words.values())

    def of_host(host):
        *front, last = host.split(".")
        out = tokens(last, "h:")
        for t in TOKEN.findall(".".join(front)):
            if t[0] in "0123456789":
                out.append(f"h:#{len(t)}")
            elif len(t) > 63:
                out.append("h:" + t)
            else:
                known = {(i, n): words[t[i : i + n]] for i in range(len(t)) for n in range(2, LONGEST + 1) if i + n <= len(t) and t[i : i + n] in words}
                out += ["h:" + p for p in viterbi(t, known, total)]
        return out

    seen, counts, pages = [], {"allow": Counter(), "block": Counter()}, Counter()
    for i, url, _ in rows:
        host, path = split_url(url)
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fit, key=lambda r: len(r.text), default=None)
        found = of_host(host) + tokens(path.translate(LOWER), "p:")
        if rule:
            counts[rule.verdict].update(found)
            pages[rule.verdict] += 1
        seen.append((i, host, path, rule, found))
    vocabulary = set(counts["allow"]) | set(counts["block"])
    odds = lambda t, v: math.log((counts[v][t] + 1) / (sum(counts[v].values()) + len(vocabulary)))
    prior = round(UNIT * math.log((pages["block"] + 1) / (pages["allow"] + 1)))
    out = []
    for i, host, path, rule, found in seen:
        score = None if rule else prior + sum(round(UNIT * (odds(t, "block") - odds(t, "allow"))) for t in found if t in vocabulary)
        verdict = rule.verdict if rule else "block" if score > 0 else "allow"
        out.append((i, host, path, rule and rule.text, verdict, score))
    return out


URLS = [
    "http://ab.example.org/en/1?x=/es/", "https://Example.ORG/en/12", "https://example.org/es/4", "https://notexample.org/es/4", "https://x.com/fr/1", "https://x.com/de/99#a/b", "https://COM/fr/",
    "https://com.net/fr/", "ftp://org", "https://org/", "https://org?q", "https://spambets.net/de/77", "https://abba-farm42.net/en/5", "//none", "", None, "a://b://c/de/1", "https://user:pw@h.net:80/de/1",
    "https://" + "y" * 70 + ".net/de/", "https://été.net/É/de", "https://x.net/" + "de/" * 5000, "https://spambets.net/de/77", "https://.org/", "https://..../de/",
]


@pytest.mark.parametrize("rules", [URL_RULES, URL_RULES[:1], []])
def test_equals_plain_loops(spark, rules):
    html = ["<p>spam bets <b>ab ba farm", "<html lang=de><<a <b>ab</b> abba été Ab 12 x", None, "", "<" * 5000 + "bets"]
    rows = [(None if i == 3 else i % 20, u, html[i % len(html)]) for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame([(*r, 0, "clash", 1) for r in rows], "page_id long, url string, html string, host int, rule string, score int")
    have = [(r.page_id, r.host, r.path, r.rule, r.verdict, r.score) for r in judge_urls(df, rules).collect()]
    key = lambda r: tuple(str(x) for x in r)
    want = brute(rows, rules)
    assert sorted((r[:5] for r in have), key=key) == sorted((r[:5] for r in want), key=key)
    # A logarithm's last digit can differ between engines: a millionth a token.
    for a, b in zip(sorted(have, key=key), sorted(want, key=key)):
        assert a[5] == b[5] or abs(a[5] - b[5]) <= 20_000
    assert judge_urls(df.limit(0), rules).count() == 0


def test_held_out_rules_are_learnt(spark, tmp_path):
    """A rule taken away is found again by the model from what the others decided."""
    from umbra.llm.url_filter import BLOCK, Rule

    hosts = ["casinowin", "freebets", "gardenclub", "cityhall", "booknews", "betcasino"]
    bad = {"casinowin", "freebets", "betcasino"}
    html = "<p>casino win free bets bet garden club city hall book news</p>" * 3
    rows = [(i, f"https://{h}.example.{tld}/en/{i}", html) for i in range(40) for h in hosts for tld in ("org", "net")]
    rules = [Rule(BLOCK if h in bad else "allow", f"{h}.example.org", "/") for h in hosts if h != "betcasino"]
    out = judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).where("rule is null").collect()
    right = sum((r.host.split(".")[0] in bad) == (r.verdict == "block") for r in out)
    assert len(out) == 280 and right >= 0.95 * len(out)
