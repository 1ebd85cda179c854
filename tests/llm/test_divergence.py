import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from umbra.llm.divergence import audit, shares
from umbra.llm.prefix_trie import Trie

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        others = [s for x, s in groups if x == lang]

        def p(of, t):
            n = sum(sum(counts[lang, s][k] for k in kept) for s in of)
            return 1 + 10**9 * (sum(counts[lang, s][t] for s in of) + 2) // (n + 2 * len(kept))

        f = lambda a, b: (a - b) ** 2 // (a + b)
        pair = [(-sum(f(p([source], t), p([o], t)) for t in kept), o.encode()) for o in others if o != source]
        term = [(-f(p([source], t), p(others, t)), t.encode()) for t in kept if counts[lang, source][t] and p([source], t) > p(others, t)]
        for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
            out += [(lang, source, part, item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


def got(df, **kw):
    return sorted(tuple(r) for r in audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = ["a", "ab", "abc", "abcd", "abd", "b", "été", "é", "日本", "日", "Zoë", "zo", "x" * 300, "x" * 299 + "y", "x" * 299]
    rows = []
    for i in range(n):
        k = int(rng.integers(0, 4))
        text = " ".join(np.array(words)[np.minimum(rng.geometric(0.2 + 0.03 * k, rng.integers(0, 40)), len(words)) - 1])
        rows.append((text.upper() if i % 9 == 0 else text, ["en", "de", None][i % 3], None if k == 3 else f"s{k}"))
    return rows


SCHEMA = "text string, lang string, source string"


@pytest.mark.parametrize("settings_", [{}, {"flush": 5, "heavy": 8, "tile": 2, "cells": 4}])
def test_equals_brute_force(spark, settings_):
    rows = corpus(120, 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert got(df, least_docs=10, **settings_) == brute(rows, 10)


def test_odd_rows(spark, odd, none):
    """Few documents: nothing is kept, each pair is 0 apart; then with a lower bar."""
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert got(odd) == brute(rows, 10) and all(r[4] == 0 for r in got(odd))
    assert got(odd, least_docs=1) == brute(rows, 1)
    assert got(none) == []


def test_one_term_in_most_tasks(spark):
    """A single term whose counters are too many for a task is summed in parts first."""
    rows = [("the the", "en", f"s{i % 7}") for i in range(140)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(14), flush=1, heavy=6) == brute(rows, 10)


def test_invalid_bytes(spark):
    df = spark.range(20).selectExpr("cast(unhex('61FF62') as string) as text", "'en' as lang", "if(id < 10, 'a', 'b') as source")
    assert df.transform(audit).count() == 2


@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 3), st.integers(1, 5)), max_size=40), st.integers(0, 4), st.integers(1, 3))
@settings(max_examples=200, deadline=None)
def test_tries_pack_cut_and_merge(entries, depth, parts):
    tries, docs, counts = [], Counter(), Counter()
    for part in range(parts):
        own, by = Counter(), [Counter() for _ in range(4)]
        for key, source, n in entries[part::parts]:
            own[key] += 1
            by[source][key] += n
            docs[key] += 1
            counts[key, source] += n
        trie = Trie.counted(own, by)
        pieces = []
        for stem, a, b in trie.subtrees(depth):
            data, used = trie.packed(a, b)
            piece = Trie.unpacked(data)
            piece.source = used[piece.source]
            pieces.append((stem, piece))
        assert [k for _, t in pieces for k in t.keys] == sorted(own)
        assert all(k[:depth] == stem for stem, t in pieces for k in t.keys)
        tries += [t for _, t in pieces]
    if not tries:
        return
    whole = Trie.merged(tries, 4, 2)
    assert dict(zip(whole.keys, whole.docs)) == {k: n for k, n in docs.items() if n >= 2} and whole.keys == sorted(whole.keys)
    found = {(k, int(s)): int(n) for i, k in enumerate(whole.keys) for s, n in zip(whole.source[whole.at[i] : whole.at[i + 1]], whole.count[whole.at[i] : whole.at[i + 1]])}
    assert found == {(k, s): n for (k, s), n in counts.items() if docs[k] >= 2}


@given(st.integers(0, 10**12), st.integers(0, 10**12))
def test_shares_are_exact(count, more):
    total = count + 2 + more
    assert int(shares(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 2) // total
