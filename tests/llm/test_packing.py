import zlib
from collections import Counter

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from hypothesis import given, settings
from hypothesis import strategies as st

from umbra.llm import packing

PATH = public.path("byte_bpe_50k.json")
PLAIN = tokenizers.Tokenizer.from_file(PATH)
OWN = packing.WordEncoder(open(PATH, encoding="utf-8").read())


def plain(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab Z9'.,\n\t\x1c\xa0　é😀<|>!  s"), max_size=40))
def test_words_give_the_ids_of_the_whole_text(text):
    texts = [text, "", text[::-1], " a" + text]
    assert [np.frombuffer(i, "<u4").tolist() for i in OWN.ids(texts)] == list(map(plain, texts))


def test_full_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    own = packing.WordEncoder(open(PATH, encoding="utf-8").read())
    for text in ["a b c d e f", "f e d", "x y a b", "a<|endoftext|>b <|endoftext|>"]:
        assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == plain(text)
    assert list(packing.runs(["ab", "c", "", "def", "g"], 3)) == [(0, 2), (2, 4), (4, 5)] and list(packing.runs([], 3)) == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 16, 31, 100])
def test_pieces(n):
    got = packing.pieces(n, 8)
    assert [s for s, _ in got] == list(np.cumsum([0] + [x for _, x in got])[:-1]) and sum(x for _, x in got) == n
    assert all(x in (1, 2, 4, 8) for _, x in got) and max(Counter(x for _, x in got if x < 8).values(), default=0) <= 1


def test_odd_rows(odd):
    rows = packing.pack(odd.repartition(3), PATH, 64, with_ids=True).collect()
    docs = Counter((r.doc_id, tuple(plain(r.text or "")) + (1,)) for r in odd.collect())
    pieces = [(r.doc_id, s, x, ids[s : s + x], len(ids)) for (d, ids), k in docs.items() for _ in range(k) for r in [type("R", (), {"doc_id": d})] for s, x in packing.pieces(len(ids), 64)]
    want = Counter((d, s, x, zlib.crc32(np.array(i, "<u4").tobytes()), n, i) for d, s, x, i, n in pieces)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, tuple(r.ids)) for r in rows) == want
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and {r.offset for r in rows} == {0}
    by_id = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert by_id == sorted(by_id, reverse=True)  # buckets of equal lengths


def test_empty(none):
    assert packing.pack(none, PATH).count() == 0


def test_needs_a_power_of_two(odd):
    with pytest.raises(ValueError):
        packing.pack(odd, PATH, 1000)


def test_words_with_a_mark_are_put_together():
    """A word of letters and a mark takes the letters' ids, which are encoded once, and the mark's."""
    from tokenizers import Tokenizer

    from umbra.llm.packing import WordEncoder

    raw = open(public.path("byte_bpe_50k.json"), encoding="utf-8").read()
    words, one = WordEncoder(raw), Tokenizer.from_str(raw)
    texts = ["Ein inwhtion. athawh, übel. é", " lead  two  wide .\n, x. ", "", " ", "a. ", "naïve,\nnext. İx. १. z'. it's, end."]
    want = [one.encode(t, add_special_tokens=False).ids for t in texts]
    assert [[int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)] for b in words.ids(texts)] == want
    assert {"inwhtion", "inwhtion.", "übel"} <= words._kept.keys()
