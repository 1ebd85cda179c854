import random

import numpy as np
import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")

from hypothesis import given, settings
from hypothesis import strategies as st

from umbra.llm import sentencepieces as S

PATH = public.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = S.Pieces(open(PATH, "rb").read())
ALPHABET = "abtheing  éü\n\t😀①▁<0xA>sunk."


def ids(b):
    return np.frombuffer(b, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=50))
def test_words_give_the_ids_of_the_whole_text(text):
    assert ids(OWN.encode(text)) == SP.encode(text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), min_size=1, max_size=120), st.integers(17, 30))
def test_scan_of_chunks(text, chunk):
    x = S.SPACE + text.replace(" ", S.SPACE)
    cuts = [(a, min(a + chunk, len(x))) for a in range(0, len(x), chunk)]
    args = [(x, a, b, a == 0, b == len(x)) for a, b in cuts]
    ms = [OWN.transfer(*a) for a in args]
    total = ms[0]
    for m in ms[1:]:
        total = S.max_plus(total, m)
    want = SP.encode(text)
    assert total.tolist() == [[-len(want)]]
    out = []
    for a, (enter, leave, before) in zip(args, S.hand_down(ms, 0, 0)):
        assert before == len(out)
        out += ids(OWN.trace(*a, enter, leave))
    assert out == want


@pytest.mark.parametrize("giant", [1 << 16, 40, 0])
def test_odd_rows(odd, giant, monkeypatch):
    monkeypatch.setattr(S, "FAN", 3)
    rows = S.decode(S.encode(odd, PATH, giant, 1000 if giant else 1 << 14), PATH).collect()
    assert sorted((str(r.doc_id), r.text or "", r.text is None) for r in rows) == sorted((str(r.doc_id), r.text or "", r.text is None) for r in odd.collect())
    for r in rows:
        assert (r.ids is None and r.decoded is None) if r.text is None else ids(r.ids) == SP.encode(r.text) and r.decoded == r.text.replace("▁", " ")
    assert (max(r.n_chunks for r in rows) > 27) == (giant > 0)


def test_one_long_word(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("theingéa") for _ in range(5000)), "a" * 3000, "ab" * 2000 + " " * 500 + "x"]
    rows = S.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, 100, 700).collect()
    assert all(ids(r.ids) == SP.encode(texts[r.doc_id]) and r.n_chunks > 3 for r in rows) and len(rows) == 3


def test_empty(none):
    assert S.encode(none, PATH).count() == 0


def test_tables_texts_are_scanned(spark):
    """With a chunk length that many texts of the tables reach, the ids stay the library's."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 9000 and 40000")
    rows = S.encode(docs, PATH, giant=9000, chunk=2500).collect()
    assert len(rows) > 20 and all(r.n_chunks >= 4 and ids(r.ids) == SP.encode(r.text) for r in rows)
