import random

import numpy as np

from umbra.llm import near_copies as N

import corpus_pipeline as P


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def brute(texts):
    root = list(range(len(texts)))
    changed = True
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    while changed:
        changed = False
        for i, j in near:
            low = min(root[i], root[j])
            if root[i] != low or root[j] != low:
                root[i] = root[j] = low
                changed = True
    return dict(enumerate(root))


def corpus():
    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    texts = [prose(rng.randrange(80, 300)) for _ in range(30)]
    texts += [edited(rng, t, k) for t in texts for k in (1, 3, 6)]
    base = prose(200)
    texts += [edited(rng, base, rng.randrange(1, 4)) for _ in range(60)] + [base] * 5  # longer than a list of pairs
    rng.shuffle(texts)
    return texts


def test_against_all_pairs(spark):
    texts = corpus()
    got = {r.id: r.component_id for r in N.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == brute(texts)


def test_stage_drops_edited_copies(spark, tmp_path):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(4000)}" for _ in range(200))
    rows = [(1, text), (2, edited(rng, text, 3)), (3, edited(rng, text, 30)), (4, None), (5, " ")]
    assert jaccard(text, rows[1][1]) >= 0.8 > jaccard(text, rows[2][1])
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/d")
    assert sorted(r.doc_id for r in P.near(spark, spark.read.parquet(f"{tmp_path}/d"), "").collect()) == [1, 3, 4]


def test_similar():
    a = np.arange(10, dtype=np.uint64)
    assert N.similar(a, a[:8]) and not N.similar(a, a[:7]) and N.similar(a[:0], a[:0]) and not N.similar(a[:0], a)
