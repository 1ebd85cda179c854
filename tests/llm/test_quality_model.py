import random

import numpy as np
import pyarrow.parquet as pq

from umbra.llm.quality_model import N_CONTENT, N_META, CoTrained, Logistic, _views, co_train, content, metadata, score, train

GOOD = "people water house river morning evening market garden window letter story city mountain".split()


def corpus(n=600):
    rng, rows = random.Random(7), []
    for i in range(n):
        words = [rng.choice(GOOD) for _ in range(rng.randrange(20, 80))]
        bad = i % 3 == 0
        if bad:
            words = [w + rng.choice(["###", "$$$", "%%%"]) for w in words]
        rows.append((i, " ".join(words), f"host{i % 3 if bad else 3 + i % 4}", "en", int(not bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, s, g, len(t)) for i, t, s, g, _ in rows], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, y) for i, *_, y in rows if i % 2 == 0], "doc_id long, quality int")
    model = train(df, labels)
    got = {r.doc_id: r for r in score(df, model).collect()}
    assert np.mean([got[i].kept == bool(y) for i, *_, y in rows if i % 2]) > 0.98
    assert model.given[0][0] > 0  # the content view was sure of pool rows


def test_against_a_plain_loop(spark):
    """Round by round in plain Python, all unlabelled documents at hand, with the same numbers."""
    rows = corpus(300)
    df = spark.createDataFrame([(i, t, s, g, len(t)) for i, t, s, g, _ in rows], "doc_id long, text string, source string, lang string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, *_, y in rows if i % 3 == 0 or i % 7 == 0], "doc_id long, quality int")
    model = train(df, labels, rounds=2)
    hashed = {r.k: r.h for r in spark.range(300).selectExpr("id as k", "xxhash64(id) as h").collect()}
    truth = {i: y for i, *_, y in rows if i % 3 == 0 or i % 7 == 0}
    known, others = sorted(truth, key=hashed.get), sorted((i for i in range(300) if i not in truth), key=hashed.get)
    exact = {i: [v[0] for v in _views([(t, s, g, len(t))])] for i, t, s, g, _ in rows}
    rounded = {i: [v.astype(np.float16).astype(np.float32) for v in x] for i, x in exact.items()}
    train_ids = [k for n, k in enumerate(known) if n % 5 != 4]
    held = [k for n, k in enumerate(known) if n % 5 == 4]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    extra = [{}, {}]
    for turn in range(3):
        fitted = []
        for view in (0, 1):
            ids = [*train_ids, *extra[view]]
            y = [*(truth[k] for k in train_ids), *extra[view].values()]
            w = np.array([1.0] * len(train_ids) + [0.5] * len(extra[view]))
            m = Logistic().fit(np.array([rounded[k][view] for k in ids]), np.array(y, float), w)
            platt = Logistic(1e-3).fit(np.array([[m.logit(rounded[k][view])] for k in held]), np.array([truth[k] for k in held], float))
            fitted.append((m, float(platt.coef[0]), platt.bias))
        if turn < 2:
            extra = [{}, {}]
            for k in others:
                for view, (m, a, b) in enumerate(fitted):
                    p = sig(a * m.logit(exact[k][view]) + b)
                    if p >= 0.97 or p <= 0.03:
                        extra[1 - view][k] = float(p >= 0.97)
            assert model.given[turn] == (len(extra[1]), len(extra[0])) and sum(map(len, extra)) > 50
    logit = lambda k, x: [np.clip(a * m.logit(x[k][v]) + b, -30, 30) for v, (m, a, b) in enumerate(fitted)]
    joint = Logistic(1e-3).fit(np.array([logit(k, rounded) for k in held]), np.array([truth[k] for k in held], float))
    got = {r.doc_id: r for r in score(df, model).collect()}
    for k in range(300):
        c, m = logit(k, exact)
        want = [sig(c), sig(m), sig(max(joint.coef[0], 0) * c + max(joint.coef[1], 0) * m + joint.bias)]
        assert np.allclose([got[k].content_score, got[k].metadata_score, got[k].score], want, atol=2e-3)


def test_pseudo_labels_come_from_all_documents(spark):
    rows = corpus(400)
    df = spark.createDataFrame([(i, t, s, g, len(t)) for i, t, s, g, _ in rows], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, y) for i, *_, y in rows if i < 120], "doc_id long, quality int")
    model = train(df, labels, pseudo=10, rounds=1)  # few for a fit, whoever is sure is counted
    assert model.given[0][0] > 200


def test_ties_and_repeated_rows(spark):
    rows = corpus(120)
    df = spark.createDataFrame([(i, t, s, g, len(t)) for i, t, s, g, _ in rows + rows[:40]], "doc_id long, text string, source string, lang string, n_chars long")
    labels = [(i, y) for i, *_, y in rows] + [(i, 1 - y) for i, *_, y in rows[:2]]  # contradicted: 1
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    model = train(df, labels, rounds=1)
    got = score(df, model).collect()
    by_id: dict = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.score, r.kept))
    assert len(got) == 160 and all(len(v) == 1 for v in by_id.values())


def test_views_teach_each_other():
    """A view with few informative labels gains from the other's pseudo-labels."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2000)
    a = (y * 2 - 1)[:, None] * 3 + rng.normal(size=(2000, 2))
    b = (y * 2 - 1)[:, None] * 1.0 + rng.normal(size=(2000, 30)) * 2
    few = slice(0, 60)
    with_pool = co_train((a[few], b[few]), y[few], (a[60:1000], b[60:1000]))
    alone = co_train((a[few], b[few]), y[few], (a[:0], b[:0]))
    right = lambda m, col: np.mean((m.scores((a[1000:], b[1000:]))[:, col] > 0.5) == y[1000:])
    assert right(with_pool, 1) > right(alone, 1) and right(with_pool, 2) > 0.97 and with_pool.given[0][0] > 500


def test_real_labels():
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in pq.read_table(f"{d}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{d}/labels.parquet").to_pylist()}
    known, rest = sorted(labels), sorted(set(docs) - set(labels))
    view = lambda ids: _views([(docs[i]["text"], docs[i]["source"], docs[i]["lang"], docs[i]["n_chars"]) for i in ids])
    fit, test = known[: len(known) * 3 // 4], known[len(known) * 3 // 4 :]
    model = co_train(view(fit), [labels[i] for i in fit], view(rest))
    p, y = model.scores(view(test))[:, 2], np.array([labels[i] for i in test])
    assert np.mean((p > 0.5) == y) > 0.93 and np.mean(p[y == 1] > 0.5) > 0.97


def test_views_of_odd_values():
    for t in ("", "x", "é" * 5, " \n"):
        assert content(t).shape == (N_CONTENT,) and np.isfinite(content(t)).all()
    assert metadata(None, None, None, "").sum() == 5 and metadata("a", "b", -3, "x\ny").shape == (N_META,)


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (6, 0, "x"), (6, 1, "x"), (None, 1, "x"), (9, None, "x"), (77, 0, "x")], "doc_id long, quality int, text string")
    model = train(odd, labels)
    assert model.views is None and model.share == 1.0  # one class only
    assert score(odd, model).count() == odd.count() and score(none, model).count() == 0
    assert train(none, labels) == CoTrained() and train(odd, labels.limit(0)) == CoTrained()
    many = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    rows = score(odd, train(odd, many)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
