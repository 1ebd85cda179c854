"""A quality classifier by co-training over two views of a document.

The content view sees the text: hashed byte trigrams and the shares of letters, capitals,
digits, symbols, repeated and distinct words.  The metadata view sees what surrounds
it: source, declared language, length and the layout in lines.  Each view has a
logistic classifier, calibrated on labelled rows held out from it.  In each round both
score every unlabelled document of the corpus; what one is confident of becomes a
pseudo-label in the other's training rows.  A view that can't be confident gives none.
At the end the calibrated log-odds of the views are combined by a third logistic model,
fitted on the held-out rows, and score every document of the corpus.

A fit on the driver takes a bounded sample: LABELLED labelled documents, and of the
pseudo-labelled ones PSEUDO for a view and round, both the first by a hash of their ids.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import arrow_batches, cut, inputs, join_per_key, small_batches

LABELLED, PSEUDO = 6000, 3000
ROUNDS = 3
CONFIDENT = 0.97
THRESHOLD = 0.5
GRAMS = 1024
SOURCES, LANGUAGES, STEPS = 128, 16, 24
#: Of bytes: letters, capitals, digits, white space, marks of prose, other ASCII marks.
_CLASSES = np.zeros(256, dtype=np.int64)
for _c, _members in enumerate(
    (b"", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"()?-", b"!#$%&*+/<=>@[\\]^_`{|}~")
):
    _CLASSES[list(_members)] = _c
N_CONTENT = GRAMS + 7 + 4
N_META = SOURCES + LANGUAGES + 3 * STEPS


def content(text: str) -> np.ndarray:
    """The content view of a whole text."""
    out = np.zeros(N_CONTENT, dtype=np.float32)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(b):
        return out
    if len(b) > 2:
        w = b.astype(np.uint32)
        code = (w[:-2] << np.uint32(16)) | (w[1:-1] << np.uint32(8)) | w[2:]
        grams = np.bincount((code * np.uint32(2654435761)) >> np.uint32(22), minlength=GRAMS)
        out[:GRAMS] = np.sqrt(grams / (len(b) - 2))
    out[GRAMS : GRAMS + 7] = np.sqrt(np.bincount(_CLASSES[b], minlength=7) / len(b))
    words = text.split()
    n = len(words)
    if n:
        same = sum(map(str.__eq__, words, words[1:]))
        out[GRAMS + 7 :] = (np.sqrt(same / n), len(set(words)) / n, min(np.log1p(n) / 8, 2), min(len(text) / n / 20, 2))
    return out


def _step(x: float) -> int:
    return int(min(STEPS - 1, np.log2(x + 1)))


def metadata(source: str | None, lang: str | None, n_chars: int | None, text: str) -> np.ndarray:
    """The metadata view; missing values have a place of their own."""
    out = np.zeros(N_META, dtype=np.float32)
    out[crc32(("+" + source if source is not None else "-").encode()) % SOURCES] = 1
    out[SOURCES + crc32(("+" + lang if lang is not None else "-").encode()) % LANGUAGES] = 1
    n, lines = max(n_chars if n_chars is not None else len(text), 0), text.count("\n") + 1
    at = SOURCES + LANGUAGES
    for i, x in enumerate((n, lines, n / lines)):
        out[at + i * STEPS + _step(x)] = 1
    return out


class Logistic:
    """Logistic regression with an L2 penalty, by Adam on all rows at once."""

    def __init__(self, penalty: float = 1e-4, steps: int = 300, rate: float = 0.05):
        self.penalty, self.steps, self.rate = penalty, steps, rate

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "Logistic":
        w = np.ones(len(y)) if weight is None else weight
        w = (w / w.sum()).astype(np.float64)
        first, second = np.zeros(x.shape[1]), np.zeros(x.shape[1])
        for i in range(0, len(x), 1024):  # a block at a time: its squares are wider than the rows
            block = x[i : i + 1024].astype(np.float64)
            first += w[i : i + 1024] @ block
            second += w[i : i + 1024] @ (block * block)
        self.mean = first
        self.scale = np.sqrt(np.maximum(second - first * first, 0)) + 0.02
        z = x.astype(np.float32)
        z -= self.mean.astype(np.float32)
        z /= self.scale.astype(np.float32)
        theta, first, second = np.zeros(z.shape[1] + 1), 0.0, 0.0
        for t in range(1, self.steps + 1):
            error = w * (sigmoid(z @ theta[:-1].astype(np.float32) + theta[-1]) - y)
            g = np.append(error.astype(np.float32) @ z + self.penalty * theta[:-1], error.sum())
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            theta -= self.rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        self.coef = theta[:-1] / self.scale
        self.bias = float(theta[-1] - self.coef @ self.mean)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coef + self.bias


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class CoTrained:
    """Two calibrated views and how they are combined; without both classes only a share."""

    share: float = 1.0
    views: tuple | None = None
    scales: tuple | None = None
    joint: tuple | None = None
    given: tuple = ()

    def scores(self, xs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Columns: content, metadata and combined probability of quality."""
        if self.views is None:
            return np.full((len(xs[0]), 3), self.share)
        logits = [np.clip(a * (x @ coef + bias) + b, -30, 30) for (coef, bias), (a, b), x in zip(self.views, self.scales, xs)]
        (c, m), bias = self.joint
        return sigmoid(np.column_stack([*logits, c * logits[0] + m * logits[1] + bias]).astype(np.float64))


class CoTraining:
    """The labelled rows (two views), every fifth held out for calibration, and fits with more rows."""

    def __init__(self, xs, y):
        self.xs, self.y = xs, np.asarray(y, dtype=np.float64)
        self.share = float(self.y.mean()) if len(self.y) else 1.0
        self.held = np.arange(len(self.y)) % 5 == 4
        self.both = len({*self.y[self.held]}) == 2 and len({*self.y[~self.held]}) == 2
        self.given: list[tuple[int, int]] = []

    def fit(self, extra) -> None:
        """``extra``: for each view the rows and labels that the other one gave it."""
        self.views, self.scales = [], []
        for x, (more, label) in zip(self.xs, extra):
            rows = np.concatenate([x[~self.held], more])
            weight = np.concatenate([np.ones((~self.held).sum()), np.full(len(more), 0.5)])
            model = Logistic().fit(rows, np.concatenate([self.y[~self.held], label]), weight)
            platt = Logistic(1e-3).fit(model.logit(x[self.held])[:, None], self.y[self.held])
            self.views.append(model)
            self.scales.append((float(max(platt.coef[0], 0.0)), platt.bias if platt.coef[0] > 0 else float(np.log(self.share / (1 - self.share)))))

    def probabilities(self, xs) -> np.ndarray:
        """Columns: by content, by metadata."""
        return np.column_stack([sigmoid(a * v.logit(x) + b) for v, (a, b), x in zip(self.views, self.scales, xs)]).reshape(-1, 2)

    def finished(self) -> CoTrained:
        logits = np.column_stack([np.clip(a * v.logit(x[self.held]) + b, -30, 30) for v, (a, b), x in zip(self.views, self.scales, self.xs)])
        joint = Logistic(1e-3).fit(logits, self.y[self.held])
        weights = tuple(float(max(c, 0.0)) for c in joint.coef)
        return CoTrained(self.share, tuple((v.coef.astype(np.float32), v.bias) for v in self.views), tuple(self.scales), (weights, joint.bias), tuple(self.given))


def sure(probabilities: np.ndarray, confident: float = CONFIDENT) -> np.ndarray:
    """1 and 0 where a view is confident of that, -1 elsewhere."""
    return np.where(probabilities >= confident, 1, np.where(probabilities <= 1 - confident, 0, -1))


def co_train(xs, y, pool, rounds: int = ROUNDS, confident: float = CONFIDENT) -> CoTrained:
    """Fit on labelled rows (``xs``: the two views, ``y``) and unlabelled ``pool`` rows (two views), all at hand."""
    training = CoTraining(xs, y)
    if not training.both:
        return CoTrained(training.share)
    training.fit([(p[:0], np.zeros(0)) for p in pool])
    for _ in range(rounds):
        said = sure(training.probabilities(pool), confident)
        extra = [(pool[view][said[:, 1 - view] >= 0], said[said[:, 1 - view] >= 0, 1 - view].astype(np.float64)) for view in (0, 1)]
        training.given.append((len(extra[1][0]), len(extra[0][0])))  # by content, by metadata
        training.fit(extra)
    return training.finished()


def _views(rows):
    pairs = [(content(t or ""), metadata(s, g, n, t or "")) for t, s, g, n in rows]
    return (
        np.array([c for c, _ in pairs], dtype=np.float32).reshape(-1, N_CONTENT),
        np.array([m for _, m in pairs], dtype=np.float32).reshape(-1, N_META),
    )


_INPUTS = {"_t": ("text", "string"), "_s": ("source", "string"), "_g": ("lang", "string"), "_c": ("n_chars", "long")}


def _features(rows: DataFrame, ids: list[int]) -> dict[int, bytes]:
    """The views of the documents ``ids``, as float16: of a bounded number, they come to the driver."""
    if not ids:
        return {}

    def featured(iterator):
        import pyarrow as pa

        for batch, columns in arrow_batches(iterator, ["_t", "_s", "_g", "_c"]):
            c, m = _views(zip(*columns))
            packed = [np.concatenate([a, b]).astype(np.float16).tobytes() for a, b in zip(c, m)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["_k", "x"])

    wanted = rows.sparkSession.createDataFrame([(k,) for k in ids], "_k long")
    found = rows.join(F.broadcast(wanted), "_k").mapInArrow(featured, "_k long, x binary")
    with small_batches(rows.sparkSession):
        return {r["_k"]: r["x"] for r in found.groupBy("_k").agg(F.min("x").alias("x")).collect()}


def _unpacked(found: dict[int, bytes], ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([np.frombuffer(found[k], np.float16) for k in ids], dtype=np.float32).reshape(-1, N_CONTENT + N_META)
    return x[:, :N_CONTENT], x[:, N_CONTENT:]


def _pseudo_labels(rows: DataFrame, votes: DataFrame, training: CoTraining, confident: float) -> DataFrame:
    """(_k, by_content, by_metadata) of all unlabelled documents that a view is sure of; -1 where it isn't."""
    shared = rows.sparkSession.sparkContext.broadcast((training.views, training.scales))  # weights of fixed number

    def run(iterator):
        import pyarrow as pa

        views, scales = shared.value
        for batch, columns in arrow_batches(iterator, ["_t", "_s", "_g", "_c"]):
            xs = _views(zip(*columns))
            said = sure(np.column_stack([sigmoid(a * v.logit(x) + b) for v, (a, b), x in zip(views, scales, xs)]).reshape(-1, 2), confident)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(said[:, i], pa.int32()) for i in (0, 1))], ["_k", "by_content", "by_metadata"])

    said = cut(rows.mapInArrow(run, "_k long, by_content int, by_metadata int").where("by_content >= 0 or by_metadata >= 0"))
    first = said.groupBy("_k").agg(F.min(F.struct("by_content", "by_metadata")).alias("s")).select("_k", "s.*")
    return join_per_key(first, votes, "_k", "left_anti")


def train(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    labelled: int = LABELLED,
    pseudo: int = PSEUDO,
    rounds: int = ROUNDS,
    confident: float = CONFIDENT,
) -> CoTrained:
    """Fit from at most ``labelled`` labelled documents of ``df``, with pseudo-labels drawn from all others.

    A fit takes at most ``pseudo`` pseudo-labelled documents for each view.  Documents
    are taken in the order of a hash of their ids; one id counts once, with the majority
    of its labels (1 of two as frequent) and the least of its rows.  Null ids and null
    labels take no part.  Without both classes among the labelled rows the model's only
    score is the share of label 1, or 1.0 without labels.
    """
    votes = inputs(labels, _k=(id_col, "long"), _y=(label_col, "double")).where("_k is not null and _y is not null")
    votes = cut(votes.groupBy("_k").agg((F.avg("_y") >= 0.5).cast("int").alias("_y")))
    rows = inputs(df, _k=(id_col, "long"), **_INPUTS).where("_k is not null")
    ids = rows.select("_k").distinct()
    some = {r["_k"]: r["_y"] for r in ids.join(votes, "_k").orderBy(F.xxhash64("_k"), "_k").limit(labelled).collect()}
    found = _features(rows, list(some))
    order = [k for k in some if k in found]
    training = CoTraining(_unpacked(found, order), [some[k] for k in order])
    if not training.both:
        return CoTrained(training.share)
    none = [np.zeros((0, n), np.float32) for n in (N_CONTENT, N_META)]
    training.fit([(x, np.zeros(0)) for x in none])
    found = {}
    for _ in range(rounds):
        said = cut(_pseudo_labels(rows, votes, training, confident))
        n = said.agg(*(F.count_if(F.col(c) >= 0).alias(c) for c in ("by_content", "by_metadata"))).first()
        training.given.append((n.by_content, n.by_metadata))
        given = []  # to the content view by metadata, to the metadata view by content
        for by in ("by_metadata", "by_content"):
            given.append([(r["_k"], r[by]) for r in said.where(F.col(by) >= 0).orderBy(F.xxhash64("_k"), "_k").limit(pseudo).select("_k", by).collect()])
        wanted = {k for side in given for k, _ in side}
        found = {k: x for k, x in found.items() if k in wanted}
        found |= _features(rows, sorted(wanted - found.keys()))
        training.fit([(_unpacked(found, [k for k, _ in side])[view], np.array([y for _, y in side], dtype=np.float64)) for view, side in enumerate(given)])
    return training.finished()


def score(df: DataFrame, model: CoTrained, threshold: float = THRESHOLD, id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``df``: doc_id, content_score, metadata_score, score, kept.

    Columns in ``carry`` go along as ``keep_<name>``, so that a filter needs no join.

    Scores are probabilities of quality; kept: score is at least ``threshold``, or the
    model is without classes.  Null and empty texts are scored by their metadata and an
    empty content; columns that ``df`` lacks count as missing.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # weights of fixed number

    def run(iterator):
        import pyarrow as pa

        for batch, columns in arrow_batches(iterator, ["_t", "_s", "_g", "_c"]):
            s = shared.value.scores(_views(zip(*columns)))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[:, j]) for j in range(3)), *kept], ["doc_id", "content_score", "metadata_score", "score", *kinds])

    kinds = {f"keep_{c}": (c, df.schema[c].dataType.simpleString()) for c in carry}
    schema = "doc_id long, content_score double, metadata_score double, score double" + "".join(f", {name} {kind}" for name, (_, kind) in kinds.items())
    rows = inputs(df, doc_id=(id_col, "long"), **_INPUTS, **kinds).mapInArrow(run, schema)
    return rows.withColumn("kept", (F.col("score") >= threshold) | F.lit(model.views is None))
