"""Quality classifier: random-indexing word vectors, pooled per document, into a small network.

A word stands for three features, each hashed to one of ``BUCKETS``: its letters in lower case, the
marks around them, and its shape (letter case, and length by powers of two). Every bucket has a fixed sparse random index vector; its
context vector sums the index vectors of the words up to ``REACH`` away (random indexing). A
document is the mean and the standard deviation of its words' context vectors, the shares of words
that equal the one or two before, the mean product of neighbours' vectors, and the logarithm of its
length. A network of two layers in numpy gives the probability of label 1; a temperature
fitted on rows kept out of the fit calibrates it.

Training takes at most about ``SAMPLE`` labelled rows, drawn by a hash of the id from learnable
folds. What reaches the driver is fixed in size: BUCKETS x DIM sums, and one feature vector for
each training row.

Defined results: a null or empty text has a score too (that of zero features); with no labels, or
of one kind only, the score is 0.5 or that label's; several labels of an id count as the smallest;
equal texts get equal scores; a null doc_id is scored and never learned from; extra columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cinderlog.llm.sampling import draw, held_out, learnable
from cinderlog.llm.stages import bounded_batches, drop, fresh, stage
from cinderlog.llm.words import Words, pieces, scan, text_of, utf8

BUCKETS, DIM, REACH, NONZERO, SEED = 1 << 14, 48, 2, 4, 77
SAMPLE, PARTS, BLOCKS, THRESHOLD = 12_000, 16, 32, 0.3
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 3e-3, 1e-4
KEPT_WORDS = 80_000
POOLED = 2 * DIM + 4

_letters = re.compile(rb"[A-Za-z\x80-\xff]+")
_kept: dict[int, tuple[int, int, int]] = {}


def _bucket(kind: int, value: bytes) -> int:
    return zlib.crc32(value, kind) * 2654435761 % 2**32 % BUCKETS


def word_features(word: bytes) -> tuple[int, int, int]:
    core = b"".join(_letters.findall(word))
    marks = _letters.sub(b"", word)
    shape = b"0" if not core else b"x" if core.islower() else b"X" if core.isupper() and len(core) > 1 else b"Xx" if core[:1].isupper() else b"xX"
    return _bucket(1, core.lower()), _bucket(2, marks), _bucket(3, shape + b"%d" % len(word).bit_length())


def featured(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each distinct word, and which of these each word is."""
    names, at, back = np.unique(w.name, return_index=True, return_inverse=True)
    if len(_kept) > KEPT_WORDS:
        _kept.clear()
    raw, out = w.data.tobytes(), []
    for name, a, b in zip(names.tolist(), w.start[at].tolist(), w.end[at].tolist(), strict=True):
        found = _kept.get(name)
        if found is None:
            found = _kept[name] = word_features(raw[a:b])
        out.append(found)
    return np.asarray(out, np.int64).reshape(-1, 3), back


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIM), np.float32)
    where = rng.integers(0, DIM, (BUCKETS, NONZERO))
    out[np.arange(BUCKETS)[:, None], where] = rng.choice(np.asarray([-1, 1], np.float32), (BUCKETS, NONZERO))
    return out


def context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, sums = index_vectors(), np.zeros((BUCKETS, DIM), np.float64)
    for batch in pieces(batches):
        w = scan(*utf8(batch.column("text")))
        if not len(w.name):
            continue
        buckets, back = featured(w)
        own = index[buckets].sum(axis=1)
        texts, context = text_of(w.first), np.zeros((len(back), DIM), np.float32)
        for k in range(1, REACH + 1):
            same = (texts[k:] == texts[:-k])[:, None]
            context[k:] += own[back[:-k]] * same
            context[:-k] += own[back[k:]] * same
        order = np.argsort(back, kind="stable")
        per_word = np.add.reduceat(context[order], np.flatnonzero(np.concatenate([[True], np.diff(back[order]) > 0])), axis=0)
        for k in range(3):
            np.add.at(sums, buckets[:, k], per_word)
    yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in np.split(sums, BLOCKS)], pa.binary())], ["block", "sums"])


def pooled(w: Words, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of a text's word vectors, how alike words one and two apart are, and log of the length; zeros for no words."""
    n = len(w.first) - 1
    out = np.zeros((n, POOLED), np.float32)
    if not len(w.name):
        return out
    buckets, back = featured(w)
    per_word = vectors[buckets].sum(axis=1)
    some = np.flatnonzero(np.diff(w.first))
    count = np.diff(w.first)[some][:, None]
    mean = np.add.reduceat(per_word[back], w.first[some], axis=0) / count
    square = np.add.reduceat((per_word * per_word)[back], w.first[some], axis=0) / count
    texts, near = text_of(w.first), np.zeros((len(back), 3), np.float32)
    near[1:, 0] = (back[1:] == back[:-1]) & (texts[1:] == texts[:-1])
    near[2:, 1] = (back[2:] == back[:-2]) & (texts[2:] == texts[:-2])
    near[1:, 2] = np.einsum("ij,ij->i", per_word[back[1:]], per_word[back[:-1]]) * (texts[1:] == texts[:-1])
    alike = np.add.reduceat(near, w.first[some], axis=0) / count
    out[some] = np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0)), alike, np.log1p(count)], axis=1)
    return out


class Model:
    """Word vectors, the scale of the features, the network's weights and its temperature."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors, self.layers, self.temperature, self.constant = vectors, None, 1.0, 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Model:
        if not len(y) or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.5
            return self
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(y))
        held, used = order[: len(y) // 10], order[len(y) // 10 :]
        mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        z = (x - mean) / scale
        for _ in range(EPOCHS):
            rng.shuffle(used)
            for at in range(0, len(used), 128):
                rows = used[at : at + 128]
                h = np.tanh(z[rows] @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[rows]) / len(rows)
                back = np.outer(g, p[2]) * (1 - h * h)
                grads = [z[rows].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ g + DECAY * p[2], g.sum(keepdims=True)]
                t += 1
                for k, grad in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.layers = (mean, scale, *p)
        if len(held):
            logits = self.logits(x[held])
            loss = lambda u: np.logaddexp(0, -np.where(y[held] > 0, 1, -1) * logits / u).sum()
            self.temperature = float(min(np.exp(np.linspace(-1.5, 2.5, 81)), key=loss))
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = stage(labels.where(F.col("quality").isNotNull() & learnable(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") > 0).cast("int").alias("y")))
    # the hint's side has about ``sample`` rows whatever the input
    drawn = known.where(draw(F.col("_id"), SEED) * max(known.count(), 1) < sample)
    rows = stage(docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y"))
    drop(known)

    def add(part: pd.DataFrame) -> pd.DataFrame:
        whole = np.sum([np.frombuffer(x) for x in sorted(part["sums"])], axis=0)
        return pd.DataFrame({"block": part["block"].iloc[:1], "sums": [whole.tobytes()]})

    schema = "block int, sums binary"
    sums = sorted(rows.select("text").repartition(PARTS).mapInArrow(context_sums, schema).groupBy("block").applyInPandas(add, schema).collect())
    context = np.concatenate([np.frombuffer(r["sums"]).reshape(-1, DIM) for r in sums]) if sums else np.zeros((BUCKETS, DIM))
    vectors = (context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = pooled(scan(*utf8(batch.column("text"))), vectors)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    found = sorted(rows.mapInArrow(features, "doc_id long, y int, x binary").collect())
    drop(rows)
    x = np.asarray([np.frombuffer(r["x"], np.float32) for r in found]).reshape(len(found), POOLED)
    return Model(vectors).fit(x.astype(np.float64), np.asarray([r["y"] for r in found], np.float64))


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` (with ``text`` read for the score) and the score as ``name``, which must be none of them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)
    fields = [docs.schema[c] for c in keep]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches):
            scores = model.scores(pooled(scan(*utf8(batch.column("text"))), model.vectors))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(np.asarray(scores, np.float64))], [*(f.name for f in fields), name])

    read = docs.select(*[docs[f"`{c}`"] for c in dict.fromkeys([*keep, "text"])])
    return read.mapInArrow(each, StructType([*fields, StructField(name, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = score(docs, train(docs, labels, sample), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that the classifier does not reject."""
    name = fresh(docs, "score")
    found = score(docs, train(docs, labels, sample), docs.columns, name)
    return found.where(F.col(f"`{name}`") >= THRESHOLD).drop(name)
