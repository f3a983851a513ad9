"""Language identification by hyperdimensional profiles.

Each letter (a code point, lower-cased) has a random vector of +1 and -1, drawn from a seed and its
number, so every script has as many symbols as letters. An n-gram is bound as the product of its letters'
vectors, each permuted (rolled) by its place; a text is the bundle (sum) of its n-grams' vectors,
a language the bundle of its training texts, and a text's language is the prototype of largest
cosine. Counting n-grams first turns bundling into products of matrices, in blocks of BLOCK n-grams.

Letters and the marks that combine with them make words; all else is one separator. Training takes at most about
``PER_LANGUAGE`` texts of each language, drawn by a hash of the id, from documents whose fold is
learnable and whose lang is known; prototypes (one vector a language) are all that reaches the
driver.

Defined results: null, empty or letterless texts are ``und`` with score 0, as are all texts if no
language was learned; ties go to the first language by code point; equal rows get equal results;
extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.sampling import draw, held_out, learnable
from cinderlog.llm.stages import bounded_batches, drop, small, stage
from cinderlog.llm.words import pieces, utf8

WIDTH, DIM, SEED, UNKNOWN = 3, 1024, 20240, "und"
PER_LANGUAGE, PARTS, ROWS, BLOCK = 2_000, 16, 512, 8_192
#: n-grams of so many codes are numbered by a table, others by a sort.
TABLE = 1 << 20
#: Letters' vectors that a worker remembers.
KEPT = 20_000

_folded: dict[int, int] = {}
_vectors: dict[tuple[int, int], np.ndarray] = {}


def folded(points: np.ndarray) -> np.ndarray:
    """Of each code point its letter's (in lower case) or mark's number; 0 for what is neither."""
    for c in points.tolist():
        if c not in _folded:
            x = chr(c)
            _folded[c] = ord(x.lower()[0]) if unicodedata.category(x)[0] in "LM" else 0
    return np.asarray([_folded[c] for c in points.tolist()], np.int64)


def letter_vectors(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """(letters, dim) of +1 and -1, each row a function of its code point alone."""
    if len(_vectors) > KEPT:
        _vectors.clear()
    for c in points.tolist():
        if (c, dim) not in _vectors:
            _vectors[c, dim] = np.random.default_rng((SEED, c)).integers(0, 2, dim, dtype=np.int8) * np.int8(2) - np.int8(1)
    return np.asarray([_vectors[c, dim] for c in points.tolist()], np.int8).reshape(len(points), dim)


def profiles(data: np.ndarray, bounds: np.ndarray, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """A bundle per text (rows), and whether it has a letter."""
    n = len(bounds) - 1
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = lead[bounds]
    # the batch's own letters are numbered; 0 is the separator
    low = np.flatnonzero(np.bincount(points, minlength=1))
    named = folded(low)
    letters = np.unique(np.concatenate([[0], named]))
    number = np.zeros(int(low[-1]) + 1 if len(low) else 1, np.int64)
    number[low] = np.searchsorted(letters, named)
    s, doc = number[points], np.repeat(np.arange(n), np.diff(first))
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0) | (doc[1:] != doc[:-1])
    s, doc = s[keep], doc[keep]
    lettered = np.bincount(doc[s > 0], minlength=n) > 0
    # a separator before and after each text, so that short words have n-grams too
    ends = np.searchsorted(doc, np.arange(n + 1))
    s, doc = (np.insert(x, np.concatenate([ends[:-1], ends[1:]]), v) for x, v in ((s, 0), (doc, np.concatenate([np.arange(n), np.arange(n)]))))
    order = np.argsort(doc, kind="stable") if len(doc) > 1 and (doc[1:] < doc[:-1]).any() else slice(None)
    s, doc = s[order], doc[order]
    out = np.zeros((n, dim), np.float32)
    if len(s) < WIDTH:
        return out, lettered
    m, base = len(s) - WIDTH + 1, len(letters)
    code = np.zeros(m, np.int64)
    for k in range(WIDTH):
        code = code * base + s[k : k + m]
    fine = (doc[:m] == doc[WIDTH - 1 :]) & (s[1 : m + 1] > 0)
    code, doc = code[fine], doc[:m][fine]
    if base**WIDTH <= TABLE:
        seen = np.flatnonzero(np.bincount(code, minlength=1))
        table = np.zeros(base**WIDTH, np.int64)
        table[seen] = np.arange(len(seen))
        place = table[code]
    else:
        seen, place = np.unique(code, return_inverse=True)
    if len(seen) > BLOCK:
        order = np.argsort(place, kind="stable")
        place, doc = place[order], doc[order]
    vectors = letter_vectors(letters, dim)
    for at in range(0, len(seen), BLOCK):
        grams = seen[at : at + BLOCK]
        a, b = np.searchsorted(place, [at, at + len(grams)]) if len(seen) > BLOCK else (0, len(place))
        counts = np.bincount(doc[a:b] * len(grams) + place[a:b] - at, minlength=n * len(grams)).reshape(n, len(grams)).astype(np.float32)
        bound = np.ones((len(grams), dim), np.int8)
        for k in range(WIDTH):
            bound *= np.roll(vectors[grams // base ** (WIDTH - 1 - k) % base], WIDTH - 1 - k, axis=1)
        out += counts @ bound.astype(np.float32)
    return out, lettered


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes."""
    known = docs.where(F.col("lang").isNotNull() & learnable(F.col("doc_id")) & F.col("text").isNotNull())
    counts = stage(known.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n")))
    drawn = known.select("doc_id", "lang", "text").join(small(counts, 10_000), F.col("lang") == F.col("_lang")).where(draw(F.col("doc_id"), SEED) * F.col("_n") < per_language)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in _batches(batches):
            found, lettered = profiles(*utf8(batch.column("text")), dim)
            langs = np.asarray(batch.column("lang").to_pylist(), object)
            for lang in set(langs[lettered]):
                sums[lang] = sums.get(lang, 0) + _unit(found[lettered & (langs == lang)]).sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["lang", "bundle"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        whole = np.sum([np.frombuffer(x) for x in sorted(part["bundle"])], axis=0)
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "bundle": [whole.tobytes()]})

    schema = "lang string, bundle binary"
    rows = drawn.select("lang", "text").repartition(PARTS).mapInArrow(bundle, schema).groupBy("lang").applyInPandas(add, schema).collect()
    drop(counts)
    rows.sort(key=lambda r: r["lang"])
    vectors = np.asarray([np.frombuffer(r["bundle"]) for r in rows]).reshape(len(rows), dim)
    return [r["lang"] for r in rows], _unit(vectors).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score of every document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = prototypes.shape[1] if len(langs) else 8
        names = np.asarray([*langs, UNKNOWN], object)
        for batch in _batches(batches):
            found, lettered = profiles(*utf8(batch.column("text")), dim)
            if langs:
                cosines = _unit(found) @ prototypes.T
                best = np.where(lettered, cosines.argmax(axis=1), len(langs))
                score = np.where(lettered, np.clip(cosines.max(axis=1), 0, 1), 0.0)
            else:
                best, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score.astype(np.float64))], ["doc_id", "lang_pred", "score"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    langs, prototypes = train(docs, per_language)
    return predict(docs, langs, prototypes).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
