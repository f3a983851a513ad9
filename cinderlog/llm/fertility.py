"""Quality rules: plain counts, and how well public tokenisers' vocabularies fit a text.

Words are encoded one by one as ``" word"`` with a piece vocabulary that falls back to bytes and
with a byte-level vocabulary; each distinct word of a batch is encoded once. Per document this
gives characters per token (both), the share of byte-fallback tokens, and the entropy of its
tokens relative to the most that so many tokens can have. A text is rejected if one of these lies
outside the band of its group: language (script, where lang is null) and order of magnitude of
tokens. Where fewer than ``MIN_GROUP`` texts that are not base_failed make up that group, the band is that of
the first wider one with so many: the language's texts of 2, of 4 and of all orders of magnitude, the script's
of this order and of all, and else all texts, however few. A band has two ends, LOW interquartile ranges
below the median and HIGH above (clean text strays more upward, by long words and rich vocabulary); only the
share of byte fallbacks has no lower end, as none is what a vocabulary is for. Quartiles are exact ranks of
measures in steps of 1/STEP, counted over all documents: the same for every layout and order of the table.

Defined results: null or empty text counts 0 everywhere and is base_failed; where every text is
base_failed there is no band and all are fertile; equal rows get equal results; a null doc_id is
carried; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm.stages import bounded_batches, drop, small, stage
from cinderlog.llm.words import pieces, scan, text_of, utf8, window_names

TOKENIZERS = "/opt/tokenizers"
PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: A band ends so many interquartile ranges off the median, each at least LEAST of the median.
LOW, HIGH, LEAST, MIN_GROUP, MOST_GROUPS, STEP = 2.0, 4.0, 0.05, 50, 50_000, 1024
ALL = "all"
METRICS = ("piece_chars", "byte_chars", "fallback", "entropy")
SCHEMA = "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, piece_chars double, byte_chars double, fallback double, entropy double"
#: First code points of blocks, and the scripts of what follows them: fixed values.
SCRIPTS = ((0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"))
KEPT_WORDS = 400_000

_is_symbol = np.zeros(256, bool)
_is_symbol[list(SYMBOLS)] = True


class Encoder:
    """Tokens of words, remembered up to KEPT_WORDS distinct ones."""

    def __init__(self, folder: str) -> None:
        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECES))
        with open(os.path.join(folder, BYTES), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = tiktoken.Encoding("byte", pat_str=r"\s?\S+", mergeable_ranks=ranks, special_tokens={})
        self.size = self.piece.vocab_size()
        self.fallback = np.asarray([self.piece.is_byte(i) for i in range(self.size)])
        self.kept: dict[int, tuple[list[int], int]] = {}

    def words(self, names: list[int], words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of all words in a row, their number per word, and the number of byte-level tokens per word."""
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        new = [i for i, name in enumerate(names) if name not in self.kept]
        if new:
            texts = [words[i].decode("utf-8", "replace") for i in new]
            for i, ids, text in zip(new, self.piece.encode(texts, num_threads=1), texts, strict=True):
                self.kept[names[i]] = ids, len(self.byte.encode_ordinary(" " + text))
        found = [self.kept[name] for name in names]
        counts = np.fromiter((len(x[0]) for x in found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(x[0] for x in found), np.int64, int(counts.sum()))
        return ids, counts, np.fromiter((x[1] for x in found), np.int64, len(found))


_encoder: dict[str, Encoder] = {}


def _sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive ranges, empty ones included."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_words(name: np.ndarray, first: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words per text in windows that the text has twice or more."""
    n, texts = len(name), text_of(first)
    if n < width:
        return np.zeros(len(first) - 1, np.int64)
    whole = np.flatnonzero(texts[: n - width + 1] == texts[width - 1 :])
    windows = window_names(name, width, 1)[whole]
    order = np.lexsort((windows, texts[whole]))
    same = (windows[order][1:] == windows[order][:-1]) & (texts[whole][order][1:] == texts[whole][order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = whole[order[twice]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return _sum(np.cumsum(cover[:-1]) > 0, first)


def repeated_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    filled = [x for x in text.split(b"\n") if x.strip(b"\t\n\x0b\x0c\r ")]
    seen.update(filled)
    return len(filled) - len(seen)


def _scripts(data: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The commonest script of a text's letters beyond ASCII, else latin."""
    out = []
    names = [s for _, s in SCRIPTS]
    starts = np.asarray([c for c, _ in SCRIPTS])
    plain = np.concatenate([[0], np.cumsum(data >= 0xC0, dtype=np.int64)])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if plain[b] == plain[a]:
            out.append("latin")
            continue
        points = np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        kinds = np.bincount(np.searchsorted(starts, points[points > 0x20], "right") - 1, minlength=len(starts))
        by_name: dict[str, int] = {}
        for name, k in zip(names, kinds.tolist(), strict=True):
            by_name[name] = by_name.get(name, 0) + k
        out.append(max(sorted(by_name), key=lambda s: by_name[s]))
    return out


def measure(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    if folder not in _encoder:
        _encoder[folder] = Encoder(folder)
    encoder = _encoder[folder]
    for batch in pieces(batches):
        data, bounds = utf8(batch.column("text"))
        w = scan(data, bounds)
        n_words = np.diff(w.first)
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, w.start, 1)
        np.add.at(inside, w.end, -1)
        points = (np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80)
        word_chars = _sum(points, bounds)
        names, at, back = np.unique(w.name, return_index=True, return_inverse=True)
        raw = data.tobytes()
        ids, counts, byte_counts = encoder.words(names.tolist(), [raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
        began = np.cumsum(counts) - counts
        per_word = counts[back]
        n_tokens, n_bytes = _sum(per_word, w.first), _sum(byte_counts[back], w.first)
        fallback, entropy = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        for d in range(batch.num_rows):
            n = n_tokens[d]
            if not n:
                continue
            words = back[w.first[d] : w.first[d + 1]]
            lengths = counts[words]
            tokens = ids[np.arange(n) + np.repeat(began[words] - (np.cumsum(lengths) - lengths), lengths)]
            fallback[d] = encoder.fallback[tokens].mean()
            found = np.bincount(tokens)
            found = found[found > 0]
            entropy[d] = (np.log2(n) - (found * np.log2(found)).sum() / n) / np.log2(min(n, encoder.size)) if n > 1 else 1.0
        some = np.maximum(n_tokens, 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), pa.array(_scripts(data, bounds)), *(pa.array(x.astype(np.int64)) for x in (n_words, word_chars, _sum(_is_symbol[data], bounds))),
             pa.array([repeated_lines(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.int64()), pa.array(repeated_words(w.name, w.first)), pa.array(n_tokens),
             pa.array(word_chars / some), pa.array(word_chars / np.maximum(n_bytes, 1)), pa.array(fallback), pa.array(entropy)],
            ["doc_id", "lang", "script", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", *METRICS],
        )


def groups() -> Column:
    """Names of the groups of a measured text, narrowest first."""
    octave = F.floor(F.log2(F.greatest("n_tokens", F.lit(1))))
    who = F.coalesce(F.concat(F.lit("lang-"), F.col("lang")), F.concat(F.lit("script-"), F.col("script")))
    sized = lambda of, width: F.concat(F.lit(f"{width}x"), F.floor(octave / width).cast("string"), F.lit(":"), of)
    script = F.concat(F.lit("any-"), F.col("script"))
    return F.array(sized(who, 1), sized(who, 2), sized(who, 4), who, sized(script, 1), script, F.lit(ALL))


def quartiles(rows: DataFrame) -> DataFrame:
    """Rows (band, METRICS) to one row a band: texts, and of each metric the array of its three quartiles, in steps of 1/STEP."""
    steps = F.array(*[F.struct(F.lit(i).alias("metric"), F.floor(F.col(m) * STEP).cast("long").alias("step")) for i, m in enumerate(METRICS)])
    counts = rows.select("band", F.explode(steps).alias("x")).groupBy("band", "x.metric", "x.step").agg(F.count("*").alias("n"))
    # windows run over one row a step, not a text
    of = Window.partitionBy("band", "metric")
    upto = of.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("texts", F.sum("n").over(of))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("texts") * q), F.col("step"))) / F.lit(float(STEP))
    each = ranked.groupBy("band", "metric").agg(F.max("texts").alias("texts"), F.array(at(0.25), at(0.5), at(0.75)).alias("q"))
    return each.groupBy("band").agg(F.max("texts").alias("texts"), *[F.max(F.when(F.col("metric") == i, F.col("q"))).alias(f"q_{m}") for i, m in enumerate(METRICS)])


def judge(docs: DataFrame, folder: str = TOKENIZERS, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Counts, measures, base_failed, fertile (within its bands) and kept of every document."""
    bounded_batches(docs.sparkSession)
    read = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    measured = stage(read.mapInArrow(lambda b: measure(b, folder), SCHEMA))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = measured.withColumn("base_failed", failed).withColumn("of", groups())
    bands = quartiles(rows.where("NOT base_failed").select(F.explode("of").alias("band"), *METRICS))
    bands = stage(bands.where((F.col("texts") >= MIN_GROUP) | (F.col("band") == ALL)))
    # one row for each list of groups: the band of the first that has one
    lists = rows.select("of").distinct().select("of", F.posexplode("of").alias("nth", "band"))
    held = lists.join(small(bands, MOST_GROUPS), "band").groupBy("of").agg(*[F.min_by(f"q_{m}", "nth").alias(f"q_{m}") for m in METRICS])
    held = stage(held.withColumnRenamed("of", "key"))
    drop(bands)
    inside = F.lit(True)
    for m in METRICS:
        q = F.col(f"q_{m}")
        width = F.greatest(q[2] - q[0], F.abs(q[1]) * LEAST, F.lit(0.01))
        inside = inside & (F.col(m) <= q[1] + high * width)
        if m != "fallback":
            inside = inside & (F.col(m) >= q[1] - low * width)
    joined = rows.join(small(held, MOST_GROUPS), F.col("of") == F.col("key"), "left")
    fertile = F.col("key").isNull() | inside
    return joined.withColumn("fertile", fertile).withColumn("kept", ~F.col("base_failed") & fertile).drop("of", "key", *[f"q_{m}" for m in METRICS])
