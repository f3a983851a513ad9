"""Words of whole texts as arrays, without a Python loop over words.

A word is a run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 these bytes stand only for
themselves, so this equals ``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cinderlog.llm.stages import give_back

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 500_000
_white = np.zeros(256, bool)
_white[[0x20, *range(0x09, 0x0E)]] = True
_byte = np.random.default_rng(0x5EED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """Words of some texts: ``name`` a 64-bit name of each, ``start``/``end`` byte places in ``data``, ``first`` each text's first word (and the count)."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    bounds: np.ndarray


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1024) - 1, _BASE))])
    return _powers[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def text_bounds(column: pa.Array) -> np.ndarray:
    """Where each text of a string column begins, and the last ends; null is empty."""
    return np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(column).fill_null(0), np.int64))])


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about CHUNK_BYTES of text: memory stays bounded by that or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds = text_bounds(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def scan(data: np.ndarray, bounds: np.ndarray, named: bool = True) -> Words:
    n = len(data)
    inside = ~_white[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, bounds)
    name = np.zeros(len(start), np.uint64)
    if named and len(start):
        lengths = end - start
        total = int(lengths.sum())
        began = np.cumsum(lengths) - lengths
        place = np.arange(total) - np.repeat(began, lengths)
        letters = data[inside]
        name = mix64(np.add.reduceat(_byte[letters] * powers(int(lengths.max()))[place], began) + lengths.astype(np.uint64))
    return Words(name, start, end, first, data, bounds)


def window_names(name: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A name for each run of ``width`` consecutive words in the flat array (the caller drops those that cross texts)."""
    n = len(name) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1)
    out = np.zeros(n, np.uint64)
    salted = mix64(name + np.uint64(seed))
    for k in range(width):
        out = out * step + salted[k : k + n]
    return mix64(out)


def text_of(first: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
