"""Substring dedup by recompression: words of a long run that an earlier document has too are removed.

Recompression rewrites a text in rounds: runs of an equal symbol become one symbol, then pairs of a
left and a right symbol (by a bit of their names) become one. A symbol's name is a function of what it
replaces, so it is one name in the whole corpus, and equal substrings get equal symbols except at their
ends. With each symbol go the words that its being there depends on: wherever these words recur, so does
the symbol. Its key is a name of all these words.

Spark works from the highest round down. First, symbols of round HIGH, whose words are some dozens, are
grouped by their keys over all documents; each that two documents share is a long repeat, and in all but
its first document the whole range of words that it depends on goes, with all windows in it: long
repeats are settled by few rows, however many documents hold them. What is left are windows of WIDTH
words that no such symbol covers, short repeats and the ends of long ones. These are revealed by the symbols
inside them: a window's key is that of its highest symbol, of round LOW or below, that depends on none but its words (of
several the least), so equal windows have equal keys and neighbours mostly share one. Windows whose key two documents
share are compared by names of all their words, and one goes if the least document that has it comes before.
The least document of a window never loses it to a symbol, so leaving covered windows out loses no link.

Keys of symbols that remove words, and windows' names, are 96 bits of two independent hashes over words' 64-bit names. Among
10^13 of them the chance of any wrong link is below 10^-3; two words of one 64-bit name matter only
where twelve words beside them are equal. Words are not compared again.

A document equal as a whole to an earlier one is settled by its digest: all of it goes if it holds a
window, and it reveals nothing. Keys are pre-aggregated to their least and largest document before a shuffle. What
they are joined back to is a written table of one row a key: broadcast up to a checked number of rows, and beyond it
a sort-merge join right on two shuffles, which Spark splits where a key is hot, after rows that meet nothing are sieved out
by a bitmap of fixed size. Texts that share no key, and those that lose no word, are not shuffled but for its false positives.

Defined results: null text has no words; a null doc_id neither loses words nor takes any from others;
rows of equal id never take words from each other, and each has its own result; texts under WIDTH words stay; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm.sieve import marked, met, sieved
from cinderlog.llm.stages import bounded_batches, drop, release_shuffles, small, stage
from cinderlog.llm.words import Words, mix64, pieces, scan, text_of, utf8, window_names

#: Symbols of round HIGH settle long repeats, those of rounds up to LOW reveal windows.
WIDTH, LOW, HIGH = 13, 2, 6
#: Tables of keys and ids are broadcast up to so many rows, some 16 MB.
MOST_KEYS = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(2**64 - 1)


def rounds_of(name: np.ndarray, first: np.ndarray, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """After each round: the symbols' names, and the words [from, to) that each depends on; a symbol that depends on a text's end has a range beyond it."""
    n = len(name)
    texts = text_of(first)
    symbol, owner, low, high = name, texts, np.arange(n), np.arange(n) + 1
    for k in range(rounds):
        if not len(symbol):
            return
        # runs: what stands beside a run decides where it ends
        new = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (owner[1:] != owner[:-1])])
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate([start, [len(symbol)]]))
        stop = start + size - 1
        left = np.concatenate([[True], owner[start][1:] != owner[start][:-1]])
        right = np.concatenate([owner[start][1:] != owner[start][:-1], [True]])
        edge_low = np.where(left, -WIDTH * 4, low[np.maximum(start - 1, 0)])
        edge_high = np.where(right, n + WIDTH * 4, high[np.minimum(stop + 1, len(symbol) - 1)])
        run_low, run_high = low[start], high[stop]
        symbol, owner = mix64(symbol[start] * _STEP + size.astype(np.uint64) + np.uint64(k)), owner[start]
        run_low, run_high = np.minimum(run_low, edge_low), np.maximum(run_high, edge_high)
        # pairs: a left symbol joins the right symbol after it
        is_left = (symbol >> np.uint64(40 + k)) & np.uint64(1) == 0
        joins = np.zeros(len(symbol), bool)
        joins[:-1] = is_left[:-1] & ~is_left[1:] & ~right[:-1]
        second = np.concatenate([[False], joins[:-1]])
        after, before = np.minimum(np.arange(len(symbol)) + 1, len(symbol) - 1), np.maximum(np.arange(len(symbol)) - 1, 0)
        pair = mix64(symbol * _STEP + mix64(symbol[after]))
        new_low = np.where(joins | is_left, run_low, np.where(left, -WIDTH * 4, np.minimum(run_low, run_low[before])))
        new_high = np.where(joins, run_high[after], np.where(is_left, np.where(right, n + WIDTH * 4, np.maximum(run_high, run_high[after])), run_high))
        symbol = np.where(joins, pair, symbol)[~second]
        owner, low, high = owner[~second], new_low[~second], new_high[~second]
        yield symbol, low, high


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, by 64 bits, up to the n-th."""
    if base not in _powers or len(_powers[base][0]) <= n:
        most = 1 << max(16, n.bit_length())
        _powers[base] = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(most, np.uint64(b)))]) for b in (base, pow(base, -1, 2**64)))
    return _powers[base]


class Ranges:
    """Names of ranges of words, each in two subtractions."""

    def __init__(self, name: np.ndarray, seed: int) -> None:
        base = (seed * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) % 2**64 | 1
        up, self.down = _power(base, len(name) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(name + np.uint64(seed)) * up[: len(name)])])

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix64((self.sums[high] - self.sums[low]) * self.down[low] + (high - low).astype(np.uint64))


def least_in_windows(n: int, low: np.ndarray, high: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """For each window [a, a + width) the least value of the ranges [low, high) inside it. Ranges of one size have different places."""
    steps = max(1, width.bit_length())
    tables = [np.full(n + 2 * width, _NONE) for _ in range(steps)]
    count = width - (high - low) + 1
    # a range lies in the windows that start in [high - width, low]: two blocks of a power of two cover them
    for c in np.unique(count).tolist():
        mine = np.flatnonzero(count == c)
        j = c.bit_length() - 1
        start, table = low[mine] - c + 1 + width, tables[j]
        table[start] = np.minimum(table[start], value[mine])
        start = low[mine] - 2**j + 1 + width
        table[start] = np.minimum(table[start], value[mine])
    for j in range(steps - 1, 0, -1):
        half = 2 ** (j - 1)
        tables[j - 1] = np.minimum(tables[j - 1], tables[j])
        tables[j - 1][half:] = np.minimum(tables[j - 1][half:], tables[j][:-half])
    return tables[0][width : width + n]


def windows_of(w: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows, and the text of each."""
    n, texts = len(w.name), text_of(w.first)
    at = np.flatnonzero(texts[: n - width + 1] == texts[width - 1 :]) if n >= width else np.zeros(0, np.int64)
    return at, texts[at]


class Symbols(NamedTuple):
    """``at``/``owner``/``key``: windows, the text of each and its key. ``low``/``high``/``name``: ranges and keys of symbols of the highest round, in order."""

    at: np.ndarray
    owner: np.ndarray
    key: np.ndarray
    low: np.ndarray
    high: np.ndarray
    name: np.ndarray
    check: np.ndarray


def symbols_of(w: Words, width: int = WIDTH, lowest: int = LOW, highest: int = HIGH) -> Symbols:
    n, ranges = len(w.name), Ranges(w.name, 31)
    at, owner = windows_of(w, width)
    none = np.zeros(0, np.int64)
    low, high, values = [none], [none], [none.astype(np.uint64)]
    top = none, none
    for k, (_, lo, hi) in enumerate(rounds_of(w.name, w.first, max(lowest, highest)), 1):
        if k == highest:
            fits = (lo >= 0) & (hi <= n) & (hi - lo >= width)
            # one range may hold several symbols
            fits[1:] &= (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            top = lo[fits], hi[fits]
        if k <= lowest and len(at):
            fits = (lo >= 0) & (hi <= n) & (hi - lo <= width)
            lo, hi = lo[fits], hi[fits]
            # the highest round has the least values, so that it wins
            values.append(ranges(lo, hi) >> np.uint64(2) | np.uint64((lowest - k) % 4 << 62))
            low.append(lo)
            high.append(hi)
    key = at.astype(np.uint64)
    if len(at):
        each = [least_in_windows(n, *_distinct(lo, hi, v), width) for lo, hi, v in zip(low, high, values, strict=True) if len(lo)]
        key = np.minimum.reduce(each)[at] if each else np.full(len(at), _NONE)
        bare = key == _NONE
        key[bare] = ranges(at[bare], at[bare] + width)
    return Symbols(at, owner, key, *top, ranges(*top), (Ranges(w.name, 57)(*top) >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _distinct(low: np.ndarray, high: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each range once."""
    _, at = np.unique(low * 64 + (high - low), return_index=True)
    return low[at], high[at], value[at]


def _changes(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each text without those that equal the one before."""
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]) if len(key) else np.zeros(0, bool)
    return owner[new], key[new]


def _lists(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), pa.array(values))


def reveal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, nth, and the keys of the text's high symbols (two parts) and windows."""
    for batch in pieces(batches):
        w = scan(*utf8(batch.column("text")))
        s = symbols_of(w)
        owner, key = _changes(s.owner, s.key)
        top, n = text_of(w.first)[s.low], batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("nth"), _lists(s.name.view(np.int64), top, n), _lists(s.check, top, n), _lists(key.view(np.int64), owner, n)], ["doc_id", "nth", "highs", "checks", "lows"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each; null is empty."""
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    return np.asarray(column.flatten(), np.int64), np.repeat(np.arange(len(column)), lengths)


def _among(key: np.ndarray, owner: np.ndarray, column: pa.Array) -> np.ndarray:
    """Whether a key is in its text's list."""
    listed, row = _flat(column)
    return np.isin(mix64(key + mix64(owner.astype(np.uint64))), mix64(listed.view(np.uint64) + mix64(row.astype(np.uint64))))


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, nth (text of that id), place and size (in words), and a name of 96 bits in two parts: windows whose key is shared. Without a name: ranges that go."""
    for batch in pieces(batches):
        w = scan(*utf8(batch.column("text")))
        s, texts, n = symbols_of(w), text_of(w.first), len(w.name)
        ids, nth = np.asarray(batch.column("doc_id").fill_null(0), np.int64), np.asarray(batch.column("nth"), np.int32)
        gone = _among(s.name, texts[s.low], batch.column("highs"))
        covered, inside = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        np.add.at(covered, s.low[gone], 1)
        np.add.at(covered, s.high[gone], -1)
        np.add.at(inside, s.low[gone], 1)
        np.add.at(inside, s.high[gone] - WIDTH + 1, -1)
        goes, settled = np.cumsum(covered)[:n] > 0, np.cumsum(inside)[:n] > 0
        # ranges of one text in a row are one
        edge = np.concatenate([[True], (goes[1:] != goes[:-1]) | (texts[1:] != texts[:-1])]) if n else np.zeros(0, bool)
        start = np.flatnonzero(edge)
        size = np.diff(np.concatenate([start, [n]]))
        start, size = start[goes[start]], size[goes[start]]
        some = _among(s.key, s.owner, batch.column("lows")) & ~settled[s.at]
        at = s.at[some]
        h1, h2 = (window_names(w.name, WIDTH, seed)[at].view(np.int64) if len(at) else np.zeros(0, np.int64) for seed in (21, 22))
        place = np.concatenate([start, at])
        row = texts[place]
        named = np.concatenate([np.zeros(len(start), bool), np.ones(len(at), bool)])
        names = [pa.array(np.concatenate([np.zeros(len(start), x.dtype), x]), mask=~named) for x in (h1, (h2 >> 32).astype(np.int32))]
        sizes = np.concatenate([size, np.full(len(at), WIDTH)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(nth[row]), pa.array((place - w.first[row]).astype(np.int32)), pa.array(sizes), *names], ["doc_id", "nth", "place", "size", "h1", "h2"])


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, n_removed and the kept words joined by a space."""
    for batch in pieces(batches):
        w = scan(*utf8(batch.column("text")), named=False)
        n = np.diff(w.first)
        (place, row), (size, _) = _flat(batch.column("places")), _flat(batch.column("sizes"))
        cover = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(cover, w.first[row] + place, 1)
        np.add.at(cover, w.first[row] + place + size, -1)
        gone = np.cumsum(cover)[: len(w.start)] > 0
        whole = np.asarray(batch.column("copy").fill_null(False)) & (n >= WIDTH)
        gone |= np.repeat(whole, n)
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[w.first[1:]] - total[w.first[:-1]]
        kept = ~gone
        # kept words, each followed by a space, cut out of the bytes at once
        length = (w.end - w.start)[kept] + 1
        out = np.full(int(length.sum()), 0x20, np.uint8)
        began = np.cumsum(length) - length
        place = np.arange(len(out)) - np.repeat(began, length)
        inner = place < np.repeat(length - 1, length)
        out[inner] = w.data[(np.repeat(w.start[kept], length) + place)[inner]]
        ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(kept)])[w.first]]
        raw = out.tobytes()
        texts = [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every document."""
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long"), "text")
    bounded_batches(spark)
    digests = stage(read.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest")))
    # texts of an id that has several are numbered; all others are number 0
    several = digests.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("doc_id")
    order = Window.partitionBy("doc_id").orderBy("digest")
    numbers = stage(digests.join(several, "doc_id", "left_semi").distinct().withColumn("nth", F.row_number().over(order) - 1))
    least = small(stage(digests.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("digest", "lo")), MOST_KEYS)
    copied = digests.join(least, "digest").where("lo < doc_id").join(numbers, ["doc_id", "digest"], "left")
    copies = small(stage(copied.select("doc_id", F.coalesce("nth", F.lit(0)).alias("nth"), F.lit(True).alias("copy")).distinct()), MOST_KEYS)
    read = read.withColumn("nth", F.lit(0)) if numbers.isEmpty() else read.withColumn("digest", F.sha2("text", 256)).join(numbers, ["doc_id", "digest"], "left").select("doc_id", "text", F.coalesce("nth", F.lit(0)).alias("nth"))
    drop(digests)

    keyed = stage(read.where("doc_id IS NOT NULL").mapInArrow(reveal, "doc_id long, nth int, highs array<long>, checks array<int>, lows array<long>"))
    live = keyed.join(copies, ["doc_id", "nth"], "left_anti")
    ends = F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")
    symbols = live.select("doc_id", "nth", F.explode(F.arrays_zip(F.col("highs").alias("key"), F.col("checks").alias("check"))).alias("x")).select("doc_id", "nth", "x.key", "x.check")
    shared = small(stage(symbols.groupBy("key", "check").agg(*ends).where("lo < hi").select("key", "check", "lo")), MOST_KEYS)
    release_shuffles(spark)
    highs = stage(met(symbols, shared, ["key", "check"]).where("lo < doc_id").groupBy("doc_id", "nth").agg(F.collect_set("key").alias("highs")))
    drop(shared)
    windows = live.select("doc_id", "nth", F.explode("lows").alias("key"))
    shared = small(stage(windows.groupBy("key").agg(*ends).where("lo < hi").select("key")), MOST_KEYS)
    release_shuffles(spark)
    lows = met(windows, shared, ["key"]).groupBy("doc_id", "nth").agg(F.collect_set("key").alias("lows"))
    per_doc = stage(lows.join(highs, ["doc_id", "nth"], "left"))
    drop(shared, highs, keyed)
    release_shuffles(spark)

    asked = sieved(read, per_doc, ["doc_id"]).join(per_doc, ["doc_id", "nth"]).select("doc_id", "nth", "text", "highs", "lows")
    found = stage(asked.mapInArrow(candidates, "doc_id long, nth int, place int, size int, h1 long, h2 int"))
    drop(per_doc)
    release_shuffles(spark)

    windows = found.where("h1 IS NOT NULL")
    owners = small(stage(windows.groupBy("h1", "h2").agg(*ends).where("lo < hi").select("h1", "h2", "lo")), MOST_KEYS)
    cuts = met(windows, owners, ["h1", "h2"]).where("lo < doc_id").select("doc_id", "nth", "place", "size")
    later = stage(cuts.union(found.where("h1 IS NULL").select("doc_id", "nth", "place", "size")).groupBy("doc_id", "nth").agg(F.collect_list(F.struct("place", "size")).alias("cuts")))
    drop(found, owners)
    release_shuffles(spark)
    changes = stage(copies.join(later, ["doc_id", "nth"], "full_outer"))
    drop(later, copies)
    # only texts that may lose words meet their cuts; all others stay where they are read
    tested = marked(read, changes, ["doc_id"])
    cut = tested.where("_may").join(changes, ["doc_id", "nth"], "left").select("doc_id", "text", F.col("cuts.place").alias("places"), F.col("cuts.size").alias("sizes"), "copy")
    uncut = tested.where("NOT _may").select("doc_id", "text", *[F.lit(None).cast(cut.schema[c].dataType).alias(c) for c in ("places", "sizes", "copy")])
    return cut.union(uncut).mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string")
