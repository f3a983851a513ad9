"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the largest capacity are cut into pieces of it; each of these full pieces fills
a bin of its own. What is left, one piece a document at most, is dealt by a hash of id, size and
number (among rows of equal id and size) into shards of about SHARD_DOCS pieces, so no task holds
more whatever the input's size or keys, and the result is the same for every layout of the table.
Within a shard, pieces go in descending size to the open bin with the least room that still fits; if
none does, the bin of least cost per expected token is opened, over all permitted lengths jointly; at
the end each bin is downsized to the least permitted length that holds its contents. Sizes are words,
or what a caller's ``size`` column counts (tokens, say).

Defined results: an empty or null text has one piece of size 0 and no bin (null bin_id, bin_length,
bin_offset); equal rows are packed separately; an empty table gives an empty result; null doc_ids
are packed like others; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.mixing import word_count
from cinderlog.llm.stages import stage

LENGTHS = (512, 1024, 2048, 4096)
#: Pieces dealt to a shard, about; a shard's packing is one task's work. Rows of equal id and size are dealt in ranges of BLOCK.
SHARD_DOCS, BLOCK = 20_000, 256
SCHEMA = "doc_id long, piece int, piece_size long, bin_id string, bin_length long, bin_offset long"


def cost(length: int, longest: int) -> float:
    """Of a sequence: a part in proportion to its length and a part to its square, as attention has."""
    return length * (1 + length / (4 * longest))


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size (sizes of 1 to the largest length), and the final length of each bin."""
    lengths = sorted(lengths)
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable")
    ranked = np.asarray(sizes, np.int64)[order]
    ascending = ranked[::-1]
    below = np.concatenate([[0], np.cumsum(ascending)])
    bins, offsets, filled, opened = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), [], []
    rooms: list[tuple[int, int]] = []
    for i, (at, size) in enumerate(zip(order.tolist(), ranked.tolist(), strict=True)):
        k = bisect_left(rooms, (size, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            left = len(ranked) - i - 1
            def per_token(length: int) -> tuple[float, int]:
                fits = min(left, bisect_right(ascending, length - size))
                return cost(length, lengths[-1]) / min(length, size + int(below[fits])), length
            room = min(per_token(x) for x in lengths if x >= size)[1]
            b = len(filled)
            filled.append(0)
            opened.append(room)
        bins[at], offsets[at] = b, filled[b]
        filled[b] += size
        if room > size:
            insort(rooms, (room - size, b))
    final = np.asarray([lengths[bisect_left(lengths, x)] for x in filled], np.int64)
    return bins, offsets, final


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, shard_docs: int = SHARD_DOCS, size: Column | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, piece, piece_size, bin_id, bin_length, bin_offset, in words or in the unit of ``size``."""
    longest = max(lengths)
    n, k = F.col("n"), F.col("k")
    size = word_count(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n")).groupBy("doc_id", "n").agg(F.count("*").alias("c"))
    # rows of equal id and size are told apart by number only, and travel as ranges of up to BLOCK numbers
    blocks = counted.select("doc_id", "n", "c", F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / BLOCK))).alias("b"))
    blocks = stage(blocks.select("doc_id", "n", (F.col("b") * BLOCK).alias("at"), F.least(F.lit(BLOCK), F.col("c") - F.col("b") * BLOCK).alias("k")))
    each = lambda df: df.select("doc_id", "n", F.explode(F.sequence(F.col("at"), F.col("at") + k - 1)).alias("nth"))
    none = F.lit(None).cast("long")
    empty = each(blocks.where(n == 0)).select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("piece_size"), F.lit(None).cast("string").alias("bin_id"), none.alias("bin_length"), none.alias("bin_offset"))
    whole = each(blocks.where(n >= longest)).select("doc_id", "n", "nth", F.explode(F.sequence(F.lit(0), (F.floor(n / longest) - 1).cast("int"))).alias("piece"))
    own = F.concat_ws("-", F.lit("own"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), n.cast("string"), F.col("nth").cast("string"), F.col("piece").cast("string"))
    whole = whole.select("doc_id", "piece", F.lit(longest).cast("long").alias("piece_size"), own.alias("bin_id"), F.lit(longest).cast("long").alias("bin_length"), F.lit(0).cast("long").alias("bin_offset"))
    rest = blocks.where(n % longest > 0)
    shards = max(1, -(-(rest.agg(F.sum("k")).first()[0] or 0) // shard_docs))
    dealt = rest.select("doc_id", F.floor(n / longest).cast("int").alias("piece"), (n % longest).alias("piece_size"), "n", "at", "k", F.pmod(F.xxhash64("doc_id", "n", "at"), F.lit(shards)).alias("shard"))

    def one(shard: pd.DataFrame) -> pd.DataFrame:
        # the order in which rows arrive must not matter
        shard = shard.sort_values(["piece_size", "doc_id", "n", "at"], kind="stable", ignore_index=True)
        out = shard.loc[shard.index.repeat(shard["k"]), ["doc_id", "piece", "piece_size"]].reset_index(drop=True)
        bins, offsets, final = best_fit(out["piece_size"].to_numpy(), lengths)
        out["bin_id"] = [f"{shard['shard'].iloc[0]}-{b}" for b in bins.tolist()]
        out["bin_length"], out["bin_offset"] = final[bins], offsets
        return out.astype({"doc_id": "Int64"})

    return dealt.groupBy("shard").applyInPandas(one, SCHEMA).union(whole).union(empty)
