"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of word-shingle multisets, banded, then verified.

A text is the multiset of its runs of ``SHINGLE`` words (a shorter text, its one run of words). Each
shingle has a Poisson process on each dyadic interval of weight, (0, 1], (1, 2], (2, 4], ..., whose
points carry a time, a weight and a register; a text takes the points up to its count, and each of
its ``REGISTERS`` keeps the earliest time. Points are drawn only until no later one can matter, so
the work hardly grows with weights. Two texts agree in a register with the probability of their
weighted Jaccard similarity.

Texts of equal multisets are one class from the start. Among their first texts, those that agree in
a band of ``ROWS`` registers meet in a bucket, and buckets of one pivot (their least document) form a group. Texts of a group
are not compared with each other, but with a centre: the pivot, or, in groups of ``CROWD`` texts
and more, the shingles that most of a sample of the group has. With A(x) for the shingles of x that the
centre lacks, R(x) for the centre's that x lacks, and D(x) for both, two texts differ in
|D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles. First each text is compared, by D, with the text m of
most room: a pair of |x| + |y| shingles may differ in p (|x| + |y|) of them, and the room of x is
p |x| - |D(x)|. That and the following lose no link: two texts that share nothing of D are linked only
if their rooms add up to 0 or more, and then each is linked with m, whose room is no less. So a text too
far from m can only be close to a y with which it shares a part of D(y), whose least size follows from
the sizes of D; and if it shares nothing of A(y), that much of R(y). Such pairs meet at equal elements among the first ones of both
sides (prefix filtering). Elements at which the same texts meet count once. Up to ``FEW`` texts that meet are paired,
if they are not in one component yet, and verified; more are a group again, of a centre and a middle of their own. All
of them have the element they met at, so it is in that centre, and what they meet at next fewer have: about half at
most. No set of texts, however large, is paired with itself. Every link is
verified on whole multisets: overlap at least ``SIMILAR`` of the union. Components are found in Spark.

Defined results: a null or wordless text is a class of its own, as is a row of null id (class null);
rows of equal id are one document, whose texts' classes are one; equal texts share a class; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.components import components
from cinderlog.llm.sampling import draw
from cinderlog.llm.stages import drop, packed, release_shuffles, small, small_arrays, stage
from cinderlog.llm.words import mix64, pieces, scan, text_of, utf8, window_names

SHINGLE, SIMILAR, REGISTERS, BANDS = 5, 0.8, 128, 32
ROWS = REGISTERS // BANDS
#: Groups of so many texts get a centre of their own, from a sample of about CROWD_SAMPLE of them; what OFTEN or more of these have is often.
CROWD, CROWD_SAMPLE, OFTEN = 8, 256, 3
#: So many texts that meet at an element are paired; more are a group again. Above CROWD, so that such groups have centres.
FEW, FEW_SAMPLE = 64, 32
#: Lists of ids are broadcast up to this length, about 16 MB; beyond, joins are shuffled.
MOST_IDS = 500_000
_TINY = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, bounds: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Names of all shingles, in order, and the text of each."""
    w = scan(data, bounds)
    texts, n = text_of(w.first), np.diff(w.first)
    names = window_names(w.name, width, 3)
    whole = np.flatnonzero(texts[: len(names)] == texts[width - 1 :]) if len(names) else np.zeros(0, np.int64)
    names, owners = names[whole], texts[whole]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = n[short] > k
            own[has] = mix64(own[has] * _TINY + w.name[w.first[short[has]] + k])
        names, owners = np.concatenate([names, own]), np.concatenate([owners, short])
    return names, owners


def multiset(names: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (name, text) in order of text, and their counts."""
    _, at, counts = np.unique(mix64(names + mix64(owners.astype(np.uint64))), return_index=True, return_counts=True)
    order = np.argsort(owners[at], kind="stable")
    return names[at][order], owners[at][order], counts[order]


def signatures(names: np.ndarray, owners: np.ndarray, counts: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """(texts, registers): earliest times; infinite for texts without shingles."""
    out = np.full(texts * registers, np.inf)
    levels = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64)
    parts = np.repeat(np.arange(len(names)), levels + 1)
    level = np.arange(len(parts)) - np.repeat(np.cumsum(levels + 1) - (levels + 1), levels + 1)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    seed, owner, most, time = mix64(names[parts] + mix64(level.astype(np.uint64) + np.uint64(1))), owners[parts], counts[parts].astype(float), np.zeros(len(parts))
    while len(seed):
        seed = mix64(seed + _TINY)
        time = time - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / width
        other = mix64(seed ^ np.uint64(0xD6E8FEB86659FD93))
        register = (other % np.uint64(registers)).astype(np.int64)
        weight = low + np.floor((other >> np.uint64(20)).astype(np.float64) / 2.0**44 * width) + 1
        hit = weight <= most
        np.minimum.at(out, owner[hit] * registers + register[hit], time[hit])
        # an infinite register keeps its text's processes going
        go = time < out.reshape(texts, registers).max(axis=1)[owner]
        seed, owner, most, time, low, width = seed[go], owner[go], most[go], time[go], low[go], width[go]
    return out.reshape(texts, registers)


def bands(signature: np.ndarray) -> np.ndarray:
    """(texts, BANDS): names of the bands' contents."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(mix64(np.arange(BANDS, dtype=np.uint64)), bits.shape[:2]).copy()
    for k in range(ROWS):
        out = mix64(out * _TINY + bits[:, :, k])
    return out


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, two names of the whole multiset, and the bands (empty for no shingles)."""
    for batch in pieces(batches):
        names, owners, counts = multiset(*shingles(*utf8(batch.column("text"))))
        n = np.bincount(owners, counts, batch.num_rows).astype(np.int64)
        whole = []
        for salt in (1, 2):
            each = mix64(names + mix64(counts.astype(np.uint64) + np.uint64(salt << 32)))
            whole.append(np.concatenate([[np.uint64(0)], np.cumsum(each)])[np.searchsorted(owners, np.arange(batch.num_rows + 1))])
        h1, h2 = ((x[1:] - x[:-1]).view(np.int64) for x in whole)
        found = bands(signatures(names, owners, counts, batch.num_rows))[n > 0]
        lists = _lists(found.ravel(), np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(h1), pa.array(h2), lists], ["doc_id", "n", "h1", "h2", "bands"])


def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and the names of (shingle, occurrence), which make the multiset a set."""
    for batch in pieces(batches):
        names, owners, counts = multiset(*shingles(*utf8(batch.column("text"))))
        nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        each = mix64(np.repeat(names, counts) + nth.astype(np.uint64) * _TINY)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owners, counts, batch.num_rows).astype(np.int64))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(each, bounds)], ["doc_id", "elements"])


def _both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    of = lambda c: sets.select(F.col("doc_id").alias(c), F.col("elements").alias(f"of_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b")


def far_apart(similar: float) -> float:
    """The part of both sizes' sum that two sets may differ by: similar = shared / union."""
    return (1 - similar) / (1 + similar)


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Of candidate pairs (a, b), those whose multisets overlap enough."""
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return _both(pairs, sets).where(shared >= similar * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs of a pivot a and a text b: n (b's size), and what b has more and less than the pivot."""
    return _both(pairs, sets).select("a", "b", F.size("of_b").alias("n"), F.array_except("of_b", "of_a").alias("added"), F.array_except("of_a", "of_b").alias("removed"))


def centred(found: DataFrame, crowd: int, sample: int, seed: int = 8) -> DataFrame:
    """Differences from a pivot as those from its group's centre. Each is in one order: what the sample has seldom
    first, by name, then what it has often, by how often; so that first elements are rare ones."""
    sizes = small(stage(found.groupBy("a").agg(F.count("*").alias("size")).where(F.col("size") >= crowd)), MOST_IDS)
    drawn = found.join(sizes, "a").where(draw(F.col("b"), seed) * F.col("size") < sample)
    each = drawn.select("a", "b", F.explode(F.concat(F.transform("added", lambda e: F.struct(e.alias("e"), F.lit(True).alias("more"))), F.transform("removed", lambda e: F.struct(e.alias("e"), F.lit(False).alias("more"))))).alias("x"))
    counts = each.groupBy("a", "x.e", "x.more").agg(F.count("*").alias("k")).where(F.col("k") >= OFTEN).join(drawn.groupBy("a").agg(F.count("*").alias("of")), "a")
    most, kept = F.expr("2 * k > of"), F.struct("k", "e")
    # an element that most have is in the centre: what is often then is to lack it
    pick = lambda more, usual: F.transform(F.array_sort(F.collect_list(F.when((F.col("more") == more) & (most == usual), kept))), lambda x: x["e"])
    usual = stage(counts.groupBy("a").agg(pick(True, True).alias("gained"), pick(False, True).alias("lost"), pick(True, False).alias("often_more"), pick(False, False).alias("often_less")))
    none = F.array().cast("array<bigint>")
    joined = found.join(small_arrays(usual, ["gained", "lost", "often_more", "often_less"], MOST_IDS), "a", "left").select("a", "b", "n", "added", "removed", *[F.coalesce(c, none).alias(c) for c in ("gained", "lost", "often_more", "often_less")])
    more = F.concat(F.array_except("added", "gained"), F.array_except("lost", "removed"))
    less = F.concat(F.array_except("removed", "lost"), F.array_except("gained", "added"))
    sides = joined.select("a", "b", "n", more.alias("more"), less.alias("less"), "often_more", "often_less")
    in_order = lambda c: F.concat(F.sort_array(F.array_except(c, f"often_{c}")), F.array_intersect(f"often_{c}", c))
    out = stage(sides.select("a", "b", "n", in_order("more").alias("more"), in_order("less").alias("less")))
    drop(usual, sizes)
    return out


def against_middles(found: DataFrame, similar: float) -> DataFrame:
    """Of centred differences, staged: the middle m of each group, linked to it or not, and the keys: elements to ask for partners by or to answer by.

    Let T(x, y) be the most that linked texts of these sizes differ by, and d = |D|; m has the least d less
    its part of T. A pair shares at least (d(x) + d(y) - T(x, y)) / 2 elements, which for a text not linked to m
    is above 0, as it was with m, so 1 at least, and no less than (d(x) + d(m) - T(x, m)) / 2; for whatever partner that is at least d(x) - T(x, .);
    and as d(s) + d(m) > T(s, m) for a text s not linked to m, what answers it shares at least
    (d(y) + 1 - d(m) - [T(s, y) - T(s, m)]) / 2. Of k elements of which t are shared, the first k - t + 1 in
    a fixed order hold the first shared one.
    """
    part = far_apart(similar)
    d = F.size("more") + F.size("less")
    least = found.groupBy("a").agg(F.min(F.struct((d - F.col("n") * part).alias("over"), F.col("b"), d.alias("d"))).alias("least")).select("a", F.col("least.b").alias("m"), F.col("least.d").alias("dm"))
    least = small(stage(least), MOST_IDS)
    middles = stage(found.join(least, "a").where("b = m").select("a", "m", "dm", F.col("n").alias("nm"), F.col("more").alias("more_m"), F.col("less").alias("less_m")))
    rows = found.join(small_arrays(middles, ["more_m", "less_m"], MOST_IDS), "a")
    apart = lambda x, y: F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))
    linked = apart("more", "more_m") + apart("less", "less_m") <= (F.col("n") + F.col("nm")) * part + 1e-9
    most = F.floor(F.col("n") * (1 + 1 / similar) * part + 1e-9)
    answering = F.ceil((d + 1 - F.col("dm") - F.ceil(F.greatest(F.col("n") - F.col("nm"), F.lit(0)) * part)) / 2)

    asking = F.ceil((d + F.col("dm") - (F.col("n") + F.col("nm")) * part - 1e-6) / 2)

    def first(shared):
        of_more = F.greatest(F.size("more") - F.greatest(shared - F.size("less"), F.lit(1)) + 1, F.lit(0)).cast("int")
        of_less = F.greatest(F.size("less") - F.greatest(shared, F.lit(1)) + 1, F.lit(0)).cast("int")
        return F.struct(of_more.alias("more"), of_less.alias("less"))

    def keys(c, more):
        asked, answered = F.when(F.col("linked"), 0).otherwise(F.col(f"asked.{c}")), F.col(f"answered.{c}")
        mark = lambda e, i: F.struct(e.alias("e"), F.lit(more).alias("more"), (F.size(c) - i - 1).alias("left"), (i < asked).alias("asks"), (i < answered).alias("answers"))
        return F.transform(F.slice(c, F.lit(1), F.greatest(asked, answered)), mark)

    told = rows.select("a", "b", "m", "n", d.alias("d"), F.size("less").alias("r"), linked.alias("linked"), first(F.greatest(asking, d - most)).alias("asked"), first(F.greatest(answering, d - most)).alias("answered"), "more", "less")
    out = stage(told.select("a", "b", "m", "n", "d", "r", "linked", F.concat(keys("more", True), keys("less", False)).alias("keys")))
    drop(least, middles)
    return out


def meetings(tried: DataFrame, labels: DataFrame) -> DataFrame:
    """Staged (a, h, size, more, b, label, n, d, r, left, asks, answers): texts b of group a that meet at elements. Elements of
    the same texts are one meeting, named h (a clash of names would only join two). None is of one component alone."""
    placed = tried.join(small(labels, MOST_IDS).withColumnRenamed("node", "b"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    open_groups = small(stage(tried.where("NOT linked").select("a").distinct()), MOST_IDS)
    each = placed.join(open_groups, "a", "left_semi").select("a", "b", "label", "n", "d", "r", F.explode("keys").alias("x")).select("a", "b", "label", "n", "d", "r", "x.*")
    met = each.groupBy("a", "e", "more").agg(
        F.count("*").alias("size"), F.bool_or("asks").alias("asked"), F.bool_or("answers").alias("answered"), F.min("label").alias("low"), F.max("label").alias("high"),
        F.bit_xor(F.xxhash64("b", "asks", "answers")).alias("who"),
    ).where("asked AND answered AND low < high")
    met = small(stage(met.select("a", "e", "more", "size", F.xxhash64("who", "size", "more").alias("h"))), MOST_IDS)
    of = ("size", "more", "label", "n", "d", "r", "left", "asks", "answers")
    out = stage(each.join(met, ["a", "e", "more"]).groupBy("a", "h", "b").agg(*[F.max(c).alias(c) for c in of]))
    drop(open_groups, met)
    return out


def paired(met: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of texts that meet, one of them asking, and can be similar by their sizes and by how much of them is left."""
    asking = met.where("asks").select("a", "h", "more", "b", "label", "n", "d", "r", "left")
    answers = met.where("answers").select("a", "h", *[F.col(c).alias(f"{c}2") for c in ("b", "label", "n", "d", "r", "left")])
    sized = F.least("n", "n2") >= similar * F.greatest("n", "n2")
    # what the pair must share at least. Its first shared element leaves so many after it on either side; lost
    # elements are a reason only where nothing gained is shared
    shared = F.ceil((F.col("d") + F.col("d2") - F.floor((F.col("n") + F.col("n2")) * far_apart(similar) + 1e-9)) / 2)
    reason = sized & (shared <= 1 + F.least("left", "left2") + F.when(F.col("more"), F.least("r", "r2")).otherwise(0))
    return asking.join(answers, ["a", "h"]).where((F.col("label") != F.col("label2")) & reason).select(F.least("b", "b2").alias("a"), F.greatest("b", "b2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), copy_of (the least doc_id of equal multiset); one row per document, and per row of null doc_id"""
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long"), "text")
    signed = stage(read.mapInArrow(sign, "doc_id long, n long, h1 long, h2 long, bands array<long>"))
    known = signed.where("doc_id IS NOT NULL")
    nameless = stage(signed.where("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of")))
    # of multisets that several documents have, the first document: one row a multiset, written before it is joined back
    first = small(stage(known.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("copy_of"), F.max("doc_id").alias("last")).where("copy_of < last").drop("last")), MOST_IDS)
    own = known.join(first, ["h1", "h2", "n"], "left").withColumn("copy_of", F.coalesce("copy_of", "doc_id"))
    pairs = own.groupBy("doc_id", "copy_of").agg(F.lit(0).alias("one")).select("doc_id", "copy_of")
    copies = stage(pairs.groupBy("doc_id").agg(F.min("copy_of").alias("copy_of"), F.max("copy_of").alias("other")))
    # an id with several texts links their classes
    several = copies.where("copy_of < other").select("doc_id", F.col("copy_of").alias("a"))
    merged = stage(pairs.join(several, "doc_id").where("a < copy_of").select("a", F.col("copy_of").alias("b")).distinct())

    keyed = own.where("n > 0 AND copy_of = doc_id").select("doc_id", F.explode("bands").alias("key"))
    # buckets of one text end here; of the others the least document is the pivot
    pivots = small(stage(keyed.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot < last").drop("last")), MOST_IDS)
    buckets = stage(keyed.join(pivots, "key").groupBy("doc_id", "pivot").agg(F.lit(0).alias("one")).select("doc_id", "pivot"))
    drop(signed, first, pivots)
    release_shuffles(spark)

    ids = stage(buckets.select("doc_id").distinct())
    sets = stage(read.join(small(ids, MOST_IDS), "doc_id", "left_semi").mapInArrow(elements, "doc_id long, elements array<long>"))
    drop(ids)
    found = stage(differences(buckets.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")), sets))
    release_shuffles(spark)
    middle = centred(found, CROWD, CROWD_SAMPLE)
    drop(found)
    tried = against_middles(middle, similar)
    linked = lambda tried: tried.where("linked AND b <> m").select(F.col("m").alias("a"), "b")
    links = [stage(linked(tried).union(merged))]
    drop(merged)
    release_shuffles(spark)

    labels, fresh = components(links[0]), []
    while True:
        met = meetings(tried, labels)
        fresh.append(stage(paired(met.where(F.col("size") <= FEW), similar)))
        again = stage(met.where(F.col("size") > FEW).select(F.xxhash64("a", "h").alias("g"), "a", "b"))
        drop(met, tried)
        if again.isEmpty():
            break
        found = stage(middle.join(small(again, MOST_IDS), ["a", "b"]).select(F.col("g").alias("a"), "b", "n", F.col("more").alias("added"), F.col("less").alias("removed")))
        drop(middle, again)
        # a sample of each round's own: one too small for a centre is not drawn again
        middle = centred(found, CROWD, FEW_SAMPLE, 8 + len(fresh))
        drop(found)
        tried = against_middles(middle, similar)
        links.append(stage(linked(tried)))
        release_shuffles(spark)
    drop(middle, again, labels)
    more = stage(reduce(DataFrame.union, [*links, verified(reduce(DataFrame.union, fresh).distinct(), sets, similar)]))
    drop(*fresh, *links)
    release_shuffles(spark)
    labels = components(more)
    drop(more, buckets, sets)

    classed = copies.drop("other").join(small(labels, MOST_IDS).select(F.col("node").alias("copy_of"), "label"), "copy_of", "left").select("doc_id", F.coalesce("label", "copy_of").alias("class_id"), "copy_of")
    out = stage(classed.union(nameless))
    drop(copies, labels, nameless)
    release_shuffles(spark)
    return out


def first_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Rows of ``docs``, one for each class: its first document's. Of several rows with that id, the one of least digest stays; rows of null id all stay."""
    classes = near_duplicates(docs, similar)
    gone = stage(classes.where("class_id < doc_id").select(F.col("doc_id").alias("gone")))
    again = small(stage(docs.groupBy(F.col("doc_id").cast("long").alias("again")).agg(F.count("*").alias("c")).where("c > 1 AND again IS NOT NULL").select("again")), MOST_IDS)
    drop(classes)
    stay = packed(docs).join(small(gone, MOST_IDS), F.col("row.doc_id") == F.col("gone"), "left_anti")
    once = stay.join(again, F.col("row.doc_id") == F.col("again"), "left_anti")
    # combined before the shuffle, so an id of very many rows is one row a task
    least = stay.join(again, F.col("row.doc_id") == F.col("again"), "left_semi").select(F.col("row.doc_id").alias("id"), "row")
    least = least.groupBy("id").agg(F.min_by("row", F.sha2(F.to_json(F.struct("row")), 256)).alias("row"))
    return once.union(least.select("row")).select("row.*")
