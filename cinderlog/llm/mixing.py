"""Mixing sources to target weights: repetition rates per source, then hash-seeded copies per document.

Sizes are summed per source (map-side combined), so the tables that windows run over have one
row per source. A document is taken ``floor(rate)`` times, plus once more if a coin seeded by
its doc_id and its text falls below the fraction.

Defined results: null or empty text has size 0 and is taken 0 times; a null source is one source,
ordered last; rows of null or repeated id differ in their coins by their texts; rows of equal id and
text get equal decisions; an empty table gives an empty result; other columns, whatever their names,
pass through ``mix`` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm.stages import drop, packed, small, stage
from cinderlog.llm.words import WORD

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
#: A broadcast of source rates has at most this many rows; beyond, the join is shuffled and skew is split.
MOST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """52 bits of a digest of the id and the text as a number in [0, 1)."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, size) rows to one row per source: source_size, target.

    Water filling in closed form: with sources by ascending ``most * size / weight`` the capped ones are
    a prefix, and the others share what is left by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy(F.col("ratio"), F.col("rank"))
    upto, onward = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0)))
        .withColumn("share", F.sum("weight").over(onward))
        .withColumn("capped", F.col("left") * F.col("weight") > F.col("cap") * F.col("share"))
        .withColumn("rest", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(whole))
        .withColumn("open", F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(whole))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("rest") * F.col("weight")).cast("double") / F.col("open")))
        .select("source", "source_size", "target")
    )


def _rates(sized: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Staged (name, source_size, target), one row a source."""
    found = targets(sized, weights, most).withColumnRenamed("source", "name")
    return small(stage(found), MOST_SOURCES)


def _copies(toss: Column) -> Column:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (F.floor(rate) + (toss < rate - F.floor(rate)).cast("long")).cast("long")


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken."""
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), coin(F.col("doc_id"), F.col("text"), seed).alias("toss")))
    copies = F.when(F.col("size") > 0, _copies(F.col("toss"))).otherwise(F.lit(0)).cast("long")
    joined = sized.join(_rates(sized, weights, most), F.col("source").eqNullSafe(F.col("name")))
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as the mix takes it. Texts are never shuffled while rates fit a broadcast."""
    sized = stage(docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("size")))
    rates = _rates(sized, weights, most)
    drop(sized)
    filled = F.coalesce(F.regexp_like(F.col("row.text"), F.lit(WORD)), F.lit(False))
    copies = F.when(filled, _copies(coin(F.col("row.doc_id"), F.col("row.text"), seed))).otherwise(F.lit(0)).cast("int")
    taken = packed(docs).join(rates, F.col("row.source").eqNullSafe(F.col("name")))
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1]::BIGINT AS weight,
  row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM per),
filling AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total,
  coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM ranked WINDOW w AS (ORDER BY (3 * source_size)::DOUBLE / weight, rank)),
capping AS (SELECT *, (total - before) * weight > cap * share AS capped FROM filling),
rates AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
  ((total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * weight)::DOUBLE / (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target FROM capping),
rated AS (SELECT s.doc_id, s.size, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, 'null') || ':' || s.digest), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS coin
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN ((floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT ELSE 0::BIGINT END AS taken FROM rated
"""
