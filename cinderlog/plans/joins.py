"""Joins that Catalyst has no good plan for, rewritten as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.schema import micros


def band_join(anchors: DataFrame, entries: DataFrame, window_us: int) -> DataFrame:
    """Pairs with |a.timestamp - e.timestamp| <= window, both ends included.

    A plain predicate would compare all pairs. Here time is cut into bins one window wide, an anchor asks
    its own bin and both neighbours, and the predicate is checked within: each pair meets once.
    ``anchors`` columns come with the prefix ``a_``.
    """
    width = max(window_us, 1)
    bin_of = lambda c: F.floor(micros(F.col(c)) / F.lit(width))
    left = anchors.where("timestamp IS NOT NULL").select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    left = left.withColumn("_bin", F.explode(F.array(*[bin_of("a_timestamp") + d for d in (-1, 0, 1)])))
    right = entries.where("timestamp IS NOT NULL").withColumn("_bin", bin_of("timestamp"))
    near = F.abs(micros(F.col("a_timestamp")) - micros(F.col("timestamp"))) <= window_us
    return left.join(right, "_bin").where(near).drop("_bin")


def prefixes(df: DataFrame, column: str, separators: str) -> DataFrame:
    """Rows of ``df`` with ``prefix``: each part of the text before a separator with something after it."""
    return df.withColumn("prefix", F.explode(_cuts(F.col(column), separators)))


def _cuts(text: Column, separators: str) -> Column:
    places = F.filter(F.sequence(F.lit(2), F.greatest(F.length(text), F.lit(2))), lambda i: F.lit(separators).contains(text.substr(i, F.lit(1))) & (i <= F.length(text)))
    return F.transform(places, lambda i: text.substr(F.lit(1), i - 1))


def as_of(left: DataFrame, right: DataFrame, by: str, time: str = "timestamp") -> DataFrame:
    """Each left row with the last right row of its key at or before its time (columns with the prefix ``r_``), by one sort per key instead of a range join."""
    names = [c for c in right.columns if c != by]
    l_side = left.withColumn("_side", F.lit(1)).withColumn("_t", F.col(time)).withColumn("_row", F.struct(*left.columns)).withColumn("_r", F.lit(None).cast(right.select(F.struct(*names).alias("s")).schema["s"].dataType)).select(by, "_t", "_side", "_row", "_r")
    r_side = right.withColumn("_side", F.lit(0)).withColumn("_t", F.col(time)).withColumn("_row", F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType)).withColumn("_r", F.struct(*names)).select(by, "_t", "_side", "_row", "_r")
    order = Window.partitionBy(by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l_side.unionByName(r_side).withColumn("_last", F.last("_r", ignorenulls=True).over(order)).where("_side = 1")
    return both.select("_row.*", *[F.col(f"_last.{c}").alias(f"r_{c}") for c in names])
