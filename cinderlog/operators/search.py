"""Search: filter, order, page, with context lines, projections and the shapes of its results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.operators.predicates import Filters
from cinderlog.schema import POSITION, shown_level

DEFAULT_LIMIT = 10_000


class LineNotFound(LookupError):
    pass


def by_time() -> list[Column]:
    """Time, entries without one last; then file and line."""
    return [F.col("timestamp").asc_nulls_last(), *map(F.col, POSITION)]


def page(entries: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The ordered page; no limit means 10,000 and 0 means all."""
    out = entries.orderBy(*by_time())
    if offset:
        out = out.offset(offset)
    most = DEFAULT_LIMIT if limit is None else limit
    return out.limit(most) if most else out


def tail(entries: DataFrame, n: int) -> DataFrame:
    """The last n by time; entries without a time come last, by line number over all files."""
    line = F.when(F.col("timestamp").isNull(), F.col("line_number"))
    order = [F.col("timestamp").asc_nulls_last(), line.asc_nulls_first(), *map(F.col, POSITION)]
    back = [F.col("timestamp").desc_nulls_first(), line.desc_nulls_last(), *[F.col(c).desc() for c in POSITION]]
    return entries.orderBy(*back).limit(n).orderBy(*order)


def search(entries: DataFrame, filters: Filters | None = None, limit: int | None = None, offset: int = 0, tail_n: int | None = None, fields: Sequence[str] | None = None) -> DataFrame:
    """Entries that pass, ordered and cut; ``tail_n`` takes the place of limit and offset."""
    found = entries.where((filters or Filters()).column())
    out = tail(found, tail_n) if tail_n is not None else page(found, limit, offset)
    return out.select(*[c for c in fields if c in out.columns]) if fields else out


def count(entries: DataFrame, filters: Filters | None = None) -> int:
    return entries.where((filters or Filters()).column()).count()


def raw_page(entries: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Entries in file order."""
    return entries.orderBy(*POSITION).offset(offset).limit(limit)


def with_context(entries: DataFrame, keep: Column, before: int, after: int) -> DataFrame:
    """Entries that ``keep`` holds for, with up to so many entries before and after them in their file."""
    line = F.struct("line_number", shown_level().alias("level"), "message")
    order = Window.partitionBy("file").orderBy("line_number")
    none = F.array().cast("array<struct<line_number:bigint,level:string,message:string>>")
    out = entries.withColumn("context_before", F.collect_list(line).over(order.rowsBetween(-before, -1)) if before else none)
    out = out.withColumn("context_after", F.collect_list(line).over(order.rowsBetween(1, after)) if after else none)
    return out.where(keep)


def context(entries: DataFrame, file: str, line_number: int, before: int = 10, after: int = 10) -> DataFrame:
    """One line with its neighbours: rows with ``part`` before, target or after. Raises LineNotFound."""
    mine = entries.where(F.col("file") == file)
    near = mine.where(F.col("line_number") < line_number).orderBy(F.desc("line_number")).limit(before).withColumn("part", F.lit("before"))
    at = mine.where(F.col("line_number") == line_number).withColumn("part", F.lit("target"))
    if at.isEmpty():
        raise LineNotFound(f"{file}:{line_number}")
    later = mine.where(F.col("line_number") > line_number).orderBy("line_number").limit(after).withColumn("part", F.lit("after"))
    return near.unionByName(at).unionByName(later).orderBy("line_number")


def compact(entries: DataFrame) -> DataFrame:
    """time, level, msg (150 characters), thread or correlation, file name, line."""
    return entries.select(
        F.col("timestamp").alias("time"), shown_level().alias("level"), F.substring("message", 1, 150).alias("msg"),
        F.coalesce("thread_id", "correlation_id").alias("thread"), F.element_at(F.split("file", "/"), -1).alias("file"), F.col("line_number").alias("line"),
    )


def short_keys(entries: DataFrame) -> DataFrame:
    """The same columns under the short names of compact JSON output."""
    return entries.select(
        F.col("line_number").alias("ln"), F.col("timestamp").alias("ts"), shown_level().alias("lv"), F.col("message").alias("msg"), F.element_at(F.split("file", "/"), -1).alias("src"),
        F.col("thread_id").alias("th"), F.col("correlation_id").alias("cid"), F.col("trace_id").alias("trc"), F.col("span_id").alias("sid"), F.col("service_name").alias("svc"),
    )
