"""Following an id, comparing requests and periods, and timelines over services."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.functions.levels import ERRORS
from cinderlog.operators.predicates import Filters
from cinderlog.operators.search import by_time
from cinderlog.schema import POSITION, micros, shown_level


def follow(entries: DataFrame, thread_id: str | None = None, correlation_id: str | None = None, trace_id: str | None = None) -> DataFrame:
    """Entries of any of the ids, each once, by time (null last), then line."""
    keep = F.lit(False)
    for name, value in (("thread_id", thread_id), ("correlation_id", correlation_id), ("trace_id", trace_id)):
        if value is not None:
            keep = keep | F.coalesce(F.col(name) == value, F.lit(False))
    return entries.where(keep).orderBy(F.col("timestamp").asc_nulls_last(), "line_number", "file")


def follow_summary(entries: DataFrame, **ids: str) -> DataFrame:
    """One row: entries, duration in ms (null if any entry lacks a time, as those come last), distinct spans in order."""
    found = follow(entries, **ids)
    timed = F.count("timestamp") == F.count("*")
    span = (micros(F.max("timestamp")) - micros(F.min("timestamp"))) / 1000
    return found.agg(F.count("*").alias("total"), F.when(timed, span).alias("duration_ms"), F.sort_array(F.collect_set("span_id")).alias("spans"))


def durations(entries: DataFrame, by: str = "correlation_id") -> DataFrame:
    """The same for every id at once."""
    span = (micros(F.max("timestamp")) - micros(F.min("timestamp"))) / 1000
    return entries.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count("*").alias("total"), F.when(F.count("timestamp") == F.count("*"), span).alias("duration_ms"), F.count_if(F.col("level").isin(*ERRORS)).alias("errors"), F.countDistinct("service_name").alias("services")
    )


def analyse(entries: DataFrame, by: str) -> DataFrame:
    """Per id: entries, errors, levels, distinct messages and services, duration."""
    return entries.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(F.col("level").isin(*ERRORS)).alias("errors"), F.countDistinct("message").alias("messages"), F.countDistinct("service_name").alias("services"),
        ((micros(F.max("timestamp")) - micros(F.min("timestamp"))) / 1000).alias("duration_ms"),
    )


def only_in(b: DataFrame, a: DataFrame, most: int | None = 10) -> DataFrame:
    """Messages of ``b`` that ``a`` lacks, by first appearance."""
    mine = b.groupBy("message").agg(F.min(F.struct(F.col("timestamp").isNull().alias("late"), "timestamp", *POSITION)).alias("_first"), F.count("*").alias("n"))
    out = mine.join(a.select("message").distinct(), "message", "left_anti").orderBy("_first").select("message", "n")
    return out.limit(most) if most else out


def compare_threads(entries: DataFrame, a: dict[str, str], b: dict[str, str]) -> dict[str, DataFrame]:
    """Two followed ids: the analysis of each, and the messages that only one has."""
    x, y = follow(entries, **a), follow(entries, **b)
    one = lambda e: e.agg(F.count("*").alias("total"), F.count_if(F.col("level").isin(*ERRORS)).alias("errors"), F.countDistinct("message").alias("messages"), F.countDistinct("service_name").alias("services"), ((micros(F.max("timestamp")) - micros(F.min("timestamp"))) / 1000).alias("duration_ms"))
    return {"a": one(x), "b": one(y), "only_in_a": only_in(x, y), "only_in_b": only_in(y, x)}


def period(entries: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """A period's entries; those without a time are in every period."""
    return entries.where(Filters(time_start=start, time_end=end).column())


def period_facts(entries: DataFrame) -> DataFrame:
    errors, total = F.count_if(F.col("level").isin(*ERRORS)), F.count("*")
    return entries.agg(total.alias("total"), errors.alias("errors"), F.round(F.when(total > 0, errors / total).otherwise(0.0), 6).alias("error_rate"), F.countDistinct(F.coalesce("thread_id", "correlation_id")).alias("threads"))


def compare_periods(entries: DataFrame, a: tuple[datetime, datetime], b: tuple[datetime, datetime]) -> dict[str, DataFrame]:
    """Facts of both periods, and errors that are new or gone in the second."""
    x, y = period(entries, *a), period(entries, *b)
    bad = lambda e: e.where(F.col("level").isin(*ERRORS))
    return {"a": period_facts(x), "b": period_facts(y), "new": only_in(bad(y), bad(x), None), "resolved": only_in(bad(x), bad(y), None)}


def timeline(entries: DataFrame, services: list[str] | None = None, start: datetime | None = None, end: datetime | None = None, limit: int | None = None, per_service: int = 10_000, **ids: str) -> DataFrame:
    """Entries of several services in one order, numbered, with the ms since the first: each service gives its first ``per_service``."""
    found = follow(entries, **ids) if ids else entries
    if services:
        found = found.where(F.col("service_name").isin(services))
    found = found.where(Filters(time_start=start, time_end=end).column())
    order = Window.partitionBy("service_name").orderBy(*by_time())
    found = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_service).drop("_r")
    first = found.agg(F.min("timestamp").alias("_t0"))
    out = found.join(F.broadcast(first)).withColumn("relative_ms", (micros(F.col("timestamp")) - micros(F.col("_t0"))) / 1000).drop("_t0").orderBy(*by_time())
    return out.limit(limit) if limit else out


def steps(entries: DataFrame, **ids: str) -> DataFrame:
    """A request's entries numbered from 1: step, service, level, message."""
    found = follow(entries, **ids)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("timestamp").asc_nulls_last(), "line_number", "file")
    return found.select(F.row_number().over(order).alias("step"), "service_name", shown_level().alias("level"), "message")


def divergence(entries: DataFrame, a: dict[str, str], b: dict[str, str]) -> DataFrame:
    """The first step at which two requests differ in service, level or message; no row if none of the shared steps does."""
    x = steps(entries, **a).select("step", F.struct("service_name", "level", "message").alias("x"))
    y = steps(entries, **b).select("step", F.struct("service_name", "level", "message").alias("y"))
    return x.join(y, "step").where(~F.col("x").eqNullSafe(F.col("y"))).orderBy("step").limit(1).select("step", F.col("x.message").alias("message_a"), F.col("y.message").alias("message_b"))


def windows_diff(entries: DataFrame, a: tuple[datetime, datetime], b: tuple[datetime, datetime]) -> DataFrame:
    """One row: both windows' volumes and error rates, and their changes in per cent, from one pass."""
    facts = []
    for name, (start, end) in (("a", a), ("b", b)):
        keep = Filters(time_start=start, time_end=end).column()
        facts += [F.count_if(keep).alias(f"total_{name}"), F.count_if(keep & F.col("level").isin(*ERRORS)).alias(f"errors_{name}")]
    one = entries.agg(*facts)
    rate = lambda n: F.when(F.col(f"total_{n}") > 0, F.col(f"errors_{n}") / F.col(f"total_{n}")).otherwise(0.0)
    return one.withColumn("volume_change", F.round(F.when(F.col("total_a") > 0, 100 * (F.col("total_b") - F.col("total_a")) / F.col("total_a")), 6)).withColumn("error_rate_change", F.round(100 * (rate("b") - rate("a")), 6))
