"""Counts and summaries of entries. Orders that depend on first appearance use the least position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.functions.ids import id_shape
from cinderlog.functions.levels import ERRORS
from cinderlog.schema import IDS, POSITION, micros, shown_level

TOP_MESSAGES = 20
_at = F.struct


def position():
    return F.struct(*POSITION)


def by_level(entries: DataFrame) -> DataFrame:
    return entries.groupBy(shown_level().alias("level")).agg(F.count("*").alias("n"))


def by_file(entries: DataFrame) -> DataFrame:
    return entries.groupBy("file").agg(F.count("*").alias("n"), F.min("line_number").alias("first_line"))


def by_level_and_file(entries: DataFrame) -> DataFrame:
    return entries.groupBy("file", shown_level().alias("level")).agg(F.count("*").alias("n"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"))


def totals(entries: DataFrame) -> DataFrame:
    """One row: number, distinct messages, first and last time."""
    return entries.agg(F.count("*").alias("total"), F.countDistinct(F.trim("message")).alias("unique_messages"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"))


def top_messages(entries: DataFrame, most: int = TOP_MESSAGES) -> DataFrame:
    """The commonest trimmed messages, ties by first appearance: text to 200 characters, count, levels, times, the first two places."""
    per = entries.groupBy(F.trim("message").alias("_m"), shown_level().alias("_l")).agg(
        F.count("*").alias("_n"), F.min(position()).alias("_first"), F.min("timestamp").alias("_t0"), F.max("timestamp").alias("_t1")
    )
    whole = per.groupBy("_m").agg(
        F.sum("_n").alias("n"), F.min("_first").alias("_first"), F.min("_t0").alias("first_time"), F.max("_t1").alias("last_time"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "_l", "_n"))), ",").alias("levels"),
    )
    top = whole.orderBy(F.desc("n"), "_first").limit(most)
    return top.select(F.substring("_m", 1, 200).alias("message"), "n", "levels", "first_time", "last_time", F.col("_first.file").alias("file"), F.col("_first.line_number").alias("line_number"))


def extract_ids(entries: DataFrame) -> DataFrame:
    """kind, id, n, first_seen, last_seen of threads, correlations, traces and services, in one pass; order n desc, id."""
    each = entries.select("timestamp", F.explode(F.array(*[F.struct(F.lit(k.removesuffix("_id").removesuffix("_name")).alias("kind"), F.col(k).alias("id")) for k in IDS])).alias("x"))
    return each.where("x.id IS NOT NULL").groupBy("x.kind", "x.id").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def thread_levels(entries: DataFrame) -> DataFrame:
    """Per thread its entries and those of each level; a thread that is null is none."""
    levels = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNKNOWN")
    return entries.where("thread_id IS NOT NULL").groupBy("thread_id").agg(F.count("*").alias("total"), *[F.count_if(shown_level() == x).alias(x.lower()) for x in levels])


def repeated_errors(entries: DataFrame, least: int = 2, examples: int = 5) -> DataFrame:
    """Errors alike in their first 50 characters: pattern, n, first and last time, threads, the places of the first ones. Groups without any time are left out."""
    errors = entries.where(F.col("level").isin(*ERRORS))
    ranked = errors.withColumn("_p", F.substring("message", 1, 50)).withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*POSITION)))
    place = F.when(F.col("_r") <= examples, F.struct(*POSITION))
    return (
        ranked.groupBy(F.col("_p").alias("pattern"))
        .agg(F.count("*").alias("n"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"), F.sort_array(F.collect_set("thread_id")).alias("threads"), F.array_sort(F.collect_list(place)).alias("examples"))
        .where((F.col("n") >= least) & F.col("first_time").isNotNull())
    )


def file_metadata(entries: DataFrame) -> DataFrame:
    """Per file: entries, the first one's format, time range, distinct ids, error rate, names of fields."""
    counts = [F.countDistinct(k).alias(f"unique_{k.removesuffix('_id').removesuffix('_name')}s") for k in IDS]
    return entries.groupBy("file").agg(
        F.count("*").alias("total_entries"), F.min_by("format", "line_number").alias("format"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"), *counts,
        F.count_if(F.col("level").isin(*ERRORS)).alias("errors"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("fields"))))).alias("available_fields"),
    )


def stats(entries: DataFrame) -> DataFrame:
    """Per file: total, distinct threads, correlations and traces, error rate in per cent."""
    errors = F.count_if(F.col("level").isin(*ERRORS))
    return entries.groupBy("file").agg(F.count("*").alias("total"), *[F.countDistinct(k).alias(f"unique_{k[:-3]}s") for k in IDS[:3]], errors.alias("errors"), F.round(100 * errors / F.count("*"), 6).alias("error_rate"))


def triage(entries: DataFrame) -> DataFrame:
    """One row: totals, error rate and the severity it means."""
    errors, total = F.count_if(F.col("level").isin(*ERRORS)), F.count("*")
    rate = F.when(total > 0, errors / total).otherwise(0.0)
    one = entries.agg(total.alias("total"), errors.alias("errors"), F.count_if(F.col("level") == "WARN").alias("warnings"), F.round(rate, 6).alias("error_rate"))
    r = F.col("error_rate")
    return one.withColumn("severity", F.when(r > 0.2, "critical").when(r > 0.1, "high").when(r > 0.05, "medium").when(r > 0.01, "low").otherwise("healthy"))


def summarize(entries: DataFrame) -> DataFrame:
    """One row: total, errors, distinct error messages, the commonest of them (ties by first appearance) and its count."""
    errors = entries.where(F.col("level") == "ERROR").groupBy("message").agg(F.count("*").alias("n"), F.min(position()).alias("first"))
    top = errors.agg(F.count("*").alias("unique_errors"), F.coalesce(F.sum("n"), F.lit(0)).alias("errors"), F.max_by(F.struct("message", "n"), F.struct(F.col("n"), -F.col("first.line_number"))).alias("top"))
    total = entries.agg(F.count("*").alias("total"), F.count_if(F.col("level") == "WARN").alias("warnings"))
    return total.join(top).select("total", "errors", "warnings", "unique_errors", F.col("top.message").alias("top_error"), F.col("top.n").alias("top_error_n"))


def first_of_level(entries: DataFrame, level: str, most: int) -> DataFrame:
    return entries.where(F.col("level") == level).orderBy(*POSITION).limit(most)


def schema_presence(entries: DataFrame) -> DataFrame:
    """For each column and field name, the part of the entries that has it (3 digits)."""
    core = ("timestamp", "level", "thread_id", "correlation_id", "trace_id", "span_id", "parent_span_id", "service_name")
    total = entries.agg(F.count("*").alias("total"))
    has = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).isNotNull().cast("int").alias("h")) for c in core])
    own = entries.select(F.explode(has).alias("x")).groupBy(F.col("x.f").alias("field")).agg(F.sum("x.h").alias("present"))
    more = entries.select(F.explode(F.map_keys("fields")).alias("k")).groupBy(F.concat(F.lit("fields."), F.col("k")).alias("field")).agg(F.count("*").alias("present"))
    # one row on the right side
    return own.union(more).join(F.broadcast(total)).select("field", "present", F.round(F.col("present") / F.col("total"), 3).alias("presence"))


def id_shapes(entries: DataFrame) -> DataFrame:
    each = entries.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("id")) for k in IDS])).alias("x")).where("x.id IS NOT NULL")
    return each.groupBy("x.kind", id_shape(F.col("x.id")).alias("shape")).agg(F.count("*").alias("n"))


def verify_pattern(entries: DataFrame, pattern: str) -> DataFrame:
    """How a pattern's groups fill: group, value, n; and a row of group '' for all matches."""
    from cinderlog.functions.patterns import to_java

    java = to_java(pattern)
    hit = entries.where(F.col("raw").rlike(java.text))
    groups = F.array(F.struct(F.lit("").alias("g"), F.lit("").alias("v")), *[F.struct(F.lit(n).alias("g"), F.regexp_extract("raw", java.text, i).alias("v")) for n, i in java.groups.items()])
    return hit.select("file", "line_number", F.explode(groups).alias("x")).groupBy(F.col("x.g").alias("group"), F.col("x.v").alias("value")).agg(F.count("*").alias("n"), F.min(position()).alias("first"), F.max(position()).alias("last"))


def thread_tracker(entries: DataFrame) -> DataFrame:
    """Per thread: first and last time, entries, errors, correlations in order."""
    return entries.where("thread_id IS NOT NULL").groupBy("thread_id").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count("*").alias("log_count"), F.count_if(F.col("level").isin(*ERRORS)).alias("error_count"),
        F.sort_array(F.collect_set("correlation_id")).alias("correlations"),
    )


def trace_tracker(entries: DataFrame) -> DataFrame:
    """Per trace: spans, services, start, end, duration."""
    return entries.where("trace_id IS NOT NULL").groupBy("trace_id").agg(
        F.count_distinct("span_id").alias("spans"), F.count_distinct("service_name").alias("services"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"),
        ((micros(F.max("timestamp")) - micros(F.min("timestamp"))) / 1000).alias("duration_ms"),
    )
