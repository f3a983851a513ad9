"""The log entry: one row per line, the shape that every operator takes and most return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ``timestamp`` is UTC without a zone; ``fields`` holds each remaining value as JSON text, which keeps its type.
ENTRY = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("raw", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("level", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("thread_id", T.StringType()),
        T.StructField("correlation_id", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("parent_span_id", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)
COLUMNS = ENTRY.fieldNames()
IDS = ("thread_id", "correlation_id", "trace_id", "service_name")


def as_entries(df: DataFrame) -> DataFrame:
    """Any table with some of the entry's columns as full entries: the others are null, message falls back to raw."""
    have = set(df.columns)
    cols = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in ENTRY.fields]
    return df.select(*cols).withColumn("raw", F.coalesce("raw", "message")).withColumn("message", F.coalesce("message", "raw"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def shown_level(level: Column | None = None) -> Column:
    """Null levels are kept inside the engine and shown as UNKNOWN."""
    return F.coalesce(F.col("level") if level is None else level, F.lit("UNKNOWN"))


#: The order of entries: by file, then line.
POSITION = ("file", "line_number")
