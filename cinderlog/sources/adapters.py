"""Tables as entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlog.schema import as_entries
from cinderlog.sources.parse import parse


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_entries(events: DataFrame) -> DataFrame:
    """One entry an event: level by type, message with the k of props, ids from the user and the event."""
    k = F.get_json_object("props", "$.k")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").when(F.col("event_type") == "view", "DEBUG").otherwise("INFO")
    return as_entries(
        events.select(
            F.lit("events").alias("file"),
            (F.col("event_id") + 1).alias("line_number"),
            F.col("ts").cast("timestamp_ntz").alias("timestamp"),
            level.alias("level"),
            F.lit("Json").alias("format"),
            F.concat("event_type", F.lit(" k="), k).alias("message"),
            F.concat(F.lit("user-"), F.col("user_id")).alias("thread_id"),
            F.concat(F.lit("req-"), F.col("event_id") % 500).alias("correlation_id"),
            F.concat(F.lit("svc-"), F.col("user_id") % 5).alias("service_name"),
            F.map_filter(F.create_map(F.lit("k"), k, F.lit("value"), F.col("value").cast("string")), lambda _, v: v.isNotNull()).alias("fields"),
        )
    )


def orders_as_spans(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """An order's span and, below it, one per line; lines of one number share a span. Line numbers follow all columns."""
    o = orders.select(
        F.lit("orders").alias("file"), F.col("o_orderkey").alias("line_number"), F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("o_orderstatus") == "F", "ERROR").otherwise("INFO").alias("level"), F.concat(F.lit("order "), "o_orderpriority").alias("message"),
        F.concat(F.lit("c-"), "o_custkey").alias("trace_id"), F.concat(F.lit("o-"), "o_orderkey").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.lit("orders").alias("service_name"),
    )
    # several rows have one line number: the place among them makes (file, line_number) unique
    twins = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*lineitem.columns)
    items = lineitem.withColumn("_twin", F.row_number().over(twins)).join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    i = items.select(
        F.lit("lineitem").alias("file"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("_twin")).alias("line_number"), F.col("l_shipdate").cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("INFO").alias("level"), F.concat(F.lit("item "), "l_linestatus").alias("message"),
        F.concat(F.lit("c-"), "o_custkey").alias("trace_id"), F.concat(F.lit("l-"), "l_orderkey", F.lit("-"), "l_linenumber").alias("span_id"), F.concat(F.lit("o-"), "l_orderkey").alias("parent_span_id"), F.lit("lineitem").alias("service_name"),
    )
    return as_entries(o.unionByName(i))


def conversations_as_entries(conversations: DataFrame) -> DataFrame:
    return as_entries(conversations.select(F.lit("conversations").alias("file"), F.col("turn").alias("line_number"), F.concat(F.lit("conv-"), "conv_id").alias("correlation_id"), F.col("role").alias("thread_id"), F.col("text").alias("message")))


def document_lines(documents: DataFrame) -> DataFrame:
    """Texts cut at newlines: (file, line_number, raw)."""
    return documents.select(F.concat(F.lit("doc-"), "doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("i", "raw")).select("file", (F.col("i") + 1).cast("long").alias("line_number"), F.regexp_replace("raw", r"\r\z", "").alias("raw"))


def event_json_lines(events: DataFrame) -> DataFrame:
    """The events again as JSON log lines, for the text path."""
    e = events_as_entries(events)
    obj = F.to_json(F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.col("level"), F.col("message"), F.col("thread_id"), F.col("correlation_id"), F.col("service_name").alias("service")))
    value = F.coalesce(F.col("fields")["value"], F.lit("null"))
    return e.withColumn("_o", obj).select("file", "line_number", F.concat(F.expr("substr(_o, 1, length(_o) - 1)"), F.lit(',"value":'), value, F.lit("}")).alias("raw"))


def parsed_events(events: DataFrame) -> DataFrame:
    return parse(event_json_lines(events))
