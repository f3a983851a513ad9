"""The registered queries: operators over the test tables, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlog.operators import aggregates, correlate, detect, export, follow, hierarchy, metrics, sampling, search, templates
from cinderlog.operators.predicates import EventCondition, Filters, field
from cinderlog.plans.joins import as_of
from cinderlog.schema import POSITION, shown_level
from cinderlog.sources.adapters import conversations_as_entries, document_lines, events_as_entries, orders_as_spans, parsed_events, table
from cinderlog.sources.parse import parse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The adapters in SQL.
ENTRIES = """entries AS (SELECT 'events' AS file, event_id + 1 AS line_number, ts AS "timestamp",
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
  event_type || ' k=' || (props->>'$.k') AS message, 'user-' || user_id AS thread_id, 'req-' || (event_id % 500) AS correlation_id, 'svc-' || (user_id % 5) AS service_name, (props->>'$.k')::DOUBLE AS k, value FROM events)"""
TALK = """talk AS (SELECT 'conversations' AS file, turn AS line_number, 'conv-' || conv_id AS correlation_id, role AS thread_id, text AS message FROM conversations)"""
SPAN_LINES = """span_lines AS (
  SELECT 'orders' AS file, o_orderkey AS line_number, o_orderdate AS ts, CASE WHEN o_orderstatus = 'F' THEN 'ERROR' ELSE 'INFO' END AS level, 'c-' || o_custkey AS trace_id, 'o-' || o_orderkey AS span_id, NULL AS parent, 'orders' AS service FROM orders
  UNION ALL SELECT 'lineitem', l_orderkey * 10 + l_linenumber, l_shipdate, CASE WHEN l_returnflag = 'R' THEN 'ERROR' ELSE 'INFO' END, 'c-' || o_custkey, 'l-' || l_orderkey || '-' || l_linenumber, 'o-' || l_orderkey, 'lineitem' FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
spans AS (SELECT span_id, min(parent) AS parent_id, min(ts) AS start_time, max(ts) AS end_time, epoch_ms(max(ts)) - epoch_ms(min(ts)) AS duration_ms, count(*)::BIGINT AS entry_count, count(*) FILTER (level = 'ERROR')::BIGINT AS error_count FROM span_lines GROUP BY span_id)"""
T0, T1, T2 = datetime(2024, 1, 5), datetime(2024, 1, 12), datetime(2024, 1, 20)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_entries(table(spark, sf_dir, "events"))


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations_as_entries(table(spark, sf_dir, "conversations"))


def span_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_as_spans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


BRIEF = ("line_number", "timestamp", "level", "message", "thread_id")
_BRIEF = 'line_number, "timestamp", level, message, thread_id'


def _found(entries: DataFrame, filters: Filters) -> DataFrame:
    return search.search(entries, filters, limit=0).select(*BRIEF)


@query(f"WITH {ENTRIES} SELECT {_BRIEF} FROM entries WHERE level = 'ERROR'")
def search_errors(spark, sf_dir):
    return _found(events(spark, sf_dir), Filters(level="error"))


@query(f"WITH {ENTRIES} SELECT {_BRIEF} FROM entries WHERE level IN ('ERROR', 'WARN')")
def search_level_in(spark, sf_dir):
    return _found(events(spark, sf_dir), Filters(level="err,warning"))


@query(f"WITH {ENTRIES} SELECT {_BRIEF} FROM entries WHERE level NOT IN ('INFO', 'DEBUG')")
def search_exclude_level(spark, sf_dir):
    return _found(events(spark, sf_dir), Filters(exclude_level=["info", "debug"]))


@query(f"""WITH {ENTRIES} SELECT {_BRIEF} FROM entries WHERE "timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" <= TIMESTAMP '2024-01-12'""")
def search_time_range(spark, sf_dir):
    return _found(events(spark, sf_dir), Filters(time_start=T0, time_end=T1))


@query(f"WITH {ENTRIES} SELECT {_BRIEF} FROM entries WHERE thread_id IN ('user-1', 'user-2', 'user-3') AND service_name IN ('svc-1', 'svc-2') AND correlation_id IS NOT NULL")
def search_ids_multi(spark, sf_dir):
    return _found(events(spark, sf_dir), Filters(thread_id=["user-1", "user-2", "user-3"], service_name=["svc-1", "svc-2"], has_correlation_id=True))


@query(f"WITH {ENTRIES} SELECT {_BRIEF} FROM entries WHERE regexp_matches(message, '(?i)PURCH.*k=[1-3]\\b')")
def search_regex_ci(spark, sf_dir):
    return _found(events(spark, sf_dir), Filters(query=r"PURCH.*k=[1-3]\b"))


@query(f"WITH {ENTRIES} SELECT {_BRIEF} FROM entries WHERE NOT regexp_matches(message, '(?i)view|click')")
def search_exclude_regex(spark, sf_dir):
    return _found(events(spark, sf_dir), Filters(exclude_query="view|click"))


@query(f'WITH {TALK} SELECT correlation_id, line_number, thread_id FROM talk WHERE regexp_matches(message, \'(?i)the\')')
def search_conversations(spark, sf_dir):
    return talk(spark, sf_dir).where(Filters(query="the").column()).select("correlation_id", "line_number", "thread_id")


@query(f'WITH {ENTRIES} SELECT {_BRIEF} FROM entries WHERE level = \'ERROR\' ORDER BY "timestamp", file, line_number LIMIT 50 OFFSET 100')
def search_page_offset(spark, sf_dir):
    return search.search(events(spark, sf_dir), Filters(level="error"), limit=50, offset=100).select(*BRIEF)


@query(f'WITH {ENTRIES} SELECT {_BRIEF} FROM entries ORDER BY "timestamp" DESC, file DESC, line_number DESC LIMIT 25')
def search_tail(spark, sf_dir):
    return search.search(events(spark, sf_dir), tail_n=25).select(*BRIEF)


@query(f"""WITH {ENTRIES} SELECT "timestamp" AS time, level, message[:150] AS msg, thread_id AS thread, file, line_number AS line FROM entries WHERE level = 'ERROR'""")
def search_compact(spark, sf_dir):
    return search.compact(events(spark, sf_dir).where(Filters(level="error").column()))


@query(f"WITH {ENTRIES} SELECT line_number, k AS value FROM entries WHERE k >= 5")
def field_condition(spark, sf_dir):
    from cinderlog.operators.predicates import condition

    e = events(spark, sf_dir)
    return e.where(condition(field("k"), ">= 5")).select("line_number", field("k").cast("double").alias("value"))


@query(f"WITH {ENTRIES} SELECT line_number, message FROM entries ORDER BY file, line_number LIMIT 100 OFFSET 500")
def raw_page(spark, sf_dir):
    return search.raw_page(events(spark, sf_dir), 100, 500).select("line_number", "message")


_CONTEXT = """string_agg(line_number || ':' || message, '|' ORDER BY line_number) OVER (PARTITION BY file ORDER BY line_number ROWS BETWEEN {})"""


@query(f"""WITH {ENTRIES}, w AS (SELECT line_number, level, {_CONTEXT.format('2 PRECEDING AND 1 PRECEDING')} AS before, {_CONTEXT.format('1 FOLLOWING AND 2 FOLLOWING')} AS after FROM entries)
SELECT line_number, coalesce(before, '') AS before, coalesce(after, '') AS after FROM w WHERE level = 'ERROR'""")
def context_window(spark, sf_dir):
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["line_number"].cast("string"), x["message"])), "|")
    return search.with_context(events(spark, sf_dir), F.col("level") == "ERROR", 2, 2).select("line_number", shown("context_before").alias("before"), shown("context_after").alias("after"))


@query(f'WITH {ENTRIES} SELECT file, level, count(*)::BIGINT AS n, min("timestamp") AS first_time, max("timestamp") AS last_time FROM entries GROUP BY ALL')
def count_by_level_file(spark, sf_dir):
    return aggregates.by_level_and_file(events(spark, sf_dir))


@query(f'WITH {ENTRIES} SELECT count(*)::BIGINT AS total, count(DISTINCT trim(message))::BIGINT AS unique_messages, min("timestamp") AS first_time, max("timestamp") AS last_time FROM entries')
def search_totals(spark, sf_dir):
    return aggregates.totals(events(spark, sf_dir))


@query(f"""WITH {ENTRIES}, per AS (SELECT trim(message) AS m, level, count(*) AS n, min(line_number) AS l, min("timestamp") AS t0, max("timestamp") AS t1 FROM entries GROUP BY ALL)
SELECT m[:200] AS message, sum(n)::BIGINT AS n, string_agg(level || ':' || n, ',' ORDER BY level || ':' || n) AS levels, min(t0) AS first_time, max(t1) AS last_time, 'events' AS file, min(l) AS line_number FROM per GROUP BY m ORDER BY 2 DESC, min(l) LIMIT 20""")
def top_messages(spark, sf_dir):
    return aggregates.top_messages(events(spark, sf_dir))


@query(f"""WITH {ENTRIES}, ids AS (SELECT 'thread' AS kind, thread_id AS id, "timestamp" AS t FROM entries UNION ALL SELECT 'correlation', correlation_id, "timestamp" FROM entries UNION ALL SELECT 'service', service_name, "timestamp" FROM entries)
SELECT kind, id, count(*)::BIGINT AS n, min(t) AS first_seen, max(t) AS last_seen FROM ids GROUP BY ALL""")
def extract_ids(spark, sf_dir):
    return aggregates.extract_ids(events(spark, sf_dir))


_LEVELS = ", ".join(f"count(*) FILTER (level = '{x}')::BIGINT AS {x.lower()}" for x in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNKNOWN"))


@query(f"WITH {ENTRIES} SELECT thread_id, count(*)::BIGINT AS total, {_LEVELS} FROM entries GROUP BY thread_id")
def thread_level_counts(spark, sf_dir):
    return aggregates.thread_levels(events(spark, sf_dir))


@query(f"""WITH {ENTRIES}, r AS (SELECT *, message[:50] AS p, row_number() OVER (PARTITION BY message[:50] ORDER BY line_number) AS rn FROM entries WHERE level IN ('ERROR', 'FATAL'))
SELECT p AS pattern, count(*)::BIGINT AS n, min("timestamp") AS first_time, max("timestamp") AS last_time, list_aggregate(list_sort(list_distinct(list(thread_id))), 'string_agg', ',') AS threads,
  string_agg(CASE WHEN rn <= 5 THEN line_number::VARCHAR END, ',' ORDER BY line_number) AS examples FROM r GROUP BY p HAVING count(*) >= 2""")
def repeated_errors(spark, sf_dir):
    e = aggregates.repeated_errors(events(spark, sf_dir))
    return e.withColumn("threads", F.array_join("threads", ",")).withColumn("examples", F.array_join(F.transform("examples", lambda x: x["line_number"]), ","))


@query(f"""WITH {ENTRIES}, one AS (SELECT count(*)::BIGINT AS total, count(*) FILTER (level IN ('ERROR', 'FATAL'))::BIGINT AS errors, count(*) FILTER (level = 'WARN')::BIGINT AS warnings FROM entries)
SELECT *, round(errors::DOUBLE / total, 6) AS error_rate, CASE WHEN errors::DOUBLE / total > 0.2 THEN 'critical' WHEN errors::DOUBLE / total > 0.1 THEN 'high' WHEN errors::DOUBLE / total > 0.05 THEN 'medium' WHEN errors::DOUBLE / total > 0.01 THEN 'low' ELSE 'healthy' END AS severity FROM one""")
def triage(spark, sf_dir):
    return aggregates.triage(events(spark, sf_dir))


@query(f"""WITH {ENTRIES}, e AS (SELECT message, count(*) AS n, min(line_number) AS l FROM entries WHERE level = 'ERROR' GROUP BY message), t AS (SELECT * FROM e ORDER BY n DESC, l LIMIT 1)
SELECT (SELECT count(*) FROM entries)::BIGINT AS total, (SELECT sum(n) FROM e)::BIGINT AS errors, (SELECT count(*) FROM entries WHERE level = 'WARN')::BIGINT AS warnings, (SELECT count(*) FROM e)::BIGINT AS unique_errors, t.message AS top_error, t.n::BIGINT AS top_error_n FROM t""")
def summarize_errors(spark, sf_dir):
    return aggregates.summarize(events(spark, sf_dir))


@query(f"""WITH {ENTRIES} SELECT file, count(*)::BIGINT AS total_entries, 'Json' AS format, min("timestamp") AS first_time, max("timestamp") AS last_time, count(DISTINCT thread_id)::BIGINT AS unique_threads, count(DISTINCT correlation_id)::BIGINT AS unique_correlations,
  0::BIGINT AS unique_traces, count(DISTINCT service_name)::BIGINT AS unique_services, count(*) FILTER (level = 'ERROR')::BIGINT AS errors, 'k,value' AS available_fields FROM entries GROUP BY file""")
def file_metadata(spark, sf_dir):
    return aggregates.file_metadata(events(spark, sf_dir)).withColumn("available_fields", F.array_join("available_fields", ","))


@query(f"""WITH {ENTRIES} SELECT file, count(*)::BIGINT AS total, count(DISTINCT thread_id)::BIGINT AS unique_threads, count(DISTINCT correlation_id)::BIGINT AS unique_correlations, 0::BIGINT AS unique_traces,
  count(*) FILTER (level = 'ERROR')::BIGINT AS errors, round(100.0::DOUBLE * count(*) FILTER (level = 'ERROR') / count(*), 6) AS error_rate FROM entries GROUP BY file""")
def file_stats(spark, sf_dir):
    return aggregates.stats(events(spark, sf_dir))


@query(f"""WITH {ENTRIES}, t AS (SELECT count(*) AS n FROM entries), f AS (
  SELECT unnest(['timestamp', 'level', 'thread_id', 'correlation_id', 'service_name', 'trace_id', 'span_id', 'parent_span_id', 'fields.k', 'fields.value']) AS field,
         unnest([count("timestamp"), count(level), count(thread_id), count(correlation_id), count(service_name), 0, 0, 0, count(k), count(value)]) AS present FROM entries)
SELECT field, present::BIGINT AS present, round(present::DOUBLE / n, 3) AS presence FROM f, t""")
def schema_presence(spark, sf_dir):
    return aggregates.schema_presence(events(spark, sf_dir))


@query(f"""WITH {ENTRIES}, m AS (SELECT line_number, regexp_extract(message, '^(\\w+) k=(\\d+)', 1) AS a, regexp_extract(message, '^(\\w+) k=(\\d+)', 2) AS b FROM entries WHERE regexp_matches(message, '^(\\w+) k=(\\d+)')),
g AS (SELECT line_number, '' AS "group", '' AS value FROM m UNION ALL SELECT line_number, 'kind', a FROM m UNION ALL SELECT line_number, 'k_no', b FROM m)
SELECT "group", value, count(*)::BIGINT AS n, min(line_number) AS first_line, max(line_number) AS last_line FROM g GROUP BY ALL""")
def verify_pattern(spark, sf_dir):
    v = aggregates.verify_pattern(events(spark, sf_dir), r"^(?P<kind>\w+) k=(?P<k_no>\d+)")
    return v.select("group", "value", "n", F.col("first.line_number").alias("first_line"), F.col("last.line_number").alias("last_line"))


@query(f"""WITH {ENTRIES} SELECT thread_id, min("timestamp") AS first_seen, max("timestamp") AS last_seen, count(*)::BIGINT AS log_count, count(*) FILTER (level = 'ERROR')::BIGINT AS error_count, count(DISTINCT correlation_id)::INTEGER AS correlations FROM entries GROUP BY thread_id""")
def thread_tracker(spark, sf_dir):
    return aggregates.thread_tracker(events(spark, sf_dir)).withColumn("correlations", F.size("correlations"))


@query(f"""WITH {SPAN_LINES} SELECT trace_id, count(DISTINCT span_id)::BIGINT AS spans, count(DISTINCT service)::BIGINT AS services, min(ts) AS start_time, max(ts) AS end_time, epoch_us(max(ts)) / 1000.0::DOUBLE - epoch_us(min(ts)) / 1000.0::DOUBLE AS duration_ms FROM span_lines GROUP BY trace_id""")
def trace_tracker(spark, sf_dir):
    return aggregates.trace_tracker(span_entries(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT 'worker-N' AS shape, 0::BIGINT AS n, '' AS kind FROM entries WHERE false UNION ALL SELECT CASE WHEN id LIKE 'req-%' THEN 'req-...' ELSE 'other' END, count(*)::BIGINT, kind FROM (SELECT 'thread_id' AS kind, thread_id AS id FROM entries UNION ALL SELECT 'correlation_id', correlation_id FROM entries UNION ALL SELECT 'service_name', service_name FROM entries) GROUP BY ALL")
def id_shapes(spark, sf_dir):
    return aggregates.id_shapes(events(spark, sf_dir))


@query(f"""WITH {ENTRIES} SELECT {_BRIEF}, correlation_id FROM entries WHERE thread_id = 'user-7' OR correlation_id = 'req-7'""")
def follow_thread(spark, sf_dir):
    return follow.follow(events(spark, sf_dir), thread_id="user-7", correlation_id="req-7").select(*BRIEF, "correlation_id")


@query(f"""WITH {ENTRIES} SELECT correlation_id, count(*)::BIGINT AS total, (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1000.0::DOUBLE AS duration_ms, count(*) FILTER (level = 'ERROR')::BIGINT AS errors, count(DISTINCT service_name)::BIGINT AS services FROM entries GROUP BY correlation_id""")
def follow_duration(spark, sf_dir):
    return follow.durations(events(spark, sf_dir))


@query(f"""WITH {ENTRIES} SELECT thread_id, count(*)::BIGINT AS total, count(*) FILTER (level = 'ERROR')::BIGINT AS errors, count(DISTINCT message)::BIGINT AS messages, count(DISTINCT service_name)::BIGINT AS services, (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1000.0::DOUBLE AS duration_ms FROM entries GROUP BY thread_id""")
def thread_analysis(spark, sf_dir):
    return follow.analyse(events(spark, sf_dir), "thread_id")


@query(f"""WITH {ENTRIES}, b AS (SELECT message, min("timestamp") AS t, min(line_number) AS l, count(*)::BIGINT AS n FROM entries WHERE thread_id = 'user-2' AND message NOT IN (SELECT message FROM entries WHERE thread_id = 'user-1') GROUP BY message)
SELECT message, n FROM b ORDER BY t, l LIMIT 10""")
def compare_threads_only_in_b(spark, sf_dir):
    return follow.compare_threads(events(spark, sf_dir), {"thread_id": "user-1"}, {"thread_id": "user-2"})["only_in_b"]


_PERIOD = """SELECT '{0}' AS period, count(*)::BIGINT AS total, count(*) FILTER (level = 'ERROR')::BIGINT AS errors, round(count(*) FILTER (level = 'ERROR')::DOUBLE / count(*), 6) AS error_rate, count(DISTINCT thread_id)::BIGINT AS threads FROM entries WHERE "timestamp" >= TIMESTAMP '{1}' AND "timestamp" <= TIMESTAMP '{2}'"""


@query(f"WITH {ENTRIES} {_PERIOD.format('a', '2024-01-05', '2024-01-12')} UNION ALL {_PERIOD.format('b', '2024-01-12', '2024-01-20')}")
def period_compare(spark, sf_dir):
    found = follow.compare_periods(events(spark, sf_dir), (T0, T1), (T1, T2))
    return found["a"].withColumn("period", F.lit("a")).unionByName(found["b"].withColumn("period", F.lit("b")))


_IN = """message FROM entries WHERE level = 'ERROR' AND "timestamp" >= TIMESTAMP '{0}' AND "timestamp" <= TIMESTAMP '{1}'"""


@query(f"WITH {ENTRIES}, a AS (SELECT {_IN.format('2024-01-05', '2024-01-05 03:00:00')}), b AS (SELECT {_IN.format('2024-01-12', '2024-01-20')}) SELECT message, count(*)::BIGINT AS n FROM b WHERE message NOT IN (SELECT message FROM a) GROUP BY message")
def period_new_errors(spark, sf_dir):
    return follow.compare_periods(events(spark, sf_dir), (T0, datetime(2024, 1, 5, 3)), (T1, T2))["new"]


@query(f"""WITH {ENTRIES}, f AS (SELECT service_name, "timestamp", message FROM entries WHERE correlation_id = 'req-11' AND service_name IN ('svc-1', 'svc-2', 'svc-3'))
SELECT service_name, message, "timestamp", (epoch_us("timestamp") - (SELECT min(epoch_us("timestamp")) FROM f)) / 1000.0::DOUBLE AS relative_ms FROM f""")
def cross_service_timeline(spark, sf_dir):
    return follow.timeline(events(spark, sf_dir), ["svc-1", "svc-2", "svc-3"], correlation_id="req-11").select("service_name", "message", "timestamp", "relative_ms")


_STEPS = """(SELECT row_number() OVER (ORDER BY "timestamp", line_number) AS step, service_name, level, message FROM entries WHERE correlation_id = '{}')"""


@query(f"""WITH {ENTRIES} SELECT x.step::INTEGER AS step, x.message AS message_a, y.message AS message_b FROM {_STEPS.format('req-3')} x JOIN {_STEPS.format('req-4')} y ON x.step = y.step
WHERE (x.service_name, x.level, x.message) IS DISTINCT FROM (y.service_name, y.level, y.message) ORDER BY x.step LIMIT 1""")
def divergence_step(spark, sf_dir):
    return follow.divergence(events(spark, sf_dir), {"correlation_id": "req-3"}, {"correlation_id": "req-4"})


_W = """count(*) FILTER ("timestamp" >= TIMESTAMP '{1}' AND "timestamp" <= TIMESTAMP '{2}'{3})::BIGINT AS {0}"""
_WE = " AND level = 'ERROR'"


@query(f"""WITH {ENTRIES}, o AS (SELECT {_W.format('total_a', '2024-01-05', '2024-01-12', '')}, {_W.format('errors_a', '2024-01-05', '2024-01-12', _WE)}, {_W.format('total_b', '2024-01-12', '2024-01-20', '')}, {_W.format('errors_b', '2024-01-12', '2024-01-20', _WE)} FROM entries)
SELECT *, round(100 * (total_b - total_a)::DOUBLE / total_a, 6) AS volume_change, round(100 * (errors_b::DOUBLE / total_b - errors_a::DOUBLE / total_a), 6) AS error_rate_change FROM o""")
def windows_diff(spark, sf_dir):
    return follow.windows_diff(events(spark, sf_dir), (T0, T1), (T1, T2))


POINTS = f"""{ENTRIES}, points AS (SELECT line_number, "timestamp", 'k' AS field_name, k AS value FROM entries UNION ALL SELECT line_number, "timestamp", 'value', value FROM entries UNION ALL SELECT line_number, "timestamp", 'k', k FROM entries)"""


@query(f'WITH {POINTS} SELECT line_number, "timestamp", field_name, value FROM points')
def metrics_long(spark, sf_dir):
    return metrics.extract(events(spark, sf_dir)).select("line_number", "timestamp", "field_name", "value")


@query(f"""WITH {POINTS} SELECT field_name, count(*)::BIGINT AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, round(quantile_cont(value, 0.5), 6) AS median,
  round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM points GROUP BY field_name""")
def series_stats(spark, sf_dir):
    return metrics.series_stats(metrics.extract(events(spark, sf_dir))).drop("unit")


@query(f"""WITH {POINTS}, s AS (SELECT field_name, avg(value) AS m, stddev_pop(value) AS d FROM points GROUP BY field_name)
SELECT field_name, line_number, value, round(abs(value - m) / d, 4) AS z_score FROM points JOIN s USING (field_name) WHERE d > 0 AND abs(value - m) / d > 2""")
def anomalies_z(spark, sf_dir):
    return metrics.anomalies(metrics.extract(events(spark, sf_dir))).select("field_name", "line_number", "value", "z_score")


@query(f"""WITH {POINTS}, f AS (SELECT field_name, min("timestamp") AS t0 FROM points GROUP BY field_name), b AS (SELECT field_name, t0, (epoch_us("timestamp") - epoch_us(t0)) // 21600000000 AS bucket, value FROM points JOIN f USING (field_name))
SELECT field_name, bucket::BIGINT AS bucket, t0 + to_hours(6 * bucket::BIGINT) AS bucket_start, count(*)::BIGINT AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg FROM b GROUP BY field_name, t0, bucket""")
def time_buckets(spark, sf_dir):
    return metrics.time_buckets(metrics.extract(events(spark, sf_dir)), "6h")


@query(f"""WITH {ENTRIES}, p AS (SELECT line_number, "timestamp", value FROM entries) SELECT line_number, count(*) OVER w AS n_near, round(avg(value) OVER w, 6) AS avg_near FROM p WINDOW w AS (ORDER BY "timestamp" RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""")
def rolling_hour(spark, sf_dir):
    e = events(spark, sf_dir).select("file", "line_number", "timestamp", F.lit("value").alias("field_name"), field("value").cast("double").alias("value"))
    return metrics.rolling(e, 3600).select("line_number", "n_near", "avg_near")


RULE = correlate.FieldMatch("thread_id", "thread_id")
BURST = correlate.Temporal(EventCondition(level="ERROR"), "5m")


@query(f"""WITH {ENTRIES}, v AS (SELECT thread_id AS shared_value, count(*)::BIGINT AS n FROM entries GROUP BY thread_id)
SELECT 'vt-' || sha256('g:0:' || shared_value)[:12] AS virtual_trace_id, 'g' AS "group", 0 AS rule_index, shared_value, n AS source_count, n AS target_count, 2 * n AS entry_count FROM v""")
def field_match_clusters(spark, sf_dir):
    return correlate.field_match(events(spark, sf_dir), RULE, "g", 0)


_ISO = """strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us("timestamp") % 1000000 = 0 THEN '' ELSE strftime("timestamp", '.%f') END || '+00:00'"""


@query(f"""WITH {ENTRIES}, c AS (SELECT a.line_number, a."timestamp", a.message, count(*)::BIGINT AS entry_count FROM entries a JOIN entries e ON e."timestamp" BETWEEN a."timestamp" - INTERVAL 5 MINUTE AND a."timestamp" + INTERVAL 5 MINUTE
  WHERE a.level = 'ERROR' GROUP BY ALL HAVING count(*) > 1)
SELECT 'vt-' || sha256('g:1:' || {_ISO} || ':' || message[:120])[:12] AS virtual_trace_id, 'g' AS "group", 1 AS rule_index, 'events' AS anchor_file, line_number AS anchor_line, "timestamp" AS anchor_timestamp, message[:120] AS anchor_message, entry_count FROM c""")
def temporal_clusters(spark, sf_dir):
    return correlate.temporal(events(spark, sf_dir), BURST, "g", 1)


@query(f"""WITH {ENTRIES}, t AS (SELECT *, row_number() OVER (ORDER BY file, "timestamp", line_number) - 1 AS nth FROM entries WHERE level = 'WARN'),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('second', "timestamp") ORDER BY nth) AS r FROM t) WHERE r = 1),
c AS (SELECT a.line_number, a."timestamp", a.message, a.nth, count(*)::BIGINT AS entry_count FROM f a JOIN entries e ON e."timestamp" BETWEEN a."timestamp" - INTERVAL 1 MINUTE AND a."timestamp" + INTERVAL 1 MINUTE GROUP BY ALL HAVING count(*) > 1)
SELECT 'vt-' || sha256('event-trigger:' || nth || ':' || {_ISO} || ':' || message[:120])[:12] AS virtual_trace_id, 'events' AS anchor_file, line_number AS anchor_line, "timestamp" AS anchor_timestamp, entry_count FROM c""")
def trigger_clusters(spark, sf_dir):
    return correlate.by_trigger(events(spark, sf_dir), EventCondition(level="WARN"), "1m")


@query(f"""WITH {ENTRIES}, e AS (SELECT line_number, thread_id, "timestamp" AS t FROM entries WHERE level = 'ERROR'), v AS (SELECT thread_id, "timestamp" AS t, message FROM entries WHERE level = 'DEBUG')
SELECT e.line_number, v.message AS last_view FROM e ASOF LEFT JOIN v ON e.thread_id = v.thread_id AND e.t >= v.t""")
def as_of_last_view(spark, sf_dir):
    e = events(spark, sf_dir)
    views = e.where("level = 'DEBUG'").select("thread_id", "timestamp", "message")
    return as_of(e.where("level = 'ERROR'").select("line_number", "thread_id", "timestamp"), views, "thread_id").select("line_number", F.col("r_message").alias("last_view"))


@query(f"WITH {SPAN_LINES} SELECT span_id, parent_id, start_time, end_time, duration_ms, entry_count, error_count FROM spans")
def span_tree(spark, sf_dir):
    return hierarchy.span_table(span_entries(spark, sf_dir)).select("span_id", "parent_id", "start_time", "end_time", "duration_ms", "entry_count", "error_count")


_SELF = f"{SPAN_LINES}, kids AS (SELECT parent_id AS p, sum(duration_ms)::BIGINT AS children_ms, count(*)::BIGINT AS children FROM spans WHERE parent_id IS NOT NULL GROUP BY 1), self AS (SELECT span_id, parent_id, duration_ms, coalesce(children_ms, 0) AS children_ms, coalesce(children, 0) AS children, greatest(duration_ms - coalesce(children_ms, 0), 0) AS self_ms FROM spans LEFT JOIN kids ON span_id = p)"


@query(f"WITH {_SELF} SELECT span_id, children_ms, children, self_ms FROM self")
def span_self_time(spark, sf_dir):
    return hierarchy.self_times(hierarchy.span_table(span_entries(spark, sf_dir))).select("span_id", "children_ms", "children", "self_ms")


@query(f"WITH {_SELF} SELECT span_id, self_ms FROM self ORDER BY self_ms DESC, span_id LIMIT 10")
def bottleneck_spans(spark, sf_dir):
    return hierarchy.self_times(hierarchy.span_table(span_entries(spark, sf_dir))).orderBy(F.desc("self_ms"), "span_id").limit(10).select("span_id", "self_ms")


@query(f"WITH {SPAN_LINES} SELECT span_id AS id, error_count FROM spans WHERE error_count > 0")
def error_spans(spark, sf_dir):
    return hierarchy.span_table(span_entries(spark, sf_dir)).where("error_count > 0").select(F.col("span_id").alias("id"), "error_count")


@query(f"""WITH {SPAN_LINES}, hit AS (SELECT DISTINCT span_id FROM span_lines WHERE trace_id = 'c-1')
SELECT s.span_id AS id, CASE WHEN s.parent_id IN (SELECT span_id FROM hit) THEN 1 ELSE 0 END AS depth, s.start_time, s.end_time, s.duration_ms, s.entry_count, s.error_count FROM spans s WHERE s.span_id IN (SELECT span_id FROM hit)""")
def hierarchy_nodes(spark, sf_dir):
    return hierarchy.nodes(span_entries(spark, sf_dir), "c-1", naming=False).select("id", "depth", "start_time", "end_time", "duration_ms", "entry_count", "error_count")


@query(f"""WITH {SPAN_LINES}, x AS (SELECT s.* FROM spans s WHERE parent_id IS NOT NULL AND error_count > 0) SELECT span_id AS id, error_count, true AS is_leaf FROM x WHERE span_id IN (SELECT span_id FROM span_lines WHERE trace_id = 'c-1')
UNION ALL SELECT span_id, error_count, span_id NOT IN (SELECT parent_id FROM spans WHERE parent_id IS NOT NULL) FROM spans WHERE parent_id IS NULL AND error_count > 0 AND span_id IN (SELECT span_id FROM span_lines WHERE trace_id = 'c-1') AND span_id NOT IN (SELECT parent_id FROM x)""")
def root_causes(spark, sf_dir):
    return hierarchy.root_causes(hierarchy.nodes(span_entries(spark, sf_dir), "c-1", naming=False)).select("id", "error_count", "is_leaf")


@query(f"""WITH {SPAN_LINES}, n AS (SELECT CASE WHEN parent_id IS NULL THEN 0 ELSE 1 END AS depth, count(*)::BIGINT AS nodes FROM spans GROUP BY 1) SELECT depth, nodes FROM n""")
def concurrent_by_depth(spark, sf_dir):
    t = hierarchy.span_table(span_entries(spark, sf_dir))
    return t.groupBy(F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth")).agg(F.count("*").alias("nodes"))


_SIDE = """(SELECT l_linenumber || '' AS id, sum(l_quantity)::BIGINT AS ms, count(*) FILTER (l_returnflag = 'R')::BIGINT AS errors FROM lineitem WHERE l_suppkey % 2 = {} GROUP BY 1)"""


@query(f"""SELECT coalesce(a.id, b.id) AS id, a.ms AS before_ms, b.ms AS after_ms, b.ms - a.ms AS change_ms, CASE WHEN b.id IS NULL THEN 'removed' WHEN a.id IS NULL THEN 'new' WHEN b.ms - a.ms < -10 THEN 'improved' WHEN b.ms - a.ms > 10 THEN 'degraded' ELSE 'same' END AS status,
  CASE WHEN a.errors = 0 AND b.errors > 0 THEN 'new' WHEN a.errors > 0 AND b.errors = 0 THEN 'resolved' END AS errors FROM {_SIDE.format(0)} a FULL JOIN {_SIDE.format(1)} b ON a.id = b.id""")
def hierarchy_diff(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    side = lambda k: items.where(F.col("l_suppkey") % 2 == k).groupBy(F.col("l_linenumber").cast("string").alias("id")).agg(F.sum("l_quantity").cast("long").alias("duration_ms"), F.count_if(F.col("l_returnflag") == "R").alias("error_count"))
    return hierarchy.diff(side(0), side(1))


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_id < 2000")
    from cinderlog.schema import as_entries

    return as_entries(e.select(F.lit("c").alias("file"), F.col("event_id").alias("line_number"), F.col("ts").cast("timestamp_ntz").alias("timestamp"), F.concat(F.lit("q"), F.col("event_id")).alias("correlation_id"), F.concat(F.lit("parent_request_id=q"), F.expr("event_id div 4")).alias("message")))


@query("""SELECT 'q' || (event_id // 4) AS parent, 'q' || event_id AS child, 0.85::DOUBLE AS confidence FROM events WHERE event_id < 2000 AND event_id <> event_id // 4""")
def correlation_chains(spark, sf_dir):
    return hierarchy.chains(_chained(spark, sf_dir)).select("parent", "child", F.col("confidence").cast("double").alias("confidence"))


@query("""SELECT 'q0' AS id""")
def correlation_chain_roots(spark, sf_dir):
    e = _chained(spark, sf_dir)
    return hierarchy.chain_roots(e, hierarchy.chains(e))


@query("""WITH RECURSIVE t(id, depth) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT e.event_id, t.depth + 1 FROM t JOIN events e ON e.event_id // 4 = t.id AND e.event_id <> t.id WHERE e.event_id < 2000) SELECT 'q' || id AS id, depth FROM t""")
def correlation_descendants(spark, sf_dir):
    return hierarchy.descendants(hierarchy.chains(_chained(spark, sf_dir)), "q0").select(F.col("key").alias("id"), "depth")


_POP = f"""{ENTRIES}, pop AS (SELECT *, row_number() OVER (ORDER BY "timestamp", file, line_number) - 1 AS i FROM entries ORDER BY "timestamp", file, line_number LIMIT 1000)"""


@query(f"WITH {_POP} SELECT line_number, level FROM pop WHERE i % 10 = 0")
def sample_chronological(spark, sf_dir):
    return sampling.sample(events(spark, sf_dir), "chronological", 100).select("line_number", "level")


@query(f"""WITH {_POP}, c AS (SELECT level, count(*) AS n FROM pop GROUP BY level), q AS (SELECT level, n, (100 * n) // 1000 AS f, (100 * n) % 1000 AS r FROM c),
k AS (SELECT level, n, f + CASE WHEN row_number() OVER (ORDER BY r DESC, level) <= 100 - sum(f) OVER () THEN 1 ELSE 0 END AS q FROM q),
p AS (SELECT line_number, pop.level, row_number() OVER (PARTITION BY pop.level ORDER BY i) - 1 AS p, n, q FROM pop JOIN k ON pop.level = k.level)
SELECT line_number, level FROM p WHERE ceil(p * q / n::DOUBLE) < q AND floor(ceil(p * q / n::DOUBLE) * n / q::DOUBLE) = p""")
def sample_representative(spark, sf_dir):
    return sampling.sample(events(spark, sf_dir), "representative", 100).select("line_number", "level")


@query(f"""WITH {_POP}, r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (PARTITION BY message ORDER BY i) AS m, row_number() OVER (PARTITION BY coalesce(thread_id, correlation_id) ORDER BY i) AS t FROM pop),
k AS (SELECT *, CASE WHEN message <> '' AND m = 1 THEN 0 WHEN t = 1 THEN 1 ELSE 2 END AS kind FROM r)
SELECT line_number, level FROM k ORDER BY kind, CASE WHEN kind = 2 AND floor(ceil(i * 100 / n::DOUBLE) * n / 100.0) = i THEN 0 ELSE 1 END, i LIMIT 100""")
def sample_diverse(spark, sf_dir):
    return sampling.sample(events(spark, sf_dir), "diverse", 100).select("line_number", "level")


@query(f"""WITH {ENTRIES}, r AS (SELECT *, row_number() OVER (PARTITION BY level IN ('ERROR', 'FATAL') ORDER BY "timestamp", file, line_number) - 1 AS nth, level IN ('ERROR', 'FATAL') AS bad FROM entries),
p AS (SELECT *, count(*) OVER (PARTITION BY bad) AS n FROM r WHERE nth < CASE WHEN bad THEN 700 ELSE 500 END), t AS (SELECT least(70, count(*) FILTER (bad)) AS e FROM p),
w AS (SELECT p.*, CASE WHEN bad THEN e ELSE least(n, 100 - e) END AS q FROM p, t)
SELECT line_number, level FROM w WHERE ceil(nth * q / n::DOUBLE) < q AND floor(ceil(nth * q / n::DOUBLE) * n / q::DOUBLE) = nth""")
def sample_errors_focused(spark, sf_dir):
    return sampling.sample(events(spark, sf_dir), "errors_focused", 100).select("line_number", "level")


@query(f"""WITH {_POP}, s AS (SELECT * FROM pop WHERE i % 10 = 0), f AS (SELECT (SELECT epoch_us(max("timestamp")) - epoch_us(min("timestamp")) FROM pop) AS a, (SELECT epoch_us(max("timestamp")) - epoch_us(min("timestamp")) FROM s) AS b,
  (SELECT count(DISTINCT thread_id) FROM pop)::BIGINT AS ta, (SELECT count(DISTINCT thread_id) FROM s)::BIGINT AS tb)
SELECT round(least(1.0, b / a::DOUBLE), 6) AS time_coverage, tb AS threads_in_sample, ta AS threads_in_population, round(tb / ta::DOUBLE, 6) AS thread_coverage FROM f""")
def sample_coverage(spark, sf_dir):
    pop = sampling.population(events(spark, sf_dir), 100)
    return sampling.coverage(pop, sampling.chronological(pop, 100))


_LINES = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_number FROM documents), kept AS (SELECT * FROM lines WHERE trim(raw, ' ' || chr(9) || chr(13)) <> '')"""


@query(rf"""WITH {_LINES}, l AS (SELECT doc_id, line_number, regexp_extract(raw, '\b(EMERGENCY|INFORMATION|CRITICAL|VERBOSE|WARNING|NOTICE|SEVERE|ALERT|DEBUG|EMERG|ERROR|FATAL|PANIC|TRACE|CRIT|INFO|WARN|ERR)\b', 1) AS w FROM kept)
SELECT count(*)::BIGINT AS lines, count(*) FILTER (w <> '')::BIGINT AS leveled FROM l""")
def parse_document_lines(spark, sf_dir):
    parsed = parse(document_lines(table(spark, sf_dir, "documents")), force="PlainText")
    return parsed.agg(F.count("*").alias("lines"), F.count("level").alias("leveled"))


@query(rf"""WITH {_LINES} SELECT 'doc-' || doc_id AS file, line_number, regexp_extract(raw, '(\w+) = "([0-9a-f]+)"', 2) AS secret FROM kept WHERE regexp_matches(raw, '(\w+) = "([0-9a-f]+)"')""")
def kv_extract(spark, sf_dir):
    lines = document_lines(table(spark, sf_dir, "documents"))
    p = r'(\w+) = "([0-9a-f]+)"'
    return lines.where(F.col("raw").rlike(p)).select("file", "line_number", F.regexp_extract("raw", p, 2).alias("secret"))


@query(f'WITH {ENTRIES} SELECT line_number, "timestamp", level, \'Json\' AS format, message, thread_id, correlation_id, service_name, value FROM entries')
def parse_json_lines(spark, sf_dir):
    return parsed_events(table(spark, sf_dir, "events")).select("line_number", "timestamp", "level", "format", "message", "thread_id", "correlation_id", "service_name", F.col("fields")["value"].cast("double").alias("value"))


@query(f"WITH {ENTRIES} SELECT level, count(*)::BIGINT AS n FROM entries GROUP BY level")
def parse_and_count(spark, sf_dir):
    return aggregates.by_level(parsed_events(table(spark, sf_dir, "events")))


@query()
def drain_templates(spark, sf_dir):
    e = parsed_events(table(spark, sf_dir, "events"))
    return templates.mine(e).select("template", "count", "percentage")


@query()
def format_detect(spark, sf_dir):
    from cinderlog.sources.adapters import event_json_lines

    return detect.detect(event_json_lines(table(spark, sf_dir, "events"))).select("file", "format", "confidence", "match_rate", "mixed")


@query()
def jaeger_export(spark, sf_dir):
    return export.jaeger_spans(hierarchy.nodes(span_entries(spark, sf_dir), "c-1", naming=False), "c-1")


@query(f"WITH {ENTRIES} SELECT level, count(*)::BIGINT AS n, max(line_number) AS last_line FROM entries GROUP BY ROLLUP (level)")
def sql_rollup(spark, sf_dir):
    from cinderlog.plans.sqlviews import SqlViews

    return SqlViews(spark).load(events(spark, sf_dir)).query("SELECT level, count(*) AS n, max(line_number) AS last_line FROM logs GROUP BY ROLLUP (level)")


@query(f"WITH {POINTS} SELECT e.level, p.field_name, count(*)::BIGINT AS n, round(avg(p.value), 6) AS mean FROM entries e JOIN points p ON e.line_number = p.line_number GROUP BY ALL")
def sql_logs_metrics(spark, sf_dir):
    from cinderlog.plans.sqlviews import SqlViews

    return SqlViews(spark).load(events(spark, sf_dir)).query("SELECT l.level, m.field_name, count(*) AS n, round(avg(m.value), 6) AS mean FROM logs l JOIN metrics m ON l.file = m.file AND l.line_number = m.line_number GROUP BY ALL")


@query(f"WITH {ENTRIES} SELECT thread_id, line_number FROM entries WHERE level = 'ERROR' QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY \"timestamp\" DESC, line_number DESC) = 1")
def sql_qualify(spark, sf_dir):
    from cinderlog.plans.sqlviews import SqlViews

    return SqlViews(spark).load(events(spark, sf_dir)).query("SELECT thread_id, line_number FROM logs WHERE level = 'ERROR' QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY timestamp DESC, line_number DESC) = 1")


@query(f"""WITH {ENTRIES} SELECT service_name, level, count(*)::BIGINT AS n, min(line_number) AS first_line FROM entries GROUP BY ALL""")
def errors_by_service(spark, sf_dir):
    return events(spark, sf_dir).groupBy("service_name", shown_level().alias("level")).agg(F.count("*").alias("n"), F.min("line_number").alias("first_line"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by service over time: page of the latest errors with their rank in their service."""
    rank = Window.partitionBy("service_name").orderBy(F.desc("timestamp"), *[F.desc(c) for c in POSITION])
    found = events(spark, sf_dir).where(Filters(level="error").column()).withColumn("rank", F.row_number().over(rank)).where("rank <= 5")
    return found.select("service_name", "rank", "timestamp", "message", "thread_id", "line_number")
