"""Commands that print JSON. Exit codes: 0 found, 1 nothing found, 2 a user's mistake, 3 an inner error."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from cinderlog import render
from cinderlog.functions.ids import kind_of_id
from cinderlog.functions.times import time_bound
from cinderlog.operators import aggregates, correlate, detect, export, follow, hierarchy, metrics, sampling, search, templates
from cinderlog.operators.predicates import EventCondition, Filters
from cinderlog.plans.sqlviews import SqlViews
from cinderlog.session import FileCache, Session
from cinderlog.sources.formats import BUILTIN, formats_for, load_formats
from cinderlog.sources.text import expand, numbered_lines

FOUND, NOTHING, MISTAKE, INNER = 0, 1, 2, 3
_cache = FileCache()


def spark_session() -> SparkSession:
    spark = SparkSession.builder.appName("cinderlog").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value: Any) -> Any:
    """Rows, times and containers as JSON values."""
    if isinstance(value, datetime):
        return value.isoformat(timespec="auto").replace("+00:00", "") + "Z"
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple, set)) else value


def rows(df: DataFrame) -> list[dict[str, Any]]:
    return [plain(r) for r in df.collect()]


def filters_of(a: argparse.Namespace) -> Filters:
    now = datetime.fromisoformat(a.now) if getattr(a, "now", None) else datetime.now(UTC).replace(tzinfo=None)
    start = time_bound("-" + a.last, now) if getattr(a, "last", None) else time_bound(getattr(a, "after", None), now)
    many = lambda name: [x for x in (getattr(a, name, None) or "").split(",") if x]
    return Filters(
        level=getattr(a, "level", None), exclude_level=getattr(a, "exclude_level", None), time_start=start, time_end=time_bound(getattr(a, "before", None), now), query=getattr(a, "query", None), exclude_query=getattr(a, "exclude_query", None),
        thread_id=many("thread"), correlation_id=many("correlation"), trace_id=many("trace"), service_name=many("service"),
    )


def entries_of(a: argparse.Namespace) -> DataFrame:
    spark = spark_session()
    if getattr(a, "db", None):
        from cinderlog.sources.sqlite import read_database

        return read_database(spark, a.db, datetime.now(UTC).replace(tzinfo=None))
    return _cache.entries(spark, a.files, getattr(a, "format", None), getattr(a, "regex", None))


def kept(a: argparse.Namespace) -> DataFrame:
    return entries_of(a).where(filters_of(a).column())


def do_search(a: argparse.Namespace) -> Any:
    found = kept(a)
    if a.output == "count":
        return {"total": found.count()}
    if a.output == "summary":
        return {**rows(aggregates.totals(found))[0], "levels": rows(aggregates.by_level(found)), "files": rows(aggregates.by_file(found)), "top_messages": rows(aggregates.top_messages(found)), "samples": rows(sampling.sample(found, "diverse", 5))}
    page = search.search(entries_of(a), filters_of(a), a.limit, a.offset, a.tail)
    results = rows(search.short_keys(page) if a.output == "compact" else page)
    return {"total": found.count(), "results": export.fit(results, a.max_bytes) if a.max_bytes else results}


def do_correlate(a: argparse.Namespace) -> Any:
    kind = a.type if a.type != "auto" else kind_of_id(a.id)
    ids = {f"{kind}_id": a.id}
    return {**rows(follow.follow_summary(entries_of(a), **ids))[0], "entries": rows(follow.follow(entries_of(a), **ids))}


def do_hierarchy(a: argparse.Namespace) -> Any:
    table = hierarchy.nodes(entries_of(a), a.id, naming=not a.no_naming, max_depth=a.max_depth).persist()
    if a.draw:
        tree = render.collect_tree(table)
        return {"text": {"tree": render.tree, "waterfall": render.waterfall, "flamegraph": render.flamegraph, "summary": render.summary}[a.draw](tree)}
    return {**rows(hierarchy.total_duration(table))[0], "bottleneck": next(iter(rows(hierarchy.bottleneck(table))), None), "error_nodes": [r["id"] for r in rows(hierarchy.error_nodes(table))], "nodes": rows(table.orderBy("position"))}


def do_bottleneck(a: argparse.Namespace) -> Any:
    table = hierarchy.nodes(entries_of(a), a.id).persist()
    slow = table.where(f"duration_ms >= {float(a.threshold)}").orderBy("duration_ms", ascending=False).limit(a.top)
    return {"nodes": rows(slow.select("id", "name", "duration_ms", "depth")), "primary": rows(hierarchy.bottleneck(table)), "secondary": rows(hierarchy.secondary_bottlenecks(table)), "parallel": rows(hierarchy.parallel_savings(table)), "caching": rows(hierarchy.cache_candidates(table)), "breakers": rows(hierarchy.circuit_breakers(table))}


def do_export(a: argparse.Namespace) -> Any:
    table = hierarchy.nodes(entries_of(a), a.id)
    return {"jaeger": export.to_jaeger, "zipkin": export.to_zipkin, "otlp": export.to_otlp}[a.to](table, a.id, a.service_name)


def do_compare(a: argparse.Namespace) -> Any:
    x, y = ({f"{kind_of_id(i)}_id": i} for i in (a.a, a.b))
    found = follow.compare_threads(entries_of(a), x, y)
    return {k: rows(v) for k, v in found.items()} | {"divergence": rows(follow.divergence(entries_of(a), x, y))}


def _window(text: str) -> tuple[datetime, datetime]:
    start, _, end = text.partition("/")
    return time_bound(start), time_bound(end)


def do_sql(a: argparse.Namespace) -> Any:
    views = SqlViews(spark_session()).load(entries_of(a))
    return {"results": rows(views.query(a.sql))}


def do_metrics(a: argparse.Namespace) -> Any:
    points = metrics.extract(kept(a)).persist()
    if a.field:
        points = points.where(points["field_name"] == a.field)
    return {"stats": rows(metrics.series_stats(points)), "anomalies": rows(metrics.anomalies(points, a.threshold)), **({"buckets": rows(metrics.time_buckets(points, a.bucket))} if a.bucket else {})}


def do_correlations(a: argparse.Namespace) -> Any:
    rules = correlate.parse_rules((load_formats(a.config) if a.config else formats_for(expand(a.files)[0])).correlations)
    if a.action == "list":
        return {"groups": {n: {"description": g.description, "rules": len(g.rules)} for n, g in rules.groups.items()}}
    clusters, total = correlate.by_rules(entries_of(a), rules, a.group)
    return {"clusters": rows(clusters), **rows(total)[0]}


def do_correlate_events(a: argparse.Namespace) -> Any:
    if a.at:
        found = rows(search.page(correlate.around(entries_of(a), a.at, a.window), 0))
        return {"clusters": [{"anchor_timestamp": a.at, "entry_count": len(found), "entries": found}] if found else []}
    return {"clusters": rows(correlate.by_trigger(entries_of(a), EventCondition(a.file_pattern, a.trigger_level, a.pattern, a.field, a.condition), a.window))}


def do_format(a: argparse.Namespace) -> Any:
    if a.action == "list":
        return {"formats": {n: {"file_patterns": f.file_patterns, "timestamp_format": f.timestamp_format} for n, f in BUILTIN.items()}}
    if a.action == "validate":
        found = load_formats(a.files[0])
        return {"valid": True, "formats": sorted(found.formats)}
    fmt = BUILTIN[a.name] if a.name in BUILTIN else load_formats(a.config).formats[a.name]
    parsed = _cache.entries(spark_session(), a.files, None, fmt.regex).groupBy("format").count()
    return {"formats": rows(parsed)}


def do_session(a: argparse.Namespace) -> Any:
    home = Path(a.home or Path.home() / ".cinderlog" / "sessions")
    path = str(home / f"{a.name}.json") if a.name else ""
    if a.action == "list":
        return {"sessions": sorted(p.stem for p in home.glob("*.json"))}
    session = Session(a.name, a.files or []) if a.action == "create" else Session.load(path)
    if a.action == "note":
        session.note(a.text)
    elif a.action == "conclude":
        session.conclude(a.text)
    elif a.action == "query":
        session.add("query", text=a.text)
    session.save(path)
    return {"session": session.__dict__, "report": session.report()}


def do_emit(a: argparse.Namespace) -> Any:
    found = search.raw_page(kept(a), a.limit or 10_000)
    lines = [r["value"] for r in export.json_lines(search.short_keys(found) if a.compact else found, a.fields.split(",") if a.fields else None).collect()]
    return "\n".join(lines[-a.tail :] if a.tail else lines)


COMMANDS: dict[str, tuple[Callable[[argparse.Namespace], Any], str]] = {
    "search": (do_search, "page page2"), "schema": (lambda a: {"fields": rows(aggregates.schema_presence(entries_of(a))), "levels": rows(aggregates.by_level(entries_of(a))), "ids": rows(aggregates.id_shapes(entries_of(a)))}, ""),
    "ids": (lambda a: {"ids": rows(aggregates.extract_ids(kept(a)).orderBy("kind", "n", ascending=[True, False]))}, ""), "sample": (lambda a: {"entries": rows(sampling.sample(kept(a), a.strategy, a.size))}, "sample"),
    "triage": (lambda a: {**rows(aggregates.triage(kept(a)))[0], "patterns": rows(aggregates.repeated_errors(kept(a)).orderBy("n", ascending=False).limit(10))}, ""),
    "summarize": (lambda a: {**rows(aggregates.summarize(kept(a)))[0], "levels": rows(aggregates.by_level(kept(a))), "first_errors": rows(aggregates.first_of_level(kept(a), "ERROR", 10)), "first_warnings": rows(aggregates.first_of_level(kept(a), "WARN", 5))}, ""),
    "sql": (do_sql, "sql"), "correlate": (do_correlate, "id"), "hierarchy": (do_hierarchy, "id tree"), "bottleneck": (do_bottleneck, "id top"), "context": (lambda a: {"entries": rows(search.context(entries_of(a), expand(a.files)[0], a.line, a.lines, a.lines))}, "line"),
    "export": (do_export, "id to"), "compare": (do_compare, "ab"), "diff": (lambda a: rows(follow.windows_diff(entries_of(a), _window(a.a), _window(a.b)))[0], "ab"), "session": (do_session, "session"), "detect": (lambda a: {"files": rows(detect.detect(numbered_lines(spark_session(), expand(a.files))))}, ""),
    "templates": (lambda a: {"templates": rows(templates.mine(kept(a)))}, ""), "format": (do_format, "format"), "correlation": (do_correlations, "rules"), "correlate-events": (do_correlate_events, "trigger"), "metrics": (do_metrics, "metrics"),
    "verify-pattern": (lambda a: {"groups": rows(aggregates.verify_pattern(kept(a), a.pattern))}, "pattern"), "emit": (do_emit, "emit"), "stats": (lambda a: {"files": rows(aggregates.stats(kept(a))), "threads": rows(aggregates.thread_levels(kept(a)))}, ""), "metadata": (lambda a: {"files": rows(aggregates.file_metadata(kept(a)))}, ""),
}
_OPTIONS: dict[str, list[tuple[list[str], dict[str, Any]]]] = {
    "page": [(["--limit"], {"type": int}), (["--offset"], {"type": int, "default": 0}), (["--tail"], {"type": int}), (["--max-bytes"], {"type": int})], "page2": [(["--output"], {"choices": ["full", "summary", "count", "compact"], "default": "full"})],
    "sample": [(["--strategy"], {"default": "representative"}), (["--size"], {"type": int, "default": 100})], "sql": [(["--sql"], {"required": True})], "id": [(["--id"], {"required": True}), (["--type"], {"default": "auto"}), (["--service-name"], {"default": export.SERVICE})],
    "tree": [(["--max-depth"], {"type": int, "default": hierarchy.MAX_DEPTH}), (["--no-naming"], {"action": "store_true"}), (["--draw"], {"choices": ["tree", "waterfall", "flamegraph", "summary"]})], "top": [(["--threshold"], {"type": float, "default": 0}), (["--top"], {"type": int, "default": 10})],
    "line": [(["--line"], {"type": int, "required": True}), (["--lines"], {"type": int, "default": 10})], "to": [(["--to"], {"choices": ["jaeger", "zipkin", "otlp"], "default": "jaeger"})], "ab": [(["--a"], {"required": True}), (["--b"], {"required": True})],
    "session": [(["--action"], {"default": "list"}), (["--name"], {}), (["--text"], {}), (["--home"], {})], "format": [(["--action"], {"default": "list"}), (["--name"], {}), (["--config"], {})], "rules": [(["--action"], {"default": "run"}), (["--group"], {}), (["--config"], {})],
    "trigger": [(["--at"], {}), (["--window"], {"default": "5s"}), (["--trigger-level"], {}), (["--pattern"], {}), (["--file-pattern"], {}), (["--field"], {}), (["--condition"], {})], "metrics": [(["--field"], {}), (["--threshold"], {"type": float, "default": 2.0}), (["--bucket"], {})],
    "pattern": [(["--pattern"], {"required": True})], "emit": [(["--limit"], {"type": int}), (["--tail"], {"type": int}), (["--fields"], {}), (["--compact"], {"action": "store_true"})],
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cinderlog")
    sub = top.add_subparsers(dest="command", required=True)
    for name, (_, groups) in COMMANDS.items():
        p = sub.add_parser(name)
        p.add_argument("files", nargs="*")
        for option in ("--format", "--regex", "--db", "--level", "--exclude-level", "--query", "--exclude-query", "--thread", "--correlation", "--trace", "--service", "--after", "--before", "--last", "--now"):
            p.add_argument(option)
        for g in groups.split():
            for names, options in _OPTIONS[g]:
                p.add_argument(*names, **options)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        out = COMMANDS[a.command][0](a)
    except (ValueError, LookupError, OSError) as e:
        print(json.dumps({"error": str(e), "type": type(e).__name__}))
        return MISTAKE
    except Exception as e:
        print(json.dumps({"error": str(e)[:2000], "type": type(e).__name__}))
        return INNER
    print(out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, default=str))
    empty = not out or isinstance(out, dict) and (out.get("results") == [] or out.get("total") == 0)
    return NOTHING if empty else FOUND


if __name__ == "__main__":
    sys.exit(main())
