"""Operators on the exact fixtures: known counts, trees, times and clusters."""

from __future__ import annotations

import json
import logging
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import aggregates, correlate, detect, export, follow, hierarchy, metrics, sampling, search, templates
from cinderlog.operators.predicates import EventCondition, Filters, NoTrigger, condition, triggers
from cinderlog.plans.joins import as_of, prefixes
from cinderlog.plans.sqlviews import RefusedSql, SqlViews, translated
from cinderlog.schema import as_entries
from cinderlog.sources.text import read_logs

LEVELS = ("INFO", "DEBUG", "WARN", "ERROR")


@pytest.fixture(scope="module")
def hundred(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("logs") / "app.log"
    path.write_text("\n".join(json.dumps({"timestamp": f"2024-01-15T10:{i // 60:02d}:{i % 60:02d}Z", "level": LEVELS[i % 4], "message": f"Log message number {i}", "thread_id": f"worker-{i % 4}", "correlation_id": f"req-{i % 10}", "service": "test-service", "line_index": i}) for i in range(100)))
    return read_logs(spark, [str(path)]).persist()


def test_hundred_lines(hundred):
    assert {r["level"]: r["n"] for r in aggregates.by_level(hundred).collect()} == dict.fromkeys(LEVELS, 25)
    ids = {(r["kind"], r["id"]): r["n"] for r in aggregates.extract_ids(hundred).collect()}
    assert all(ids["thread", f"worker-{i}"] == 25 for i in range(4)) and all(ids["correlation", f"req-{i}"] == 10 for i in range(10)) and ids["service", "test-service"] == 100
    assert search.count(hundred, Filters(level="error,warn")) == 50 and search.count(hundred, Filters(exclude_level="err")) == 75
    assert search.count(hundred, Filters(query="NUMBER 9[0-9]")) == 10
    assert [r["line_number"] for r in search.search(hundred, Filters(level="error"), limit=3, offset=1).collect()] == [8, 12, 16]
    assert [r["line_number"] for r in search.search(hundred, tail_n=2, limit=1).collect()] == [99, 100]
    meta = aggregates.file_metadata(hundred).first()
    assert (meta["total_entries"], meta["format"], meta["unique_threads"], meta["available_fields"]) == (100, "Json", 4, ["line_index"])
    assert aggregates.triage(hundred).first()["severity"] == "critical"
    assert {r["field"]: r["presence"] for r in aggregates.schema_presence(hundred).collect()}["fields.line_index"] == 1.0


def test_null_levels_and_times(spark):
    e = as_entries(spark.createDataFrame([("f", 1, None, None), ("f", 2, "ERROR", datetime(2024, 1, 1)), ("f", 3, "UNKNOWN", datetime(2024, 1, 2))], "file string, line_number long, level string, timestamp timestamp_ntz"))
    lines = lambda f: [r["line_number"] for r in e.where(f.column()).orderBy("line_number").collect()]
    assert lines(Filters(level="error")) == [2] and lines(Filters(exclude_level="error")) == [1, 3] and lines(Filters(level="unknown")) == [3]
    assert lines(Filters(time_start=datetime(2024, 1, 2))) == [1, 3] and lines(Filters(time_end=datetime(2024, 1, 1))) == [1, 2]
    assert {r["level"]: r["n"] for r in aggregates.by_level(e).collect()} == {"UNKNOWN": 2, "ERROR": 1}
    assert [r["line_number"] for r in search.search(e).collect()] == [2, 3, 1]
    assert follow.period_facts(follow.period(e, datetime(2024, 1, 1), datetime(2024, 1, 1))).first()["total"] == 2


def test_context(hundred):
    file = hundred.first()["file"]
    assert [(r["line_number"], r["part"]) for r in search.context(hundred, file, 2, 3, 1).collect()] == [(1, "before"), (2, "target"), (3, "after")]
    with pytest.raises(search.LineNotFound):
        search.context(hundred, file, 200)
    one = search.with_context(hundred, F.col("line_number") == 5, 2, 1).first()
    assert [x["line_number"] for x in one["context_before"]] == [3, 4] and [x["line_number"] for x in one["context_after"]] == [6]


@pytest.fixture(scope="module")
def services(spark):
    rows = [(f"{s}.log", i + 1, f"2024-01-15 10:00:{i:02d}", "ERROR" if i % 5 == 0 else "INFO", f"{s} processing request {i}", f"{s}-thread-{i % 3}", f"req-{i % 5}", "trace-main", s) for s in ("api", "auth", "db") for i in range(30)]
    return as_entries(spark.createDataFrame(rows, "file string, line_number long, timestamp string, level string, message string, thread_id string, correlation_id string, trace_id string, service_name string"))


def test_services(services):
    assert follow.follow(services, correlation_id="req-1").count() == 18 and follow.follow(services, trace_id="trace-main").count() == 90
    line = follow.timeline(services, correlation_id="req-2").collect()
    assert len(line) == 18 and line[0]["relative_ms"] == 0 and line[-1]["relative_ms"] == 25_000
    assert {r["service_name"] for r in line} == {"api", "auth", "db"}
    found = follow.compare_threads(services, {"correlation_id": "req-0"}, {"correlation_id": "req-1"})
    assert found["a"].first()["errors"] == 18 and found["b"].first()["errors"] == 0 and found["only_in_b"].count() == 10
    assert follow.divergence(services, {"correlation_id": "req-0"}, {"correlation_id": "req-1"}).first()["step"] == 1


@pytest.fixture(scope="module")
def spans(spark):
    def line(n, ts, span, parent, message, level="INFO", **fields):
        return ("t.log", n, f"2024-01-15 10:00:{ts}", level, message, "trace-1", span, parent, {k: json.dumps(v) for k, v in fields.items()})

    rows = [
        line(1, "00.000", "root", None, "start", operation_name="GET /"), line(2, "01.000", "root", None, "end"), line(3, "00.100", "fast", "root", "f", duration_ms=100),
        line(4, "00.200", "child-slow", "root", "s", "ERROR"), line(5, "01.000", "child-slow", "root", "s2"), line(6, "00.950", "late", "root", "l", duration_ms=100),
        line(7, "00.300", "leaf", "child-slow", "x", "FATAL", duration_ms=10),
    ]
    return as_entries(spark.createDataFrame(rows, "file string, line_number long, timestamp string, level string, message string, trace_id string, span_id string, parent_span_id string, fields map<string,string>"))


def test_tree(spans):
    table = hierarchy.nodes(spans, "trace-1").persist()
    rows = table.orderBy("position").collect()
    assert [(r["id"], r["depth"], r["duration_ms"]) for r in rows] == [("root", 0, 1000), ("fast", 1, 100), ("child-slow", 1, 800), ("leaf", 2, 10), ("late", 1, 100)]
    assert rows[0]["name"] == "GET /" and rows[1]["confidence"] == 1.0 and rows[2]["error_count"] == 1
    total = hierarchy.total_duration(table).first()
    assert (total["total_nodes"], total["max_depth"], total["total_duration_ms"], total["concurrent_count"]) == (5, 2, 1000, 2)
    top = hierarchy.bottleneck(table).first()
    assert (top["node_id"], top["duration_ms"], top["percentage"]) == ("child-slow", 790, 79.0)
    assert [r["id"] for r in hierarchy.error_nodes(table).collect()] == ["child-slow", "leaf"]
    causes = hierarchy.root_causes(table).collect()
    assert [(c["id"], c["is_leaf"], c["confidence"]) for c in causes] == [("leaf", True, 1.0)]
    assert [r["chain"] for r in hierarchy.propagation(table).collect()] == [["leaf", "child-slow"]]
    assert hierarchy.impact(table).first()[:] == (2, 40.0, 2, 0) and [r['rule'] for r in hierarchy.recommendations(table).collect()] == ['first_cause', 'outside_call', 'cascade']
    assert hierarchy.secondary_bottlenecks(table).count() == 0 and [r["depth"] for r in hierarchy.parallel_savings(table).collect()] == [1]
    assert [r["id"] for r in hierarchy.circuit_breakers(table).collect()] == ["child-slow"]
    from cinderlog import render

    tree = render.collect_tree(table)
    assert [k["id"] for k in tree[0]["children"]] == ["fast", "child-slow", "late"]
    assert render.tree(tree).splitlines()[2].startswith("├─ child-slow") and "leaf" in render.flamegraph(tree) + render.waterfall(tree)
    jaeger = export.to_jaeger(table, "trace-1")["data"][0]
    assert len(jaeger["spans"]) == 5 and len({s["spanID"] for s in jaeger["spans"]}) == 5 and not jaeger["spans"][0]["references"]
    assert len(export.to_zipkin(table, "trace-1")) == 5 and export.to_otlp(table, "trace-1")["resourceSpans"][0]["scopeSpans"][0]["spans"][2]["status"] == {"code": 2}


def test_cycles_end_and_names_give_children(spark):
    loop = as_entries(spark.createDataFrame([("f", 1, "a", "b", "t"), ("f", 2, "b", "a", "t"), ("f", 3, "r", None, "t"), ("f", 4, "a", "r", "t")], "file string, line_number long, span_id string, parent_span_id string, trace_id string"))
    assert sorted(r["id"] for r in hierarchy.nodes(loop, "r", naming=False).collect()) == ["a", "b", "r"]
    named = as_entries(spark.createDataFrame([("f", 1, "worker-1"), ("f", 2, "worker-1.task-a"), ("f", 3, "worker-12"), ("f", 4, "worker-1:x")], "file string, line_number long, thread_id string"))
    found = hierarchy.nodes(named, "worker-1").collect()
    assert sorted(r["id"] for r in found if r["depth"] == 1) == ["worker-1.task-a", "worker-1:x"]
    got = {(r["id"], r["prefix"]) for r in prefixes(spark.createDataFrame([("a.b-c",)], "id string"), "id", ".:-").collect()}
    assert got == {("a.b-c", "a"), ("a.b-c", "a.b")}


def test_diff_and_chains(spark):
    side = lambda rows: spark.createDataFrame(rows, "id string, duration_ms long, error_count long")
    got = {r["id"]: (r["status"], r["errors"]) for r in hierarchy.diff(side([("a", 100, 0), ("b", 100, 1), ("c", 5, 0)]), side([("a", 150, 2), ("b", 95, 0), ("d", 1, 0)])).collect()}
    assert got == {"a": ("degraded", "new"), "b": ("same", "resolved"), "c": ("removed", None), "d": ("new", None)}
    e = as_entries(spark.createDataFrame([("f", 1, "p", "Spawning sub-request: c1", None), ("f", 2, "c1", "parent_request_id=p", {"child_correlation_id": '"c2"'}), ("f", 3, "solo", "x", None)], "file string, line_number long, correlation_id string, message string, fields map<string,string>"))
    links = hierarchy.chains(e)
    assert {(r["parent"], r["child"], float(r["confidence"])) for r in links.collect()} == {("p", "c1", 0.85), ("c1", "c2", 1.0)}
    assert sorted(r["id"] for r in hierarchy.chain_roots(e, links).collect()) == ["p", "solo"]
    assert {r["key"]: r["depth"] for r in hierarchy.descendants(links, "p").collect()} == {"p": 0, "c1": 1, "c2": 2}


def test_sensor_numbers(spark):
    values = [22.4 + 0.1 * (i % 5) for i in range(18)] + [85.2, 120.0]
    rows = [("s", i + 1, f"2024-01-15 10:00:{i:02d}", f"temperature={v:.1f}°C humidity=45% port=80 took 5ms") for i, v in enumerate(values)]
    e = as_entries(spark.createDataFrame(rows, "file string, line_number long, timestamp string, message string"))
    points = metrics.extract(e).persist()
    stats = {r["field_name"]: r for r in metrics.series_stats(points).collect()}
    assert set(stats) == {"temperature", "humidity", "duration"}
    assert (stats["temperature"]["n"], stats["temperature"]["min"], stats["temperature"]["max"], stats["temperature"]["unit"]) == (20, 22.4, 120.0, "°C")
    assert {r["value"] for r in metrics.anomalies(points).collect()} == {85.2, 120.0}
    buckets = metrics.time_buckets(points.where("field_name = 'humidity'"), "5s").orderBy("bucket").collect()
    assert [b["n"] for b in buckets] == [5, 5, 5, 5]


def test_rolling_is_that_of_plain_python_without_a_moving_frame(spark, capsys):
    rng, us = random.Random(4), 3_600_000_000
    # ties, windows' very ends, times before 1970, null values and times, several series and names that clash
    times = [-us, -1, 0, 1, us - 1, us, us + 1, 2 * us, 2 * us + 1] + [rng.randrange(-3 * us, 6 * us) for _ in range(200)] + [us // 2] * 5
    rows = [(f"s{i % 2}", i, t, None if i % 7 == 3 else rng.randrange(1000) / 4) for i, t in enumerate(times)] + [("s0", 999, None, 1.0), ("empty", 1000, 5, None)]
    points = spark.createDataFrame(rows, "field_name string, line_number long, us long, value double")
    points = points.select("field_name", "line_number", F.timestamp_add("MICROSECOND", "us", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("timestamp"), "value", F.lit(1).alias("at.x"))
    found = metrics.rolling(points, 3600)
    assert found.columns == [*points.columns, "n_near", "avg_near"]
    want = {}
    for name, i, t, _ in rows:
        if t is not None:
            near = [v for f, _, u, v in rows if f == name and u is not None and t - us <= u <= t]
            known = [v for v in near if v is not None]
            want[i] = (len(near), round(sum(known) / len(known), 6) if known else None)
    got = {r["line_number"]: (r["n_near"], r["avg_near"]) for r in found.collect()}
    assert got.keys() == want.keys() and all(got[i][0] == n and got[i][1] == pytest.approx(m, abs=2e-6) for i, (n, m) in want.items())
    found.explain()
    frames = re.findall(r"RangeFrame, ([^,]+),", capsys.readouterr().out)
    assert frames and set(frames) == {"unboundedpreceding$()"}


_FIELD = r"[^\Wa-zA-Z_]*(?P<f>[a-zA-Z_]\w*)\s*[=:]\s*(?P<v>-?\d+(?:\.\d+)?)\s*(?P<u>ms|s|us|ns|MB|GB|KB|kPa|°[CF]|%|rpm|Hz)?"


def test_names_resume_where_the_last_match_ended(spark):
    texts = ["a=1b=2 c:3", "x1=5 9lives=3 pid=4 a=1 a=2", "t = 3.5ms:rest", "é=4 éb=5", "took 45ms", "a=1ms took 3s", "no numbers", "=5", "k=-2.50%"]
    e = as_entries(spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, line_number long, message string"))
    got = {}
    for r in metrics.extract(e).collect():
        got.setdefault(r["line_number"], set()).add((r["field_name"], r["value"], r["unit"]))
    for i, text in enumerate(texts):
        want, at, seen = set(), 0, set()
        while m := re.compile(_FIELD).match(text, at) or re.compile(r"(?<!\w)" + _FIELD).search(text, at):
            at = m.end()
            if m["f"] not in seen and m["f"].lower() not in metrics.NO_MEASURE:
                want.add((m["f"], float(m["v"]), m["u"]))
                seen.add(m["f"])
        if (m := re.search(r"(?:took|elapsed|duration|latency|time|response_time)\s*(?:[:=]\s*)?(\d+(?:\.\d+)?)\s*(ms|s|us|ns)", text)) and "duration" not in seen:
            want.add(("duration", float(m[1]), m[2]))
        assert got.get(i, set()) == want, text


def test_rules(spark, services):
    rules = correlate.parse_rules({"g": {"rules": [{"type": "field_match", "source": {"file_pattern": "api.log", "field": "correlation_id"}, "target": {"file_pattern": "db*", "field": "correlation_id"}}, {"type": "temporal", "anchor": {"file_pattern": "auth.log", "level": "ERROR"}, "window": "1s"}]}})
    clusters, total = correlate.by_rules(services, rules)
    kinds = {}
    for r in clusters.collect():
        kinds.setdefault(r["rule_type"], []).append(r["entry_count"])
    assert kinds["field_match"] == [12] * 5 and sorted(kinds["temporal"]) == [6, 9, 9, 9, 9, 9] and total.first()["total_clusters"] == 11
    with pytest.raises(correlate.BadRules):
        correlate.parse_rules({"g": {"rules": [{"type": "temporal", "anchor": {}, "window": "0s"}]}})
    with pytest.raises(correlate.UnknownGroup):
        correlate.by_rules(services, rules, "none")
    assert correlate.around(services, "2024-01-15T10:00:05Z", "500ms").count() == 3
    assert {r["entry_count"] for r in correlate.by_trigger(services, EventCondition(level="ERROR", file_pattern="db.log"), "500ms").collect()} == {3}
    with pytest.raises(NoTrigger):
        triggers(services, EventCondition())
    assert services.select(condition(F.lit("5"), ">= 5").alias("a"), condition(F.lit("x"), "> 1").alias("b"), condition(F.lit("5"), "like").alias("c")).first()[:] == (True, False, False)


def test_samples(hundred):
    for strategy in sampling.STRATEGIES:
        assert sampling.sample(hundred, strategy, 20).count() == 20, strategy
        assert sampling.sample(hundred, strategy, 500).count() == 100, strategy
    one = sampling.sample(hundred, "representative", 20)
    assert {r["n"] for r in aggregates.by_level(one).collect()} == {5}
    assert aggregates.by_level(sampling.sample(hundred, "errors_focused", 20)).where("level = 'ERROR'").first()["n"] == 14
    assert sampling.coverage(hundred, one).first()["thread_coverage"] == 1.0


def test_quotas_add_up(spark):
    counts = spark.createDataFrame([("INFO", 9000), ("WARN", 900), ("ERROR", 99), ("FATAL", 1)], "level string, n long")
    for size in (4, 5, 7, 100):
        got = {r["level"]: r["quota"] for r in sampling.quotas(counts, size).collect()}
        assert sum(got.values()) == size and min(got.values()) >= 1


def _drain(messages, most):
    leaves, n, out = {}, 0, []
    for m in messages:
        words = m.split()
        if not words:
            continue
        first = templates.ANY if re.match(templates.VARIABLE.replace(r"\A", "^").replace(r"\z", "$"), words[0]) else words[0]
        leaf = leaves.setdefault((len(words), first), [])
        best = max(leaf, key=lambda t: t.likeness(words), default=None)
        if best is None or best.likeness(words) < 0.5:
            if n >= most:
                continue
            n += 1
            best = templates.Template(words, (0, 0))
            leaf.append(best)
            out.append(best)
        best.take(words, m)
    return sorted((" ".join(t.words), t.count) for t in out)


@pytest.mark.parametrize("most", [3, 200])
def test_templates_equal_a_sequential_run(spark, most):
    import random

    rng = random.Random(4)
    shapes = ["user {} logged in", "user {} logged out", "disk {} is full now", "{} requests served", "GET /a/{} took {} ms", "", "job {} failed with code {}", "cache miss for {}"]
    messages = [rng.choice(shapes).replace("{}", "%d" % rng.randrange(50), 1).replace("{}", "%d" % rng.randrange(5)) for _ in range(400)]
    e = as_entries(spark.createDataFrame([("f", i, m) for i, m in enumerate(messages)], "file string, line_number long, message string")).repartition(3)
    mined = templates.mine(e, most=most)
    assert sorted((r["template"], r["count"]) for r in mined.collect()) == _drain(messages, most)
    assert templates.coverage(e, mined).first()["total_lines"] == 400


def test_detection(spark):
    lines = [("j", i, '{"a":%d}' % i) for i in range(5)] + [("l", i, "a=1 b=2 c=3") for i in range(4)] + [("l", 9, "# comment"), ("l", 10, "")] + [("c", 1, '1.2.3.4 - - [15/Jan/2024:10:00:00 +0000] "GET / HTTP/1.1" 200 5')]
    got = {r["file"]: r for r in detect.detect(spark.createDataFrame(lines, "file string, line_number long, raw string")).collect()}
    assert (got["j"]["format"], got["j"]["confidence"]) == ("json", 0.98) and (got["l"]["format"], got["l"]["sample_size"]) == ("logfmt", 4) and got["c"]["format"] == "common_log"


def test_sql_views(spark, hundred):
    views = SqlViews(spark).load(hundred)
    assert views.query("SELECT level, count(*) AS n FROM logs GROUP BY level HAVING n > 10").count() == 4
    assert views.query("SELECT quantile_cont(value, 0.5) AS m, arg_max(line_number, value) AS l FROM metrics WHERE field_name = 'line_index'").first()[:] == (49.5, 100)
    assert views.query("SELECT strftime(timestamp, '%H:%M') AS t FROM logs WHERE line_number = 1").first()["t"] == "10:00"
    for bad in ("DROP TABLE logs", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc/x`", "INSERT INTO logs SELECT * FROM logs"):
        with pytest.raises(RefusedSql):
            views.query(bad)
    assert translated("SELECT 'list(x)' , list(x) FROM logs") == "SELECT 'list(x)' , collect_list(x) FROM logs"
    assert views.tables() == ["logs", "metrics"] and views.describe("metrics")[3]["column"] == "field_name"


def test_as_of(spark):
    left = spark.createDataFrame([("k", 1, "2024-01-01 00:00:05"), ("k", 2, "2024-01-01 00:00:00"), ("z", 3, "2024-01-01 00:00:05")], "key string, i int, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    right = spark.createDataFrame([("k", "a", "2024-01-01 00:00:01"), ("k", "b", "2024-01-01 00:00:05")], "key string, v string, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    assert {r["i"]: r["r_v"] for r in as_of(left, right, "key").collect()} == {1: "b", 2: None, 3: None}


def test_registered_functions(spark):
    from cinderlog.functions.register import register

    register(spark)
    row = spark.sql("SELECT level_of('Warning') AS a, level_of('x') AS b, level_text(' ') AS c, virtual_trace_id('g', '0', 'k') AS d, level_of_number(3) AS e, no_id(repeat('0', 16)) AS f").first()
    assert row[:3] == ("WARN", None, "UNKNOWN") and re.fullmatch(r"vt-[0-9a-f]{12}", row["d"]) and row[4:] == ("ERROR", None)


def test_session_and_producer(spark, tmp_path):
    from cinderlog.session import FileCache, Investigator, Session
    from cinderlog.structured import JsonHandler, correlation_context

    path = tmp_path / "own.log"
    log = logging.getLogger("own")
    log.addHandler(handler := JsonHandler(str(path), "svc"))
    with correlation_context("req-1"):
        log.error("bad %s", "thing", extra={"n": 3})
    log.warning("alone")
    handler.close()
    cache = FileCache()
    inv = Investigator(spark, [str(path)], cache)
    one, two = inv.search().collect()
    assert (one["level"], one["correlation_id"], one["service_name"], one["message"], one["fields"]["n"]) == ("ERROR", "req-1", "svc", "bad thing", "3") and two["correlation_id"] is None
    assert Investigator(spark, [str(path)], cache).entries is inv.entries and inv.sql("SELECT count(*) AS n FROM logs").first()["n"] == 2
    s = Session("case", [str(path)])
    s.note("a")
    s.conclude("b")
    assert s.undo() and len(s.steps) == 1 and s.redo() and len(s.steps) == 2
    s.save(str(tmp_path / "s" / "case.json"))
    assert Session.load(str(tmp_path / "s" / "case.json")) == s and "## " not in s.report() and "Conclusion" in s.report()
    cache.clear()


def test_commands(spark, tmp_path, capsys):
    from cinderlog.cli import FOUND, MISTAKE, NOTHING, main

    path = tmp_path / "c.log"
    path.write_text("".join(f"2024-01-15 10:00:0{i} {'ERROR' if i % 2 else 'INFO'} [worker-{i}] step n={i}\n" for i in range(6)))

    def run(*argv):
        code = main(list(argv))
        out = capsys.readouterr().out
        return code, out if argv[0] == "emit" else json.loads(out)

    assert run("search", str(path), "--level", "error", "--output", "count") == (FOUND, {"total": 3})
    code, out = run("search", str(path), "--level", "fatal")
    assert code == NOTHING and out["results"] == []
    assert run("search", str(path), "--level", "nope")[0] == MISTAKE and run("search", str(path), "--query", "(")[0] == MISTAKE
    assert run("sql", str(path), "--sql", "SELECT count(*) AS n FROM logs")[1] == {"results": [{"n": 6}]}
    assert run("metrics", str(path))[1]["stats"][0]["n"] == 6 and run("triage", str(path))[1]["severity"] == "critical"
    assert len(run("emit", str(path), "--compact", "--tail", "2")[1].splitlines()) == 2
    assert run("detect", str(path))[0] == FOUND and run("templates", str(path))[1]["templates"][0]["count"] >= 1
    code, out = run("search", str(path), "--max-bytes", "300", "--output", "compact")
    assert 0 < len(out["results"]) < 6
