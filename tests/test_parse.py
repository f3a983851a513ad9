"""Formats, levels, timestamps and ids of single lines."""

from __future__ import annotations

from datetime import datetime

import pytest

from cinderlog.sources.parse import parse

CASES = [
    # raw, expected fields
    ('{"timestamp":"2024-01-15T10:00:00.5Z","level":"warn","msg":"hi","thread":7,"x":1.5}', {"format": "Json", "timestamp": datetime(2024, 1, 15, 10, 0, 0, 500000), "level": "WARN", "message": "hi", "thread_id": "7", "fields": {"x": "1.5"}}),
    ('{"ts":1700000000,"level":30,"text":"n"}', {"timestamp": datetime(2023, 11, 14, 22, 13, 20), "level": "INFO", "message": "n", "fields": {}}),
    ('{"ts":1700000000123,"level":31,"text":"n"}', {"timestamp": datetime(2023, 11, 14, 22, 13, 20, 123000), "level": None, "fields": {"level": "31"}}),
    ('{"level":30,"severity":"error","b":1,"b":2,"message":"m"}', {"level": "ERROR", "fields": {"level": "30", "b": "2"}}),
    ('{"level":"odd","z":1,"a":"x"}', {"level": "UNKNOWN", "message": '{"a":"x","level":"odd","z":1}'}),
    ('{"trace_id":"00000000000000000000000000000000","span_id":"abc","message":"m"}', {"trace_id": None, "span_id": "abc"}),
    ('{"a":1} tail', {"format": "PlainText"}),
    ("2024-01-15 10:00:00 warn disk is slow", {"format": "PlainText", "timestamp": datetime(2024, 1, 15, 10), "level": "WARN"}),
    ("[2024-01-15 10:00:00,250] ERROR [worker-1] boom request_id=r-7", {"timestamp": datetime(2024, 1, 15, 10, 0, 0, 250000), "level": "ERROR", "thread_id": "worker-1", "correlation_id": "r-7"}),
    ("2024-01-15 10:00:00 +0900 INFO zone", {"timestamp": datetime(2024, 1, 15, 1)}),
    ("2024-01-15 10:00:00 -1234 widgets", {"timestamp": datetime(2024, 1, 15, 10)}),
    ("2024-01-15T10:00:60Z leap", {"timestamp": datetime(2024, 1, 15, 10, 0, 59)}),
    ("error: disk full", {"level": "ERROR"}),
    ("an error in a sentence", {"level": None}),
    ("all fine [info] then ERROR", {"level": "INFO"}),
    ("[WARN] [pool-thread-3] x", {"level": "WARN", "thread_id": "pool-thread-3"}),
    ("<34>Oct 11 22:14:15 host su: failed", {"format": "Syslog", "level": "FATAL", "timestamp": None, "message": "Oct 11 22:14:15 host su: failed"}),
    ("Mar 15 03:00:00 host sshd[12]: Failed password for x", {"format": "Syslog", "level": "ERROR", "thread_id": None}),
    ('1.2.3.4 - - [15/Jan/2024:10:00:00 +0100] "GET / HTTP/1.1" 503 12', {"format": "CommonLog", "level": "ERROR", "timestamp": datetime(2024, 1, 15, 9), "message": "1.2.3.4 GET / HTTP/1.1 503"}),
    ('2024-01-15T15:00:00Z INFO service=api msg="a b" n=4 f=1.50 ok=TRUE n=5', {"format": "Logfmt", "level": "INFO", "timestamp": datetime(2024, 1, 15, 15), "service_name": "api", "message": "a b", "fields": {"service": '"api"', "msg": '"a b"', "n": "5", "f": "1.5", "ok": "true"}}),
    ("a=1 b=2", {"format": "Logfmt", "level": "UNKNOWN", "message": "a=1 b=2"}),
]


@pytest.fixture(scope="module")
def parsed(spark):
    lines = spark.createDataFrame([("f", i, raw) for i, (raw, _) in enumerate(CASES)], "file string, line_number long, raw string")
    return {r["line_number"]: r for r in parse(lines).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_line(parsed, i):
    got = parsed[i].asDict()
    assert {k: got[k] for k in CASES[i][1]} == CASES[i][1]


def test_blank_lines_are_no_entries(spark):
    lines = spark.createDataFrame([("f", 1, ""), ("f", 2, " \t\x1c"), ("f", 3, " x")], "file string, line_number long, raw string")
    assert [r["line_number"] for r in parse(lines).collect()] == [3]


def test_custom_regex(spark):
    lines = spark.createDataFrame([("f", 1, "15/01/2024 10:00:00|ERROR|T-1|went wrong|zz"), ("f", 2, "2024-01-15 10:00:00 INFO other")], "file string, line_number long, raw string")
    regex = r"^(?P<timestamp>[^|]+)\|(?P<level>\w+)\|(?P<thread_id>[^|]+)\|(?P<message>[^|]+)\|(?P<extra_1>\w+)"
    one, two = parse(lines, custom_regex=regex, timestamp_format="%d/%m/%Y %H:%M:%S").orderBy("line_number").collect()
    assert (one["format"], one["timestamp"], one["level"], one["thread_id"], one["message"], one["fields"]) == ("Custom", datetime(2024, 1, 15, 10), "ERROR", "T-1", "went wrong", {"extra_1": '"zz"'})
    assert (two["format"], two["level"]) == ("PlainText", "INFO")


def test_line_numbers_over_many_splits(spark, tmp_path):
    from cinderlog.sources.text import numbered_lines, tail

    path = tmp_path / "a.log"
    path.write_bytes(b"\xef\xbb\xbf" + b"".join(b"line %d\r\n\n" % i for i in range(3000)) + b"last")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r["line_number"]: r["raw"] for r in numbered_lines(spark, [str(path)]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 6001 and got[1] == "line 0" and got[2] == "" and got[5999] == "line 2999" and got[6001] == "last"
    assert [r["line_number"] for r in tail(numbered_lines(spark, [str(path)]), 2).orderBy("line_number").collect()] == [6000, 6001]


@pytest.mark.parametrize("fmt", ["%Y-%m-%d %Z", "%H:%M", "%Y %Y", "%q"])
def test_refused_timestamp_formats(fmt):
    from cinderlog.functions.strptime import BadTimestampFormat, compiled

    with pytest.raises(BadTimestampFormat):
        compiled(fmt)


def test_builtin_formats_have_patterns_that_java_takes(spark):
    from cinderlog.functions.patterns import to_java
    from cinderlog.sources.formats import BUILTIN

    assert len(BUILTIN) == 14
    for f in BUILTIN.values():
        assert spark.range(1).selectExpr("'x' rlike '" + to_java(f.regex).text.replace("\\", "\\\\").replace("'", "\\'") + "' AS m").first()["m"] is False
