"""SQLite tables, growing files and user formats."""

from __future__ import annotations

import json
import sqlite3
from datetime import datetime

import pytest

NOW = datetime(2024, 5, 1)


def test_sqlite_rows_become_entries(spark, tmp_path):
    from cinderlog.sources.sqlite import read_database

    path = str(tmp_path / "q.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE qler_jobs(_id INTEGER PRIMARY KEY, data TEXT, ulid TEXT, status TEXT, queue_name TEXT)")
        db.execute("CREATE TABLE plain(_id INTEGER PRIMARY KEY, created_at TEXT, status TEXT)")
        db.execute("CREATE TABLE skipped(x TEXT)")
        for i in range(7):
            db.execute("INSERT INTO qler_jobs VALUES (?, ?, ?, ?, ?)", (i, json.dumps({"task": "t", "correlation_id": f"c{i}", "status": "old", "created_at": 1700000000 + i}), f"u{i}", "failed" if i % 2 else "completed", "default"))
        db.execute("INSERT INTO plain VALUES (1, '2023-11-14T22:13:20.5Z', 'warning')")
        db.execute("INSERT INTO plain VALUES (2, NULL, 'odd')")
    got = {(r["thread_id"], r["line_number"]): r for r in read_database(spark, path, NOW).collect()}
    assert len(got) == 9
    one = got["qler_jobs", 3]
    assert (one["level"], one["message"], one["correlation_id"], one["timestamp"]) == ("ERROR", "[job] t (u3) status=failed", "c3", datetime(2023, 11, 14, 22, 13, 23))
    assert (got["plain", 1]["timestamp"], got["plain", 1]["message"]) == (datetime(2023, 11, 14, 22, 13, 20, 500000), "{plain} row 1")
    assert (got["plain", 2]["timestamp"], got["plain", 2]["level"], got["plain", 1]["level"]) == (NOW, "UNKNOWN", "WARN") and one["service_name"] == "qler"


def test_complete_lines_and_rotation(tmp_path):
    from cinderlog.streaming.tail import complete_lines

    path = tmp_path / "a.log"
    path.write_bytes(b"one\ntwo\r\nthr")
    rows, at, line = complete_lines(str(path), 0, 0)
    assert [r[1:] for r in rows] == [(1, "one"), (2, "two")] and (at, line) == (9, 2)
    path.write_bytes(b"one\ntwo\r\nthree\n")
    rows, at, line = complete_lines(str(path), at, line)
    assert [r[1:] for r in rows] == [(3, "three")]
    path.write_bytes(b"new\n")
    assert [r[1:] for r in complete_lines(str(path), at, line)[0]] == [(1, "new")]


def test_tail_stream(spark, tmp_path):
    from cinderlog.streaming.tail import follow_files

    path = tmp_path / "s.log"
    path.write_text("2024-01-15 10:00:00 ERROR one\n2024-01-15 10:00:01 INFO two\nhalf")
    query = follow_files(spark, [str(path)]).where("level = 'ERROR'").select("line_number", "message").writeStream.format("memory").queryName("tailed").start()
    try:
        query.processAllAvailable()
        with path.open("a") as f:
            f.write(" line\n2024-01-15 10:00:02 ERROR three\n")
        query.processAllAvailable()
        assert sorted(r["line_number"] for r in spark.table("tailed").collect()) == [1, 4]
    finally:
        query.stop()


def test_nearest_format_file_names_formats(tmp_path):
    from cinderlog.sources.formats import BadFormats, formats_for, load_formats

    folder = tmp_path / ".cinderlog"
    folder.mkdir()
    (folder / "formats.yaml").write_text("formats:\n  own:\n    regex: '^(?P<level>\\w+)/(?P<message>.*)'\n    file_patterns: ['*.own']\n")
    (tmp_path / "deep").mkdir()
    found = formats_for(str(tmp_path / "deep" / "x.own"))
    assert found.name_for("/a/x.own") == "own" and found.name_for("/a/x.log") is None
    (folder / "formats.yaml").write_text("formats:\n  own:\n    regex: '('\n")
    with pytest.raises(BadFormats, match="formats.yaml"):
        load_formats(str(folder / "formats.yaml"))
