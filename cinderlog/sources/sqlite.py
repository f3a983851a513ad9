"""SQLite tables as entries: a Python data source that reads ranges of row ids in parallel."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from cinderlog.functions.levels import word_level
from cinderlog.functions.patterns import template
from cinderlog.functions.times import read_timestamp
from cinderlog.schema import as_entries
from cinderlog.sources.parse import json_text

ROWS = 50_000


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(path: str) -> dict[str, list[str]]:
    """Tables of a database and their columns."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        return {n: [c[1] for c in db.execute(f"PRAGMA table_info({_quoted(n)})")] for n in names}


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.table, self.rows = options["path"], options["table"], int(options.get("rows", ROWS))
        self.names = schema.fieldNames()

    def partitions(self) -> list[_Range]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        return [] if low is None else [_Range(a, min(a + self.rows, high + 1)) for a in range(low, high + 1, self.rows)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        cols = ", ".join(_quoted(n) for n in self.names)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f"SELECT {cols} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high)):
                yield tuple(None if v is None else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v) for v in row)


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_rows").option("path", ...).option("table", ...)``: all columns as text."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in tables(self.options["path"])[self.options["table"]])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options, schema)


@dataclass(frozen=True)
class Mapping:
    """How a table's rows become entries: names of columns or of keys of its JSON column, and a message template (``{table_name}`` is the table)."""

    table: str
    timestamp: str = "created_at"
    iso: bool = False
    level: str | None = "status"
    levels: dict[str, str] = field(default_factory=dict)
    message: str = "{table_name} row {_id}"
    correlation: str | None = "correlation_id"
    service: str | None = None


# How two known tables of a job queue are read.
KNOWN = {
    "qler_jobs": Mapping("qler_jobs", levels={"pending": "INFO", "running": "INFO", "completed": "INFO", "failed": "ERROR", "cancelled": "WARN"}, message="[job] {task} ({ulid}) status={status}", service="qler"),
    "qler_job_attempts": Mapping("qler_job_attempts", "started_at", levels={"running": "INFO", "completed": "INFO", "failed": "ERROR", "lease_expired": "WARN"}, message="[attempt] job={job_ulid} attempt={attempt_number} status={status}", correlation=None, service="qler"),
}


def generic(table: str, columns: list[str]) -> Mapping:
    """Of a table that is not known. The message names a placeholder that no row fills, so it stays as written."""
    stamp = "timestamp" if "created_at" not in columns and "timestamp" in columns else "created_at"
    return Mapping(table, stamp, True, "status" if "status" in columns else None, {}, "{" + table + "} row {_id}", "correlation_id" if "correlation_id" in columns else None, table)


def auto_mappings(path: str) -> list[Mapping]:
    """Known tables by their mapping, others with an ``_id`` by a plain one; tables without are left out."""
    return [KNOWN.get(t) or generic(t, cols) for t, cols in tables(path).items() if t in KNOWN or "_id" in cols]


def epoch(text: Column) -> Column:
    """A number above 1e12 counts milliseconds, else seconds."""
    n = text.try_cast("double")
    us = F.round(F.when(n > 1e12, n * 1e3).otherwise(n * 1e6)).cast("long")
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def read_table(spark: SparkSession, path: str, mapping: Mapping, now: datetime) -> DataFrame:
    """A table's rows as entries: keys of the JSON column ``data`` with the other columns over them (those win)."""
    spark.dataSource.register(SqliteSource)
    rows = spark.read.format("sqlite_rows").option("path", path).option("table", mapping.table).load()
    promoted = [c for c in rows.columns if c != "data"]
    blob = F.coalesce(F.from_json("data", "map<string,string>"), F.create_map().cast("map<string,string>")) if "data" in rows.columns else F.create_map().cast("map<string,string>")
    own = F.map_filter(F.create_map(*[x for c in promoted for x in (F.lit(c), F.col(f"`{c}`"))]), lambda _, v: v.isNotNull()) if promoted else F.create_map().cast("map<string,string>")
    merged = rows.select(F.map_concat(F.map_filter(blob, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own).alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k)) if k else F.lit(None).cast("string")
    names = {n: at(n) for n in set(re.findall(r"\{(\w+)\}", mapping.message))} | {"table_name": F.lit(mapping.table)}
    # a placeholder without a value stays as written
    names = {n: F.coalesce(c, F.lit("{" + n + "}")) for n, c in names.items()}
    stamp = at(mapping.timestamp)
    read = read_timestamp(stamp) if mapping.iso else F.coalesce(epoch(stamp), read_timestamp(stamp))
    status = at(mapping.level)
    if mapping.levels:
        level = F.lit("INFO")
        for word, name in mapping.levels.items():
            level = F.when(status == word, name).otherwise(level)
    else:
        level = F.when(F.coalesce(status, F.lit("")) == "", "INFO").otherwise(F.coalesce(word_level(status), F.lit("UNKNOWN")))
    number = r"\A-?\d+(?:\.\d+)?\z"
    out = merged.select(
        F.lit(f"{path}:{mapping.table}").alias("file"), F.coalesce(at("_id").try_cast("long"), F.lit(0)).alias("line_number"), F.when(stamp.isNull(), F.lit(now.isoformat(" ")).cast("timestamp_ntz")).otherwise(read).alias("timestamp"),
        level.alias("level"), F.lit("Json").alias("format"), template(mapping.message, names).alias("message"), at(mapping.correlation).alias("correlation_id"), F.lit(mapping.table).alias("thread_id"), F.lit(mapping.service).alias("service_name"),
        F.transform_values("m", lambda _, v: F.when(v.rlike(number), v).otherwise(json_text(v))).alias("fields"),
    )
    return as_entries(out)


def read_database(spark: SparkSession, path: str, now: datetime, mappings: list[Mapping] | None = None) -> DataFrame:
    found = [read_table(spark, path, m, now) for m in (mappings if mappings is not None else auto_mappings(path))]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
