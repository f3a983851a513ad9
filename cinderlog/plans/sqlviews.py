"""User SQL over entries: the views ``logs`` and ``metrics``, a few words of another dialect, and nothing else readable."""

from __future__ import annotations

import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.operators.metrics import extract

LOG_COLUMNS = ("file", "line_number", "timestamp", "level", "message", "thread_id", "correlation_id", "trace_id", "span_id", "raw")
VIEWS = ("logs", "metrics")


class RefusedSql(ValueError):
    """Not one SELECT over the views."""


def _outside_quotes(sql: str, change) -> str:
    parts = re.split(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/)", sql, flags=re.S)
    return "".join(p if i % 2 else change(p) for i, p in enumerate(parts))


def _qualify(sql: str) -> str:
    """SELECT ... QUALIFY c (at the end, of the outer query) as a selection from the query with c as a column."""
    m = re.search(r"\bQUALIFY\b", sql, re.I)
    if not m:
        return sql
    head, rest = sql[: m.start()], sql[m.end() :]
    tail = re.search(r"\b(ORDER\s+BY(?![^()]*\))|LIMIT)\b(?![^()]*\))", rest, re.I)
    condition, tail_sql = (rest[: tail.start()], rest[tail.start() :]) if tail else (rest, "")
    body = re.match(r"(?is)(.*?\bSELECT\b)(.*?)(\bFROM\b.*)", head)
    if not body:
        return sql
    return f"SELECT * EXCEPT (_qualified) FROM ({body[1]}{body[2]}, ({condition}) AS _qualified {body[3]}) WHERE _qualified {tail_sql}"


def translated(sql: str) -> str:
    """Names of another dialect's functions as Spark's."""

    def names(part: str) -> str:
        part = re.sub(r"\bquantile_cont\s*\(", "percentile(", part, flags=re.I)
        part = re.sub(r"\barg_max\s*\(", "max_by(", part, flags=re.I)
        part = re.sub(r"\barg_min\s*\(", "min_by(", part, flags=re.I)
        return re.sub(r"\blist\s*\(", "collect_list(", part, flags=re.I)

    sql = re.sub(r"(?i)\bdate_diff\s*\(\s*'(\w+)'\s*,", lambda m: f"timestampdiff({m[1].upper()},", sql)
    sql = re.sub(r"(?i)\bstrftime\s*\(([^,()]+),\s*'([^']*)'\s*\)", lambda m: f"date_format({m[1]}, '{_java_time(m[2])}')", sql)
    sql = re.sub(r'"([A-Za-z_]\w*)"', r"`\1`", sql)
    return _qualify(_outside_quotes(sql, names))


def _java_time(fmt: str) -> str:
    words = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD"}
    out = re.sub(r"[A-Za-z]+(?![^%]*%)", lambda m: m[0], fmt)
    return re.sub(r"%[A-Za-z]", lambda m: words.get(m[0], m[0]), out)


class SqlViews:
    """Loaded entries as views of one query at a time; names are private to the object."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tag = spark, uuid.uuid4().hex[:8]

    def load(self, entries: DataFrame) -> SqlViews:
        """Empty texts are null here, as in a bulk load from text."""
        text = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c) if c not in ("line_number", "timestamp") else F.col(c)
        entries.select(*[text(c) for c in LOG_COLUMNS]).createOrReplaceTempView(f"logs_{self.tag}")
        extract(entries).createOrReplaceTempView(f"metrics_{self.tag}")
        return self

    def checked(self, sql: str) -> str:
        bare = re.sub(r"('(?:[^']|'')*'|--[^\n]*|/\*.*?\*/)", " ", sql, flags=re.S).strip().rstrip(";").strip()
        if ";" in bare:
            raise RefusedSql("one statement at a time")
        if not re.match(r"(?i)(SELECT|WITH|FROM|VALUES)\b", bare):
            raise RefusedSql("only a SELECT is read")
        if re.search(r"(?i)\b(csv|json|parquet|orc|text|binaryfile|avro|delta|jdbc)\s*\.\s*`|\bread_files\s*\(|\b(java_method|reflect|try_reflect)\s*\(", bare):
            raise RefusedSql("files and foreign code are not read")
        return sql.strip().rstrip(";")

    def query(self, sql: str) -> DataFrame:
        """Run one SELECT; its views are bound for this call only, so ``logs`` elsewhere in the session stays what it was."""
        own = self.spark.newSession()
        for name in VIEWS:
            self.spark.table(f"{name}_{self.tag}").createOrReplaceGlobalTempView(f"{name}_{self.tag}")
            own.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT * FROM global_temp.{name}_{self.tag}")
        for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
            own.conf.set(key, self.spark.conf.get(key))
        return own.sql(translated(self.checked(sql)))

    def tables(self) -> list[str]:
        return list(VIEWS)

    def describe(self, name: str) -> list[dict[str, Any]]:
        if name not in VIEWS:
            raise RefusedSql(f"no table {name!r}")
        return [{"column": f.name, "type": f.dataType.simpleString()} for f in self.spark.table(f"{name}_{self.tag}").schema]

