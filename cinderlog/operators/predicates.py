"""Filters over entries, as column predicates that Catalyst can push down."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.levels import parse_levels
from cinderlog.functions.patterns import base_name, glob_pattern, matches, name_matches
from cinderlog.schema import COLUMNS


@dataclass(frozen=True)
class Filters:
    """What a search keeps. An empty list filters nothing; lists win over their single forms."""

    level: str | list[str] | None = None
    exclude_level: str | list[str] | None = None
    time_start: datetime | None = None
    time_end: datetime | None = None
    query: str | None = None
    exclude_query: str | None = None
    thread_id: str | Sequence[str] | None = None
    correlation_id: str | Sequence[str] | None = None
    trace_id: str | Sequence[str] | None = None
    service_name: str | Sequence[str] | None = None
    has_correlation_id: bool | None = None
    files: Sequence[str] | None = None

    def column(self) -> Column:
        keep = F.lit(True)
        if levels := parse_levels(self.level):
            keep = keep & level_in(levels)
        if levels := parse_levels(self.exclude_level):
            keep = keep & level_not_in(levels)
        keep = keep & in_time(self.time_start, self.time_end)
        if self.query:
            keep = keep & line_matches(self.query)
        if self.exclude_query:
            keep = keep & ~line_matches(self.exclude_query)
        for name in ("thread_id", "correlation_id", "trace_id", "service_name"):
            wanted = getattr(self, name)
            wanted = [wanted] if isinstance(wanted, str) else list(wanted or [])
            if wanted:
                keep = keep & F.col(name).isin(wanted)
        if self.has_correlation_id is not None:
            keep = keep & (F.col("correlation_id").isNotNull() if self.has_correlation_id else F.col("correlation_id").isNull())
        if self.files:
            keep = keep & F.col("file").isin(list(self.files))
        return keep


def level_in(levels: list[str]) -> Column:
    """A null level is in no list."""
    return F.col("level").isin(levels)


def level_not_in(levels: list[str]) -> Column:
    """A null level is excluded by no list."""
    return F.col("level").isNull() | ~F.col("level").isin(levels)


def in_time(start: datetime | None, end: datetime | None) -> Column:
    """Both ends count; entries without a time pass."""
    ts, keep = F.col("timestamp"), F.lit(True)
    if start is not None:
        keep = keep & (ts.isNull() | (ts >= F.lit(start.isoformat(" ")).cast("timestamp_ntz")))
    if end is not None:
        keep = keep & (ts.isNull() | (ts <= F.lit(end.isoformat(" ")).cast("timestamp_ntz")))
    return keep


def line_matches(pattern: str) -> Column:
    """One pattern without regard to case over the whole line or the message."""
    return matches(pattern, F.col("raw"), F.col("message"))


def contains(text: str, ignore_case: bool = True) -> Column:
    return F.lower("raw").contains(text.lower()) if ignore_case else F.col("raw").contains(text)


def viewed(level: str | None = None, text: str | None = None, thread: str | None = None) -> Column:
    """A viewer's filters: level, a part of the message in any case, thread."""
    keep = F.lit(True)
    if level:
        keep = keep & F.col("level").isin(parse_levels(level))
    if text:
        keep = keep & F.lower("message").contains(text.lower())
    return keep & (F.col("thread_id") == thread) if thread else keep


def field(name: str) -> Column:
    """An entry's own column, even where null, else the value of that key in fields as text without quotes."""
    if name in COLUMNS and name != "fields":
        return F.col(name)
    value = F.try_element_at(F.col("fields"), F.lit(name))
    return F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).when(value != "null", value)


_CONDITION = re.compile(r"^\s*(<=?|>=?|==|!=)\s*(-?\d+(?:\.\d+)?)\s*$")


def condition(value: Column, text: str) -> Column:
    """``< 5``, ``>= 1.5``, ``!= 0`` ...: false for what is no number, or if the text is no condition."""
    m = _CONDITION.match(text)
    if not m:
        return F.lit(False)
    number, limit = value.cast("string").try_cast("double"), float(m[2])
    op = {"<": number < limit, ">": number > limit, "<=": number <= limit, ">=": number >= limit, "==": number == limit, "!=": number != limit}[m[1]]
    return F.coalesce(op, F.lit(False))


@dataclass(frozen=True)
class EventCondition:
    """All that is given must hold: a glob on the file's name, a level, a case-sensitive pattern, a field's condition."""

    file_pattern: str | None = None
    level: str | None = None
    pattern: str | None = None
    field: str | None = None
    condition: str | None = None

    def column(self) -> Column:
        keep = name_matches(F.col("file"), self.file_pattern)
        if self.level is not None:
            keep = keep & (F.coalesce(F.upper("level"), F.lit("")) == self.level.upper())
        if self.pattern is not None:
            text = F.when(F.col("message") != "", F.col("message")).otherwise(F.coalesce("raw", F.lit("")))
            keep = keep & matches(self.pattern, text, ignore_case=False)
        if self.field is not None and self.condition is not None:
            keep = keep & condition(field(self.field), self.condition)
        return keep

    def given(self) -> bool:
        return any(x is not None for x in (self.file_pattern, self.level, self.pattern, self.field))


class NoTrigger(ValueError):
    pass


def triggers(entries: DataFrame, what: EventCondition) -> DataFrame:
    """Entries that meet a trigger, which must name something."""
    if not what.given():
        raise NoTrigger("a trigger needs a level, a pattern, a file pattern or a field")
    return entries.where(what.column())


def in_files(globs: Sequence[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | base_name(F.col("file")).rlike(glob_pattern(g))
    return out
