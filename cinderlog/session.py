"""Investigations on the driver: a cache of parsed files, and sessions with history, undo, notes and reports."""

from __future__ import annotations

import json
import os
from collections import OrderedDict
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from cinderlog.operators import aggregates, follow, hierarchy, sampling, search
from cinderlog.operators.predicates import Filters
from cinderlog.plans.sqlviews import SqlViews
from cinderlog.sources.formats import formats_for
from cinderlog.sources.text import expand, read_logs, stamp

MOST_SETS = 10


class FileCache:
    """Parsed file sets kept by paths, times of change and format; the oldest goes when there are more than MOST_SETS."""

    def __init__(self) -> None:
        self.kept: OrderedDict[tuple, DataFrame] = OrderedDict()

    def entries(self, spark: SparkSession, paths: Sequence[str], force: str | None = None, custom_regex: str | None = None) -> DataFrame:
        files = expand(paths)
        stamps = tuple(stamp(spark, f) for f in files)
        formats = formats_for(files[0]) if files and not (force or custom_regex) else None
        key = (stamps, force, custom_regex, formats.path and os.path.getmtime(formats.path) if formats else None)
        if key not in self.kept:
            self.kept[key] = read_logs(spark, files, force, custom_regex, formats=formats).persist(StorageLevel.MEMORY_AND_DISK)
            while len(self.kept) > MOST_SETS:
                self.kept.popitem(last=False)[1].unpersist()
        return self.kept[key]

    def clear(self) -> None:
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()


class Investigator:
    """Operators over one set of files."""

    def __init__(self, spark: SparkSession, paths: Sequence[str], cache: FileCache | None = None, **read: Any) -> None:
        self.spark, self.files = spark, expand(paths)
        self.entries = (cache or FileCache()).entries(spark, paths, **read)
        self._sql: SqlViews | None = None

    def search(self, limit: int | None = None, offset: int = 0, tail: int | None = None, **filters: Any) -> DataFrame:
        return search.search(self.entries, Filters(**filters), limit, offset, tail)

    def count(self, **filters: Any) -> int:
        return search.count(self.entries, Filters(**filters))

    def ids(self) -> DataFrame:
        return aggregates.extract_ids(self.entries)

    def metadata(self) -> DataFrame:
        return aggregates.file_metadata(self.entries)

    def patterns(self, least: int = 2) -> DataFrame:
        return aggregates.repeated_errors(self.entries, least)

    def follow(self, **ids: str) -> DataFrame:
        return follow.follow(self.entries, **ids)

    def context(self, file: str, line: int, before: int = 10, after: int = 10) -> DataFrame:
        return search.context(self.entries, file, line, before, after)

    def hierarchy(self, identifier: str, **options: Any) -> DataFrame:
        return hierarchy.nodes(self.entries, identifier, **options)

    def sample(self, strategy: str = "representative", size: int = 100, **filters: Any) -> DataFrame:
        return sampling.sample(self.entries.where(Filters(**filters).column()), strategy, size)

    def sql(self, query: str) -> DataFrame:
        if self._sql is None:
            self._sql = SqlViews(self.spark).load(self.entries)
        return self._sql.query(query)

    def quick_summary(self) -> DataFrame:
        """Metadata of the first file only."""
        return aggregates.file_metadata(self.entries.where(self.entries["file"] == self.files[0]))


@dataclass
class Session:
    """Steps of an investigation; undone steps can be redone until a new one is taken."""

    name: str
    files: list[str] = field(default_factory=list)
    steps: list[dict[str, Any]] = field(default_factory=list)
    undone: list[dict[str, Any]] = field(default_factory=list)
    conclusion: str | None = None

    def add(self, kind: str, now: datetime | None = None, **details: Any) -> dict[str, Any]:
        step = {"kind": kind, "at": (now or datetime.now(UTC)).isoformat(), **details}
        self.steps.append(step)
        self.undone.clear()
        return step

    def note(self, text: str) -> None:
        self.add("note", text=text)

    def conclude(self, text: str) -> None:
        self.conclusion = text
        self.add("conclusion", text=text)

    def undo(self) -> bool:
        if self.steps:
            self.undone.append(self.steps.pop())
        return bool(self.undone)

    def redo(self) -> bool:
        if not self.undone:
            return False
        self.steps.append(self.undone.pop())
        return True

    def save(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(self.__dict__, ensure_ascii=False, indent=1), encoding="utf-8")

    @classmethod
    def load(cls, path: str) -> Session:
        return cls(**json.loads(Path(path).read_text(encoding="utf-8")))

    def report(self, kind: str = "markdown") -> str:
        if kind == "json":
            return json.dumps(self.__dict__, ensure_ascii=False)
        head, bullet = ("# ", "- ") if kind == "markdown" else ("", "* ")
        lines = [f"{head}{self.name}", "", *[f"{bullet}{f}" for f in self.files], ""]
        for s in self.steps:
            rest = ", ".join(f"{k}={v}" for k, v in s.items() if k not in ("kind", "at"))
            lines.append(f"{bullet}{s['at']} {s['kind']}: {rest}")
        return "\n".join(lines + ([f"\n{head}Conclusion\n{self.conclusion}"] if self.conclusion else []))
