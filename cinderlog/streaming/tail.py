"""Growing files as a stream of entries, folders as a stream of new files."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from cinderlog.sources.parse import parse
from cinderlog.sources.text import expand

LINES = "file string, line_number long, raw string"


def complete_lines(path: str, at: int, line: int) -> tuple[list[tuple[str, int, str]], int, int]:
    """Lines that end in a newline from byte ``at`` on, and where the next begins. A file shorter than that was replaced: it is read from its start."""
    if not os.path.exists(path):
        return [], at, line
    if os.path.getsize(path) < at:
        at, line = 0, 0
    with open(path, "rb") as f:
        f.seek(at)
        data = f.read()
    end = data.rfind(b"\n") + 1
    if not end:
        return [], at, line
    if at == 0 and data.startswith(b"\xef\xbb\xbf"):
        text = data[3:end]
    else:
        text = data[:end]
    rows = [(path, line + i + 1, x.removesuffix(b"\r").decode("utf-8", "replace")) for i, x in enumerate(text[:-1].split(b"\n"))]
    return rows, at + end, line + len(rows)


class _Tail(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.paths = expand(options["path"].split(","))
        self.from_end = options.get("from", "start") == "end"

    def initialOffset(self) -> dict:
        out = {}
        for p in self.paths:
            at = line = 0
            if self.from_end:
                _, at, line = complete_lines(p, 0, 0)
            out[p] = f"{at}:{line}"
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], {}
        for p in self.paths:
            at, line = map(int, start.get(p, "0:0").split(":"))
            found, at, line = complete_lines(p, at, line)
            rows += found
            end[p] = f"{at}:{line}"
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for p in self.paths:
            at, line = map(int, start.get(p, "0:0").split(":"))
            _, last = map(int, end.get(p, "0:0").split(":"))
            rows, _, _ = complete_lines(p, at, line)
            yield from (r for r in rows if r[1] <= last)


class TailSource(DataSource):
    """``readStream.format("tail_lines")``: options ``path`` (comma list of globs) and ``from`` (start or end)."""

    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def schema(self) -> str:
        return LINES

    def simpleStreamReader(self, schema: StructType) -> _Tail:
        return _Tail(self.options)


def follow_files(spark: SparkSession, paths: list[str], from_end: bool = False) -> DataFrame:
    """Entries of growing files: whole lines only, a replaced file is read anew."""
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("tail_lines").option("path", ",".join(paths)).option("from", "end" if from_end else "start").load()
    return parse(lines)


def tail_then_follow(spark: SparkSession, path: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The last n whole lines, and the stream of what comes after them."""
    rows, _, _ = complete_lines(path, 0, 0)
    return parse(spark.createDataFrame(rows[-n:] if n else [], LINES)), follow_files(spark, [path], from_end=True)


def watch_folder(spark: SparkSession, folder: str, glob: str = "*.log", recursive: bool = True) -> DataFrame:
    """Lines of files as they appear in a folder (numbered within each file's part of a batch by place)."""
    read = spark.readStream.option("lineSep", "\n").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).text(folder)
    lines = read.select(F.regexp_replace("_metadata.file_path", r"\Afile:/*", "/").alias("file"), F.lit(None).cast("long").alias("line_number"), F.regexp_replace("value", r"\r\z", "").alias("raw"))
    return parse(lines)


def level_windows(entries: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of levels in event-time windows; entries later than ``late`` are dropped by the watermark."""
    timed = entries.where("timestamp IS NOT NULL").withColumn("_t", F.col("timestamp").cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width).alias("w"), F.coalesce("level", F.lit("UNKNOWN")).alias("level")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "level", "n")
