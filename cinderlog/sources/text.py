"""Text files as numbered lines, read in parallel splits.

Spark reads a file in blocks and says where each begins, so a line's number is its place in its block
plus the lines of the blocks before it. Only one count per (file, block) crosses the network.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlog.sources.formats import UserFormats
from cinderlog.sources.parse import parse

#: Offsets of blocks are broadcast up to so many blocks, some 20 MB; beyond, lines and offsets are joined by shuffles.
MOST_BLOCKS, LEAST_BLOCK = 200_000, 4 << 20


def _system(spark: SparkSession, path: str):
    """The Hadoop path and the file system that it is in: local, of the cluster or of an object store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _plain(path: str) -> str:
    return re.sub(r"\Afile:/*", "/", path)


def _deep(pattern: str) -> re.Pattern[str]:
    """A pattern with ``**`` (any folders) over a path without its scheme."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out = "".join(parts.get(x) or (("[" + ("^" + x[2:] if x[1] == "!" else x[1:])) if len(x) > 2 and x[0] == "[" else re.escape(x)) for x in re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]+\]|.", pattern, re.S))
    return re.compile(out, re.S)


def _found(spark: SparkSession, pattern: str) -> list[str]:
    if "**" not in pattern:
        where, system = _system(spark, pattern)
        return [_plain(x.getPath().toString()) for x in system.globStatus(where) or [] if x.isFile()]
    base = pattern[: re.search(r"[*?\[]", pattern).start()].rpartition("/")[0] or ("/" if pattern.startswith("/") else ".")
    where, system = _system(spark, base)
    if not system.exists(where):
        return []
    bare = lambda x: x.toUri().getPath()
    root, fits = bare(system.makeQualified(where)).rstrip("/"), _deep(pattern[len(base) :].lstrip("/") if base != "." else pattern)
    files, out = system.listFiles(where, True), []
    while files.hasNext():
        at = files.next().getPath()
        if fits.fullmatch(bare(at)[len(root) :].lstrip("/")):
            out.append(_plain(at.toString()))
    return out


def expand(patterns: Sequence[str]) -> list[str]:
    """Patterns as a sorted list of files, each once; a plain path stays. In a session, paths are those of Spark's file systems (``hdfs://``, ``s3a://`` ...)."""
    spark, found = SparkSession.getActiveSession(), set()
    for p in patterns:
        if not glob.has_magic(p):
            found.add(p)
        elif spark is None:
            found.update(x for x in glob.glob(p, recursive=True) if os.path.isfile(x))
        else:
            found.update(x for x in _found(spark, p) if not x.rpartition("/")[2].startswith(".") or p.rpartition("/")[2].startswith("."))
    return sorted(found)


def stamp(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """A path with its time of change and length."""
    where, system = _system(spark, path)
    status = system.getFileStatus(where)
    return path, status.getModificationTime(), status.getLen()


def _few_blocks(spark: SparkSession, paths: Sequence[str]) -> bool:
    blocks = len(paths)
    for p in paths:
        if blocks > MOST_BLOCKS or glob.has_magic(p):
            return False
        where, system = _system(spark, p)
        held = system.getContentSummary(where)
        blocks += held.getLength() // LEAST_BLOCK + held.getFileCount()
    return blocks <= MOST_BLOCKS


def numbered_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, line_number, raw): lines end at a newline only, one carriage return before it is dropped, blank lines count."""
    read = spark.read.option("lineSep", "\n").text(list(paths))
    lines = read.select(
        F.regexp_replace("_metadata.file_path", r"\Afile:/*", "/").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.regexp_replace("value", r"\r\z", "").alias("raw"),
        F.monotonically_increasing_id().alias("_place"),
    )
    blocks = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(F.col("file").alias("_file"), F.col("_block").alias("_at"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # lines then stay where they are read
    offsets = F.broadcast(offsets) if _few_blocks(spark, paths) else offsets
    joined = lines.join(offsets, (F.col("file") == F.col("_file")) & (F.col("_block") == F.col("_at")))
    return joined.select("file", (F.col("_place") - F.col("_first") + F.col("_before") + 1).alias("line_number"), "raw")


def read_logs(spark: SparkSession, paths: Sequence[str], force: str | None = None, custom_regex: str | None = None, timestamp_format: str | None = None, formats: UserFormats | None = None) -> DataFrame:
    """Entries of files. Files that a user format names are read by it, the others by detection; one scan per format."""
    files = expand(paths)
    if force or custom_regex or formats is None:
        return parse(numbered_lines(spark, files), force, custom_regex, timestamp_format)
    groups: dict[str | None, list[str]] = {}
    for f in files:
        groups.setdefault(formats.name_for(f), []).append(f)
    out = None
    for name, members in sorted(groups.items(), key=lambda g: g[0] or ""):
        fmt = formats.formats[name] if name else None
        part = parse(numbered_lines(spark, members), None, fmt.regex if fmt else None, fmt.timestamp_format if fmt else None)
        out = part if out is None else out.unionByName(part)
    return out


def tail(lines: DataFrame, n: int) -> DataFrame:
    """The last n lines of each file."""
    last = Window.partitionBy("file").orderBy(F.desc("line_number"))
    return lines.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= n).drop("_r")


def grep(lines: DataFrame, text: str, regex: bool = False, ignore_case: bool = False) -> DataFrame:
    """Lines with a substring, or that match a pattern."""
    from cinderlog.functions.patterns import matches

    if regex:
        return lines.where(matches(text, F.col("raw"), ignore_case=ignore_case))
    return lines.where(F.lower("raw").contains(text.lower()) if ignore_case else F.col("raw").contains(text))
