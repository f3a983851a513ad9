"""Which format a file is written in, from its first lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.functions.patterns import to_java
from cinderlog.sources.formats import Format
from cinderlog.sources.parse import BLANK, json_object

SAMPLE = 50
# The formats' patterns, and how much a match counts.
SYSLOG = r"\A(?:[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+\S+|<\d{1,3}>\d?\s*\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})"
COMMON = r'\A\S+\s+\S+\s+\S+\s+\[\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4}\]\s+"[A-Z]+\s+'
PAIR = r"[a-zA-Z_]\w*=\S+"
WEIGHTS = {"json": 0.98, "syslog": 0.90, "common_log": 0.95, "logfmt": 0.80}
CUSTOM_WEIGHT, FEW_JSON_WEIGHT, FEW_JSON = 0.92, 0.5, 0.5


def sample_lines(lines: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The first lines of each file that are neither blank nor comments."""
    kept = lines.where(~F.col("raw").rlike(BLANK) & ~F.ltrim("raw").startswith("#"))
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy("line_number"))).where(F.col("_r") <= size).drop("_r")


def scores(lines: DataFrame, custom: dict[str, Format] | None = None, size: int = SAMPLE) -> DataFrame:
    """(file, format, match_rate, confidence, nth) of every format."""
    raw = F.col("raw")
    tests: dict[str, Column] = {"json": json_object(raw).isNotNull(), "syslog": raw.rlike(SYSLOG), "common_log": raw.rlike(COMMON), "logfmt": F.regexp_count(raw, F.lit(PAIR)) >= 3}
    tests |= {f"custom:{n}": raw.rlike(to_java(f.regex).text) for n, f in (custom or {}).items()}
    rates = sample_lines(lines, size).groupBy("file").agg(F.count("*").alias("sample_size"), *[F.avg(t.cast("double")).alias(n) for n, t in tests.items()])
    each = [F.struct(F.lit(n).alias("format"), F.col(f"`{n}`").alias("match_rate"), (F.col(f"`{n}`") * (F.when(F.col("json") > FEW_JSON, WEIGHTS["json"]).otherwise(FEW_JSON_WEIGHT) if n == "json" else F.lit(WEIGHTS.get(n, CUSTOM_WEIGHT)))).alias("confidence"), F.lit(i).alias("nth")) for i, n in enumerate(tests)]
    return rates.select("file", "sample_size", F.explode(F.array(*each)).alias("x")).select("file", "sample_size", "x.*")


def detect(lines: DataFrame, custom: dict[str, Format] | None = None, size: int = SAMPLE) -> DataFrame:
    """Per file: the best format, confidence and match rate (4 digits), alternatives, and whether formats are mixed."""
    order = Window.partitionBy("file").orderBy(F.desc("confidence"), "nth")
    ranked = scores(lines, custom, size).withColumn("r", F.row_number().over(order))
    pick = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    other = F.when((F.col("r") > 1) & (F.col("confidence") > 0.01), F.struct("r", "format", F.round("confidence", 4).alias("confidence"), F.round("match_rate", 4).alias("match_rate")))
    return ranked.groupBy("file").agg(
        pick("format", 1).alias("format"), F.round(pick("confidence", 1), 4).alias("confidence"), F.round(pick("match_rate", 1), 4).alias("match_rate"), F.max("sample_size").alias("sample_size"),
        ((pick("match_rate", 1) < 0.8) & (pick("match_rate", 2) > 0.3)).alias("mixed"), F.array_sort(F.collect_list(other)).alias("alternatives"),
    )
