"""Numbers in logs: extraction, series statistics, anomalies and time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.functions.times import bucket_micros
from cinderlog.schema import micros

# Units, and names that hold no measure.
UNITS = r"ms|s|us|ns|MB|GB|KB|kPa|°[CF]|%|rpm|Hz"
NO_MEASURE = ("port", "pid", "uid", "euid", "gid")
# A name starts where a word does, after the word's digits, or right where the last match ended (\G).
NAMED = rf"(?U)(?:\G|(?<!\w))[^\Wa-zA-Z_]*([a-zA-Z_]\w*)\s*[=:]\s*(-?\d+(?:\.\d+)?)\s*({UNITS})?"
DURATION = r"(?U)(?:took|elapsed|duration|latency|time|response_time)\s*(?:[:=]\s*)?(\d+(?:\.\d+)?)\s*(ms|s|us|ns)"
POINT = "struct<field_name:string,value:double,unit:string,source:int,nth:int>"


def _point(name: Column, value: Column, unit: Column, source: int, nth: Column) -> Column:
    return F.struct(name.alias("field_name"), value.try_cast("double").alias("value"), F.nullif(unit, F.lit("")).alias("unit"), F.lit(source).alias("source"), nth.cast("int").alias("nth")).cast(POINT)


def extract(entries: DataFrame) -> DataFrame:
    """file, line_number, timestamp, field_name, value, unit: numbers of ``fields``, then ``name=number`` in the message (the first of a name), else a phrase such as ``took 45ms``."""
    own = F.map_entries(F.map_filter("fields", lambda _, v: v.rlike(r"\A-?\d")))
    own = F.transform(own, lambda x, i: _point(x["key"], x["value"], F.lit(""), 0, i))
    part = lambda i: F.regexp_extract_all("message", F.lit(NAMED), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("n"), part(2).alias("v"), part(3).alias("u"))
    phrase = F.regexp_extract("message", DURATION, 1)
    took = F.when((phrase != "") & ~F.exists("_first", lambda p: p["field_name"] == "duration"), F.array(_point(F.lit("duration"), phrase, F.regexp_extract("message", DURATION, 2), 2, F.lit(0)))).otherwise(F.array().cast(f"array<{POINT}>"))
    raw_named = F.filter(F.transform(zipped, lambda x, i: _point(x["n"], x["v"], x["u"], 1, i)), lambda p: ~F.lower(p["field_name"]).isin(*NO_MEASURE))
    staged = entries.select("file", "line_number", "timestamp", "fields", "message").withColumn("_named", F.when(F.col("message").rlike(r"[=:]\s*-?\d"), raw_named).otherwise(F.array().cast(f"array<{POINT}>")))
    staged = staged.withColumn("_first", F.filter("_named", lambda p: p["nth"] == F.array_min(F.transform(F.filter("_named", lambda q: q["field_name"] == p["field_name"]), lambda q: q["nth"]))))
    points = F.concat(F.coalesce(own, F.array().cast(f"array<{POINT}>")), F.col("_first"), took)
    return staged.select("file", "line_number", "timestamp", F.explode(points).alias("p")).select("file", "line_number", "timestamp", "p.field_name", "p.value", "p.unit").where("value IS NOT NULL")


def series_stats(points: DataFrame) -> DataFrame:
    """Per name: n, least, most, mean, population deviation, median, 95th and 99th percentile by linear interpolation; the unit if all agree."""
    v = F.col("value")
    p = lambda q: F.round(F.percentile(v, F.lit(q)), 6)
    unit = F.when((F.countDistinct("unit") == 1) & (F.count("unit") == F.count("*")), F.min("unit"))
    return points.groupBy("field_name").agg(
        F.count("*").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("stddev"),
        p(0.5).alias("median"), p(0.95).alias("p95"), p(0.99).alias("p99"), unit.alias("unit"),
    )


def anomalies(points: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Points further than ``threshold`` deviations from their series' mean, with z to 4 digits. Series of no spread have none."""
    facts = points.groupBy("field_name").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s")).where("_s > 0")
    z = F.abs(F.col("value") - F.col("_m")) / F.col("_s")
    return points.join(facts, "field_name").where(z > threshold).withColumn("z_score", F.round(z, 4)).drop("_m", "_s")


def time_buckets(points: DataFrame, width: str) -> DataFrame:
    """Per name and bucket, counted from the series' first time: start, n, min, max, avg. Empty buckets are absent."""
    us = bucket_micros(width)
    timed = points.where("timestamp IS NOT NULL")
    first = timed.groupBy("field_name").agg(F.min("timestamp").alias("_t0"))
    nth = F.floor((micros(F.col("timestamp")) - micros(F.col("_t0"))) / us)
    return (
        timed.join(first, "field_name").groupBy("field_name", "_t0", nth.alias("bucket"))
        .agg(F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.avg("value"), 6).alias("avg"))
        .select("field_name", "bucket", F.timestamp_add("MICROSECOND", F.col("bucket") * us, F.col("_t0")).alias("bucket_start"), "n", "min", "max", "avg")
    )


def rolling(points: DataFrame, seconds: int) -> DataFrame:
    """Each point with the number and mean of its series' points in the window before it, itself included.

    Time is cut into spans as long as the window, so a window is its own span's points so far and the later ones of the
    span before, which are sent on a window later. Both are running sums, and nothing is subtracted: work does not grow
    with the points in a window, and spans are computed side by side.
    """
    width = seconds * 1_000_000
    timed = points.where("timestamp IS NOT NULL")
    at = micros(F.col("timestamp"))
    own = timed.withColumns({"_at": at, "_held": F.col("value"), "_own": F.lit(True)})
    sent = timed.select("field_name", (at + width).alias("_at"), F.col("value").alias("_held"), F.lit(False).alias("_own"))
    both = own.unionByName(sent, allowMissingColumns=True).withColumn("_span", F.col("_at") - F.pmod(F.col("_at"), F.lit(width)))

    def sums(of: Column, order: Column) -> Column:
        so_far = Window.partitionBy("field_name", "_span").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        held = F.when(of, F.col("_held"))
        return F.struct(F.count_if(of).over(so_far).alias("n"), F.count(held).over(so_far).alias("known"), F.coalesce(F.sum(held).over(so_far), F.lit(0.0)).alias("total"))

    found = both.withColumn("_late", sums(~F.col("_own"), F.desc("_at"))).withColumn("_early", sums(F.col("_own"), F.asc("_at"))).where("_own")
    of = lambda c: F.col(f"_late.{c}") + F.col(f"_early.{c}")
    return found.select(*[found[f"`{c}`"] for c in points.columns], of("n").alias("n_near"), F.round(F.try_divide(of("total"), of("known")), 6).alias("avg_near"))
