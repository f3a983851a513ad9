"""Samples of entries by strategy, and how well a sample covers its population."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.functions.levels import ERRORS
from cinderlog.operators.search import by_time
from cinderlog.schema import micros, shown_level

STRATEGIES = ("representative", "diverse", "chronological", "errors_focused")


def population(entries: DataFrame, size: int) -> DataFrame:
    """The earliest max(10 x size, 500) entries: what a sample is drawn from. A stated bound, so a window over it is one small task."""
    return entries.orderBy(*by_time()).limit(max(10 * size, 500))


def _numbered(entries: DataFrame, order: list) -> DataFrame:
    return entries.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1)


def quotas(counts: DataFrame, size: int) -> DataFrame:
    """(level, n) to quotas that add up to ``size``: floors, then largest remainders, then one for each level if there is room, given by the level with most."""
    whole = Window.partitionBy(F.lit(0))
    q = counts.withColumn("_total", F.sum("n").over(whole)).withColumn("_q", F.expr(f"({size} * n) div _total")).withColumn("_rest", F.expr(f"({size} * n) % _total"))
    q = q.withColumn("_spare", F.lit(size) - F.sum("_q").over(whole)).withColumn("_rank", F.row_number().over(whole.orderBy(F.desc("_rest"), "level")))
    q = q.withColumn("_q", F.col("_q") + (F.col("_rank") <= F.col("_spare")).cast("long"))
    q = q.withColumn("_levels", F.count("*").over(whole)).withColumn("_poor", F.sum((F.col("_q") == 0).cast("long")).over(whole))
    # at most seven levels: the richest gives what the empty ones lack
    richest = F.row_number().over(whole.orderBy(F.desc("_q"), "level")) == 1
    lend = F.lit(size) >= F.col("_levels")
    return q.select("level", "n", F.when(lend & (F.col("_q") == 0), 1).when(lend & richest, F.col("_q") - F.col("_poor")).otherwise(F.col("_q")).cast("long").alias("quota"))


def representative(entries: DataFrame, size: int) -> DataFrame:
    """Every level by its quota, evenly spaced over positions."""
    per = Window.partitionBy(shown_level()).orderBy(*by_time())
    ranked = entries.withColumn("_level", shown_level()).withColumn("_p", F.row_number().over(per) - 1)
    share = quotas(entries.groupBy(shown_level().alias("level")).agg(F.count("*").alias("n")), size).select(F.col("level").alias("_l"), "n", "quota")
    joined = ranked.join(F.broadcast(share), F.col("_level") == F.col("_l"))
    # position p is picked if some i < quota has floor(i * n / quota) = p; all entries, if there are no more than size
    i = F.expr("ceil(_p * quota / n)")
    picked = (i < F.col("quota")) & (F.floor(i * F.col("n") / F.col("quota")) == F.col("_p"))
    few = entries.groupBy().agg((F.count("*") <= size).alias("_few"))
    return joined.join(F.broadcast(few)).where(F.col("_few") | ((F.col("quota") > 0) & picked)).drop("_level", "_p", "_l", "n", "quota", "_few")


def chronological(entries: DataFrame, size: int) -> DataFrame:
    """Evenly spaced over time order."""
    ranked = _numbered(entries, by_time()).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    i = F.ceil(F.col("_i") * size / F.col("_n"))
    return ranked.where((F.col("_n") <= size) | ((i < size) & (F.floor(i * F.col("_n") / size) == F.col("_i")))).drop("_i", "_n")


def diverse(entries: DataFrame, size: int) -> DataFrame:
    """New messages first, then new threads, then evenly spaced ones."""
    thread = F.coalesce("thread_id", "correlation_id")
    ranked = _numbered(entries, by_time()).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    ranked = ranked.withColumn("_m", F.when(F.coalesce(F.col("message"), F.lit("")) != "", F.row_number().over(Window.partitionBy("message").orderBy("_i"))))
    ranked = ranked.withColumn("_t", F.when(thread.isNotNull(), F.row_number().over(Window.partitionBy(thread).orderBy("_i"))))
    first = F.when(F.col("_m") == 1, 0).when(F.col("_t") == 1, 1).otherwise(2)
    spaced = F.when((first == 2) & (F.floor(F.ceil(F.col("_i") * size / F.col("_n")) * F.col("_n") / size) == F.col("_i")), 0).otherwise(1)
    return ranked.orderBy(first, spaced, "_i").limit(size).drop("_i", "_n", "_m", "_t")


def errors_focused(entries: DataFrame, size: int) -> DataFrame:
    """Seven tenths errors, evenly spaced if there are more, and the rest others, evenly spaced."""
    bad = F.col("level").isin(*ERRORS)
    budget = int(size * 0.7)
    kind = F.coalesce(bad, F.lit(False))
    ranked = _numbered(entries, by_time()).withColumn("_bad", kind).withColumn("_k", F.row_number().over(Window.partitionBy("_bad").orderBy("_i")) - 1).withColumn("_of", F.count("*").over(Window.partitionBy("_bad")))
    errors = F.sum(F.col("_bad").cast("long")).over(Window.partitionBy(F.lit(0)))
    quota = F.when(F.col("_bad"), F.least(F.col("_of"), F.lit(budget))).otherwise(F.least(F.col("_of"), F.lit(size) - F.least(errors, F.lit(budget))))
    ranked = ranked.withColumn("_q", quota)
    i = F.ceil(F.col("_k") * F.col("_q") / F.col("_of"))
    return ranked.where((F.col("_q") > 0) & (i < F.col("_q")) & (F.floor(i * F.col("_of") / F.col("_q")) == F.col("_k"))).drop("_i", "_bad", "_k", "_of", "_q")


def sample(entries: DataFrame, strategy: str = "representative", size: int = 100) -> DataFrame:
    """A sample of the earliest part of the entries; a strategy of another name runs as representative. Errors-focused draws from the earliest errors and the earliest others."""
    if strategy == "errors_focused":
        bad, budget = F.coalesce(F.col("level").isin(*ERRORS), F.lit(False)), int(size * 0.7)
        return errors_focused(population(entries.where(bad), budget).unionByName(population(entries.where(~bad), size - budget)), size).orderBy(*by_time())
    pick = {"diverse": diverse, "chronological": chronological}.get(strategy, representative)
    return pick(population(entries, size), size).orderBy(*by_time())


def coverage(whole: DataFrame, part: DataFrame) -> DataFrame:
    """One row: the part of the time span covered (1 at most), threads in both, and their ratio."""
    thread = F.coalesce("thread_id", "correlation_id")
    facts = lambda e, n: e.agg((micros(F.max("timestamp")) - micros(F.min("timestamp"))).alias(f"span_{n}"), F.countDistinct(thread).alias(f"threads_{n}"))
    both = facts(whole, "all").join(facts(part, "part"))
    return both.select(
        F.round(F.when(F.col("span_all") > 0, F.least(F.lit(1.0), F.col("span_part") / F.col("span_all"))).otherwise(0.0), 6).alias("time_coverage"), F.col("threads_part").alias("threads_in_sample"),
        F.col("threads_all").alias("threads_in_population"), F.round(F.when(F.col("threads_all") > 0, F.col("threads_part") / F.col("threads_all")).otherwise(0.0), 6).alias("thread_coverage"),
    )


