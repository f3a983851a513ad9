"""Correlation by rules: equal values, windows around anchors, and windows around triggers."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.functions.ids import virtual_trace_id
from cinderlog.functions.patterns import name_matches
from cinderlog.functions.times import BadDuration, window_duration
from cinderlog.operators import predicates
from cinderlog.operators.predicates import EventCondition, Filters, NoTrigger
from cinderlog.plans.joins import band_join
from cinderlog.schema import POSITION

CUT = 120


class BadRules(ValueError):
    pass


@dataclass(frozen=True)
class FieldMatch:
    source_field: str
    target_field: str
    source_files: str | None = None
    target_files: str | None = None


@dataclass(frozen=True)
class Temporal:
    anchor: EventCondition
    window: str = "5s"


@dataclass(frozen=True)
class Group:
    rules: tuple[FieldMatch | Temporal, ...]
    description: str = ""


@dataclass
class Rules:
    groups: dict[str, Group] = field(default_factory=dict)


def parse_rules(data: dict[str, Any]) -> Rules:
    """The ``correlations`` mapping of a configuration file."""
    out = Rules()
    for name, spec in (data or {}).items():
        rules: list[FieldMatch | Temporal] = []
        for i, r in enumerate((spec or {}).get("rules") or []):
            try:
                if r.get("type") == "field_match":
                    rules.append(FieldMatch(r["source"]["field"], r["target"]["field"], r["source"].get("file_pattern"), r["target"].get("file_pattern")))
                elif r.get("type") == "temporal":
                    window_duration(r["window"])
                    rules.append(Temporal(EventCondition(**r["anchor"]), r["window"]))
                else:
                    raise BadRules(f"type {r.get('type')!r}")
            except (KeyError, TypeError, BadDuration, BadRules) as e:
                raise BadRules(f"correlation {name!r}, rule {i}: {e}") from None
        if not rules:
            raise BadRules(f"correlation {name!r} has no rules")
        out.groups[name] = Group(tuple(rules), (spec or {}).get("description", ""))
    return out


def iso(ts: F.Column) -> F.Column:
    """A time as isoformat() spells it in UTC: six digits of fraction or none."""
    us = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(us != "000000", F.concat(F.lit("."), us)).otherwise(F.lit("")), F.lit("+00:00"))


def said() -> F.Column:
    return F.substring(F.when(F.col("message") != "", F.col("message")).otherwise(F.coalesce("raw", F.lit(""))), 1, CUT)


def field_match_members(entries: DataFrame, rule: FieldMatch) -> DataFrame:
    """(shared_value, side, file, line_number) of values that both sides have; an entry of both sides is there twice."""
    pick = lambda name, files, side: entries.where(name_matches(F.col("file"), files)).select(predicates.field(name).cast("string").alias("shared_value"), F.lit(side).alias("side"), *POSITION).where("shared_value IS NOT NULL")
    both = pick(rule.source_field, rule.source_files, "source").unionByName(pick(rule.target_field, rule.target_files, "target"))
    # counted per side before the join, so that a common value is one row on the right
    shared = both.groupBy("shared_value").agg(F.countDistinct("side").alias("sides")).where("sides = 2").select("shared_value")
    return both.join(shared, "shared_value", "left_semi")


def field_match(entries: DataFrame, rule: FieldMatch, group: str, index: int) -> DataFrame:
    """One row per shared value: virtual_trace_id, shared_value, source_count, target_count, entry_count."""
    counted = field_match_members(entries, rule).groupBy("shared_value").agg(F.count_if(F.col("side") == "source").alias("source_count"), F.count_if(F.col("side") == "target").alias("target_count"))
    vt = virtual_trace_id(F.lit(group), F.lit(str(index)), F.col("shared_value"))
    return counted.select(vt.alias("virtual_trace_id"), F.lit(group).alias("group"), F.lit(index).alias("rule_index"), "shared_value", "source_count", "target_count", (F.col("source_count") + F.col("target_count")).alias("entry_count"))


def temporal_members(entries: DataFrame, rule: Temporal) -> DataFrame:
    """Anchors (a_...) with each entry of their window."""
    us = round(window_duration(rule.window).total_seconds() * 1e6)
    anchors = entries.where(rule.anchor.column()).select(*POSITION, "timestamp", said().alias("message"))
    return band_join(anchors, entries.select(*POSITION, "timestamp"), us)


def temporal(entries: DataFrame, rule: Temporal, group: str, index: int) -> DataFrame:
    """One row per anchor with company: virtual_trace_id, anchor's place, time and message, entry_count."""
    counted = temporal_members(entries, rule).groupBy("a_file", "a_line_number", "a_timestamp", "a_message").agg(F.count("*").alias("entry_count")).where("entry_count > 1")
    vt = virtual_trace_id(F.lit(group), F.lit(str(index)), F.concat(iso(F.col("a_timestamp")), F.lit(":"), F.col("a_message")))
    return counted.select(vt.alias("virtual_trace_id"), F.lit(group).alias("group"), F.lit(index).alias("rule_index"), F.col("a_file").alias("anchor_file"), F.col("a_line_number").alias("anchor_line"), F.col("a_timestamp").alias("anchor_timestamp"), F.col("a_message").alias("anchor_message"), "entry_count")


class UnknownGroup(LookupError):
    pass


def by_rules(entries: DataFrame, rules: Rules, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All clusters of all rules (or one group's), and one row with how many clusters and distinct entries there are."""
    if group is not None and group not in rules.groups:
        raise UnknownGroup(group)
    clusters, members = [], []
    for name, g in rules.groups.items():
        if group in (None, name):
            for i, rule in enumerate(g.rules):
                if isinstance(rule, FieldMatch):
                    found = field_match(entries, rule, name, i)
                    clusters.append(found.select("virtual_trace_id", "group", F.lit("field_match").alias("rule_type"), "rule_index", F.col("shared_value").alias("key"), "entry_count"))
                    members.append(field_match_members(entries, rule).select(*POSITION))
                else:
                    found = temporal(entries, rule, name, i)
                    clusters.append(found.select("virtual_trace_id", "group", F.lit("temporal").alias("rule_type"), "rule_index", F.concat(iso(F.col("anchor_timestamp")), F.lit(":"), "anchor_message").alias("key"), "entry_count"))
                    own = temporal_members(entries, rule)
                    company = own.groupBy("a_file", "a_line_number").agg(F.count("*").alias("n")).where("n > 1").drop("n")
                    members.append(own.join(company, ["a_file", "a_line_number"], "left_semi").select(*POSITION))
    whole = reduce(DataFrame.unionByName, clusters)
    distinct = reduce(DataFrame.unionByName, members).distinct().agg(F.count("*").alias("total_entries_correlated"))
    return whole, whole.agg(F.count("*").alias("total_clusters")).join(distinct)


def around(entries: DataFrame, timestamp: str, window: str = "5s") -> DataFrame:
    """Entries within a window of a time; entries without a time come too, as in any search by time."""
    from cinderlog.functions.times import time_bound

    at, delta = time_bound(timestamp), window_duration(window)
    return entries.where(Filters(time_start=at - delta, time_end=at + delta).column())


def trigger_anchors(entries: DataFrame, what: EventCondition) -> DataFrame:
    """Triggers in order of file, time and line, numbered; of those in one second only the first."""
    if not what.given():
        raise NoTrigger("a trigger needs a level, a pattern, a file pattern or a field")
    order = [F.col("file"), F.col("timestamp").asc_nulls_last(), F.col("line_number")]
    keep = F.lit(True)
    if what.level is not None:
        keep = keep & Filters(level=what.level).column()
    if what.pattern is not None:
        keep = keep & Filters(query=what.pattern).column()
    if what.file_pattern is not None or (what.field and what.condition):
        keep = keep & what.column()
    found = entries.where(keep)
    # triggers are numbered over all of them: the number is part of each id
    numbered = found.withColumn("nth", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1).where("timestamp IS NOT NULL")
    first = Window.partitionBy(F.date_trunc("second", F.col("timestamp"))).orderBy("nth")
    return numbered.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def by_trigger(entries: DataFrame, what: EventCondition, window: str = "5s") -> DataFrame:
    """One row per trigger with company in its window, those without a time counted in each: virtual_trace_id, place, entry_count."""
    us = round(window_duration(window).total_seconds() * 1e6)
    anchors = trigger_anchors(entries, what).select(*POSITION, "timestamp", "nth", said().alias("message"))
    counted = band_join(anchors, entries.select("timestamp"), us).groupBy("a_file", "a_line_number", "a_timestamp", "a_nth", "a_message").agg(F.count("*").alias("n"))
    bare = entries.where("timestamp IS NULL").agg(F.count("*").alias("bare"))
    counted = counted.join(F.broadcast(bare)).withColumn("entry_count", F.col("n") + F.col("bare")).where("entry_count > 1")
    vt = virtual_trace_id(F.lit("event-trigger"), F.col("a_nth").cast("string"), F.concat(iso(F.col("a_timestamp")), F.lit(":"), F.col("a_message")))
    return counted.select(vt.alias("virtual_trace_id"), F.col("a_file").alias("anchor_file"), F.col("a_line_number").alias("anchor_line"), F.col("a_timestamp").alias("anchor_timestamp"), "entry_count")
