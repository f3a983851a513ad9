"""Span trees as node tables.

A node is a group of entries: of one span, else thread, else correlation, else a single entry. Children
come from explicit parents over all entries; a node without any may get children by name
(``worker-1`` over ``worker-1.task``). A recursive query walks the edges with a guard against
cycles: a node that is its own ancestor is not repeated, where an unguarded walk would go on to its
depth limit.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.functions.levels import ERRORS
from cinderlog.plans.joins import prefixes
from cinderlog.schema import POSITION, micros

MAX_DEPTH = 50
SEPARATORS = ".:-"


def group_key() -> Column:
    return F.coalesce(F.concat(F.lit("span:"), "span_id"), F.concat(F.lit("thread:"), "thread_id"), F.concat(F.lit("correlation:"), "correlation_id"), F.concat(F.lit("entry:"), "file", F.lit(":"), F.col("line_number").cast("string")))


def child_key() -> Column:
    return F.coalesce(F.concat(F.lit("span:"), "span_id"), F.concat(F.lit("entry:"), "file", F.lit(":"), F.col("line_number").cast("string")))


def node_facts() -> list[Column]:
    """Aggregates of a node's entries. The name: a field operation_name or name, else the first short first line, else the service."""
    at = F.struct(*POSITION)
    text = lambda k: F.get_json_object(F.concat(F.lit('{"v":'), F.try_element_at(F.col("fields"), F.lit(k)), F.lit("}")), "$.v")
    string = lambda k: F.when(F.try_element_at(F.col("fields"), F.lit(k)).startswith('"'), text(k))
    line = F.regexp_extract("message", r"\A([^\r\n]*)", 1)
    short = F.when((line != "") & (F.octet_length(line) < 50) & ~line.contains("Error:") & ~line.startswith("{"), line)
    own = F.coalesce(text("duration_ms").try_cast("double"), text("duration").try_cast("double"))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), at))
    span = (F.floor(micros(F.max("timestamp")) / 1000) - F.floor(micros(F.min("timestamp")) / 1000)).cast("long")
    service = F.when(F.col("service_name") != "", F.col("service_name"))
    return [
        F.coalesce(first(string("operation_name")), first(string("name")), first(short), first(F.col("service_name"))).alias("name"),
        first(service).alias("service"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"),
        F.coalesce(first(own).cast("long"), span).alias("duration_ms"), F.count("*").alias("entry_count"), F.count_if(F.col("level").isin(*ERRORS)).alias("error_count"),
        F.min_by("parent_span_id", at).alias("parent_span_id"), F.min(at).alias("first_at"),
    ]


def root_entries(entries: DataFrame, identifier: str) -> DataFrame:
    """Entries of the span of that id; if there is none, of the thread; else of the correlation or trace."""
    is_ = lambda c: F.coalesce(F.col(c) == identifier, F.lit(False))
    ranked = entries.withColumn("_kind", F.when(is_("span_id"), 1).when(is_("thread_id"), 2).when(is_("correlation_id") | is_("trace_id"), 3))
    found = entries.agg(F.max(is_("span_id")).alias("s"), F.max(is_("thread_id")).alias("t")).first()
    if found["s"]:
        return entries.where(is_("span_id"))
    return entries.where(is_("thread_id")) if found["t"] else ranked.where(F.col("_kind") == 3).drop("_kind")


def span_roots(members: DataFrame) -> DataFrame:
    """Grouped entries (key, parent) to the keys that are roots: spans whose first parent is no span among them, and all other groups."""
    spans = members.where(F.col("key").startswith("span:")).select(F.col("key").alias("k2")).distinct()
    parent = F.concat(F.lit("span:"), "parent")
    return members.join(spans, parent == F.col("k2"), "left_anti").select("key")


def child_members(entries: DataFrame, naming: bool = True) -> DataFrame:
    """(parent_key, child_key, file, line_number): which entries make up each child of each node."""
    place = [F.col(c) for c in POSITION]
    kids = entries.where("parent_span_id IS NOT NULL").select(F.concat(F.lit("span:"), "parent_span_id").alias("parent_key"), child_key().alias("child_key"), *place)
    if not naming:
        return kids
    by_thread = entries.where("thread_id IS NOT NULL AND span_id IS NOT NULL").select(F.concat(F.lit("thread:"), "thread_id").alias("t"), F.concat(F.lit("span:"), "span_id").alias("s")).distinct()
    of_threads = kids.join(by_thread, F.col("parent_key") == F.col("s")).select(F.col("t").alias("parent_key"), "child_key", *place)
    explicit = kids.unionByName(of_threads)
    named = entries.select(F.explode(F.array_distinct(F.array_compact(F.array(F.concat(F.lit("span:"), "span_id"), F.concat(F.lit("thread:"), "thread_id"), F.concat(F.lit("thread:"), "span_id"))))).alias("parent_key"), F.coalesce("thread_id", "correlation_id", "span_id").alias("own"))
    named = named.where("own IS NOT NULL").distinct().join(explicit.select("parent_key").distinct(), "parent_key", "left_anti")
    ids = entries.select(F.explode(F.array_distinct(F.array_compact(F.array("thread_id", "span_id")))).alias("id"), *place)
    guessed = prefixes(ids, "id", SEPARATORS).join(named, F.col("prefix") == F.col("own")).select("parent_key", F.concat(F.lit("thread:"), "id").alias("child_key"), *place)
    return explicit.unionByName(guessed.where("parent_key <> child_key")).distinct()


def _walk(roots: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(key, parent_key, path, depth) of every node reached from the roots."""
    spark, tag = roots.sparkSession, uuid.uuid4().hex
    roots.createOrReplaceTempView(f"roots_{tag}")
    edges.createOrReplaceTempView(f"edges_{tag}")
    return spark.sql(f"""
        WITH RECURSIVE tree(key, parent_key, path, depth) MAX RECURSION LEVEL {max_depth + 2} AS (
          SELECT key, CAST(NULL AS STRING), array(key), 0 FROM roots_{tag}
          UNION ALL
          SELECT e.child_key, t.key, array_append(t.path, e.child_key), t.depth + 1 FROM tree t JOIN edges_{tag} e ON t.key = e.parent_key
          WHERE t.depth < {max_depth} AND NOT array_contains(t.path, e.child_key))
        SELECT * FROM tree""")


def nodes(entries: DataFrame, identifier: str, naming: bool = True, temporal: bool = False, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The node table of an id's tree: key, node_type, id, parent_key, path, depth, facts, confidence, evidence, in pre-order."""
    found = root_entries(entries, identifier).withColumn("key", group_key())
    at = F.struct(*POSITION)
    groups = found.groupBy("key").agg(F.min_by("parent_span_id", F.when(F.col("parent_span_id").isNotNull(), at)).alias("parent"))
    roots = span_roots(groups)
    members = child_members(entries, naming)
    # one request's tree is small and read several times; the walk over all edges runs once
    tree = _walk(roots, members.select("parent_key", "child_key").distinct(), max_depth).persist(StorageLevel.MEMORY_AND_DISK)
    root_facts = found.groupBy("key").agg(*node_facts()).withColumn("parent_key", F.lit(None).cast("string"))
    reached = tree.where("parent_key IS NOT NULL").select("parent_key", F.col("key").alias("child_key")).distinct()
    kid_facts = members.join(reached, ["parent_key", "child_key"]).join(entries, list(POSITION)).groupBy("parent_key", F.col("child_key").alias("key")).agg(*node_facts())
    facts = root_facts.unionByName(kid_facts)
    joined = tree.alias("t").join(facts.alias("f"), F.expr("t.key = f.key AND t.parent_key <=> f.parent_key")).select("t.*", *[F.col(f"f.{c}") for c in facts.columns if c not in ("key", "parent_key")])
    explicit = F.col("parent_span_id").isNotNull()
    confidence = F.when(explicit, 1.0).when(F.lit(naming), 0.8).when(F.lit(temporal), 0.6).otherwise(0.0)
    guess = F.array(*([F.lit("naming_pattern")] if naming else []), *([F.lit("temporal_proximity")] if temporal else [])).cast("array<string>")
    typed = joined.select(
        "key", F.initcap(F.substring_index("key", ":", 1)).alias("node_type"), F.expr("substr(key, instr(key, ':') + 1)").alias("id"), "parent_key", "path", "depth", "name", "service", "start_time", "end_time",
        "duration_ms", "entry_count", "error_count", "parent_span_id", confidence.alias("confidence"), F.when(explicit, F.array(F.lit("explicit_parent_span_id"))).otherwise(guess).alias("evidence"), "first_at",
    )
    return in_pre_order(typed.persist(StorageLevel.MEMORY_AND_DISK))


def in_pre_order(table: DataFrame) -> DataFrame:
    """Adds ``position``: siblings by start (null last), first line, id; a node before its children."""
    sibling = F.struct(F.col("start_time").isNull().alias("late"), "start_time", F.col("first_at.line_number").alias("line"), "id")
    own = table.select(F.col("path").alias("p"), sibling.alias("s"))
    up = table.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", 1, i))).alias("i", "p"))
    order = up.join(own, "p").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("order"))
    # one request's nodes: their total order is the result
    return table.join(order, "path").withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("order"))).drop("order")


def span_table(entries: DataFrame) -> DataFrame:
    """Every span of the logs at once: span_id, parent (its first), facts. One shuffle by span."""
    at = F.struct(*POSITION)
    facts = [f for f in node_facts() if "parent_span_id" not in str(f)]
    first_parent = F.min_by("parent_span_id", F.when(F.col("parent_span_id").isNotNull(), at)).alias("parent_id")
    return entries.where("span_id IS NOT NULL").groupBy("span_id").agg(first_parent, F.min("trace_id").alias("trace_id"), *facts)


def self_times(spans: DataFrame, key: str = "span_id", parent: str = "parent_id") -> DataFrame:
    """Adds children_ms, children and self_ms: the time that no child takes, never below 0."""
    kids = spans.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_p")).agg(F.sum(F.coalesce("duration_ms", F.lit(0))).alias("children_ms"), F.count("*").alias("children"))
    out = spans.join(kids, F.col(key) == F.col("_p"), "left").drop("_p").fillna(0, ["children_ms", "children"])
    return out.withColumn("self_ms", F.greatest(F.col("duration_ms") - F.col("children_ms"), F.lit(0)))


def tree_self_times(table: DataFrame) -> DataFrame:
    """The same for a node table, by path."""
    return self_times(table.withColumn("_path", F.array_join("path", "\x1f")).withColumn("_up", F.when(F.size("path") > 1, F.array_join(F.expr("slice(path, 1, size(path) - 1)"), "\x1f"))), "_path", "_up").drop("_path", "_up")


def total_duration(table: DataFrame) -> DataFrame:
    """One row: nodes, depth, total ms (the roots' range or the sum of their durations, whichever is more), most nodes of a depth less one."""
    roots = table.where("depth = 0")
    ms = lambda c: F.floor(micros(c) / 1000)
    one = roots.agg(F.greatest(F.coalesce(ms(F.max("end_time")) - ms(F.min("start_time")), F.lit(0)), F.coalesce(F.sum("duration_ms"), F.lit(0))).alias("total_duration_ms"))
    size = table.agg(F.countDistinct("key").alias("total_nodes"), F.max("depth").alias("max_depth"))
    wide = table.groupBy("depth").agg(F.count("*").alias("n")).agg((F.max("n") - 1).alias("concurrent_count"))
    return size.join(one).join(wide)


def bottleneck(table: DataFrame) -> DataFrame:
    """The node of most self time (the first in pre-order of equals) and its part of the total in per cent."""
    most = tree_self_times(table).where("self_ms IS NOT NULL").orderBy(F.desc("self_ms"), "position").limit(1)
    total = total_duration(table).select("total_duration_ms")
    return most.join(total).select(F.col("id").alias("node_id"), F.col("self_ms").alias("duration_ms"), F.when(F.col("total_duration_ms") > 0, F.round(100 * F.col("self_ms") / F.col("total_duration_ms"), 6)).otherwise(0.0).alias("percentage"), "depth")


def error_nodes(table: DataFrame) -> DataFrame:
    """Ids of nodes with errors of their own, each once, in pre-order."""
    return table.where("error_count > 0").groupBy("id").agg(F.min("position").alias("position")).orderBy("position").select("id")


def root_causes(table: DataFrame) -> DataFrame:
    """Error nodes none of whose children has errors: with their paths, 1.0 for leaves, else 0.85; deepest and earliest first."""
    up = F.expr("slice(path, 1, size(path) - 1)")
    kids = table.where("depth > 0").groupBy(up.alias("p")).agg(F.count("*").alias("kids"), F.count_if(F.col("error_count") > 0).alias("bad"))
    out = table.where("error_count > 0").join(kids, F.col("path") == F.col("p"), "left").where("coalesce(bad, 0) = 0")
    return out.select("id", "node_type", "error_count", "depth", "start_time", "path", F.col("kids").isNull().alias("is_leaf"), F.when(F.col("kids").isNull(), 1.0).otherwise(0.85).alias("confidence"), "position").orderBy(F.desc("depth"), F.col("start_time").asc_nulls_first(), "position").drop("position")


def propagation(table: DataFrame) -> DataFrame:
    """For each root cause with an erring ancestor: cause, and the chain of erring nodes upward from it."""
    bad = table.where("error_count > 0").select(F.array_join("path", "\x1f").alias("p"), F.col("id").alias("up_id"))
    ups = root_causes(table).select("id", "path", F.explode(F.sequence(F.size("path"), F.lit(1), F.lit(-1))).alias("n")).withColumn("p", F.expr("array_join(slice(path, 1, n), '\x1f')"))
    chained = ups.join(bad, "p").groupBy("id", "path").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "up_id")), False), lambda x: x["up_id"]).alias("chain"))
    return chained.where(F.size("chain") > 1).select("id", "chain", F.size("chain").alias("length"))


def impact(table: DataFrame) -> DataFrame:
    """One row: nodes with errors, their part of all in per cent, the deepest root cause's depth, and how many root causes share a depth, if more than one does."""
    causes = root_causes(table)
    hit = table.where("error_count > 0").agg(F.countDistinct("id").alias("affected"))
    n = table.agg(F.countDistinct("key").alias("n"))
    deep = causes.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_propagation_depth"))
    together = causes.groupBy("depth").count().agg(F.coalesce(F.max(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("concurrent_failures"))
    return hit.join(n).join(deep).join(together).select("affected", F.round(100 * F.col("affected") / F.col("n"), 6).alias("affected_percentage"), "max_propagation_depth", "concurrent_failures")


def recommendations(table: DataFrame) -> DataFrame:
    """What to look at, in order of ``place``: rule, the node it names (else null) and the number it rests on. No rows without errors.

    first_cause: the deepest, earliest root cause, and its depth. outside_call: that cause calls nothing further. cascade: nodes in chains of
    errors. together: causes side by side at one depth. wide: the part of all nodes hit, in per cent, beyond half.
    """
    # three single rows come to the driver
    cause, facts = root_causes(table).select("id", "depth", "is_leaf").first(), impact(table).first()
    cascade = propagation(table).agg(F.sum("length")).first()[0]
    found = []
    if cause:
        found.append((1, "first_cause", cause["id"], float(cause["depth"])))
        if cause["is_leaf"]:
            found.append((2, "outside_call", cause["id"], float(cause["depth"])))
    if cascade:
        found.append((3, "cascade", None, float(cascade)))
    if facts["concurrent_failures"] > 1:
        found.append((4, "together", None, float(facts["concurrent_failures"])))
    if facts["affected"] and facts["affected_percentage"] > 50:
        found.append((5, "wide", None, float(facts["affected_percentage"])))
    return table.sparkSession.createDataFrame(found, "place int, rule string, node string, number double").orderBy("place")


def secondary_bottlenecks(table: DataFrame, threshold: float = 20.0, most: int = 4) -> DataFrame:
    """Nodes besides the primary one with at least so many per cent of the total in self time."""
    first = bottleneck(table).select(F.col("node_id").alias("primary"))
    total = total_duration(table).select("total_duration_ms")
    timed = tree_self_times(table).where("duration_ms > 0").join(total).where("total_duration_ms > 0").withColumn("self_percentage", 100 * F.col("self_ms") / F.col("total_duration_ms"))
    return timed.join(first, F.col("id") == F.col("primary"), "left_anti").where(F.col("self_percentage") >= threshold).orderBy(F.desc("self_ms"), F.desc("duration_ms"), "position").limit(most).select("id", "duration_ms", "self_ms", F.round("self_percentage", 6).alias("self_percentage"), "depth", "children", "error_count")


def parallel_savings(table: DataFrame) -> DataFrame:
    """Depths at which running nodes side by side would save over a tenth of the total."""
    total = total_duration(table).select("total_duration_ms")
    per = table.where("duration_ms > 0").groupBy("depth").agg(F.count("*").alias("n"), (F.sum("duration_ms") - F.max("duration_ms")).alias("potential_savings_ms"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]), 1, 3).alias("nodes"))
    return per.join(total).where((F.col("n") >= 2) & (F.col("potential_savings_ms") > 0.1 * F.col("total_duration_ms"))).select("depth", "nodes", "potential_savings_ms")


def cache_candidates(table: DataFrame) -> DataFrame:
    """Of more than three timed leaves, up to three that take over twice their average."""
    leaves = tree_self_times(table).where("children = 0 AND duration_ms > 0")
    mean = leaves.agg(F.avg("duration_ms").alias("mean"), F.count("*").alias("leaves"))
    return leaves.join(mean).where("leaves > 3 AND duration_ms > 2 * mean").orderBy(F.desc("duration_ms"), "position").limit(3).select("id", "duration_ms")


def circuit_breakers(table: DataFrame) -> DataFrame:
    """Nodes with errors and over a tenth of the total time."""
    total = total_duration(table).select("total_duration_ms")
    return table.where("error_count > 0 AND duration_ms > 0").join(total).where("duration_ms > 0.1 * total_duration_ms").select("id", "duration_ms", "error_count")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes of two tables (id, duration_ms, error_count) side by side: change over 10 ms either way, new, removed, and errors that came or went."""
    x, y = (t.select("id", F.coalesce("duration_ms", F.lit(0)).alias(f"{n}_ms"), F.col("error_count").alias(f"{n}_errors")) for t, n in ((a, "before"), (b, "after")))
    both = x.join(y, "id", "full_outer")
    change = F.col("after_ms") - F.col("before_ms")
    status = F.when(F.col("after_errors").isNull(), "removed").when(F.col("before_errors").isNull(), "new").when(change < -10, "improved").when(change > 10, "degraded").otherwise("same")
    errors = F.when((F.col("before_errors") == 0) & (F.col("after_errors") > 0), "new").when((F.col("before_errors") > 0) & (F.col("after_errors") == 0), "resolved")
    return both.select("id", "before_ms", "after_ms", change.alias("change_ms"), status.alias("status"), errors.alias("errors"))


def detection_method(explicit: bool, naming: bool, temporal: bool) -> str:
    used = [n for n, on in (("ExplicitParentId", explicit), ("NamingPattern", naming), ("TemporalInference", temporal)) if on]
    return used[0] if len(used) == 1 else "Mixed" if used else "Unknown"


#: What messages say of chained requests; those with "parent" name the parent.
CHAIN_PATTERNS = (
    r'child_correlation_id["\s:=]+([a-zA-Z0-9_-]+)', r'parent_correlation_id["\s:=]+([a-zA-Z0-9_-]+)', r'parent_request_id["\s:=]+([a-zA-Z0-9_-]+)', r'spawned_request["\s:=]+([a-zA-Z0-9_-]+)',
    r"[Ss]pawning (?:sub-?)?request[:\s]+([a-zA-Z0-9_-]+)", r"[Cc]reating child request[:\s]+([a-zA-Z0-9_-]+)", r"[Ff]orked to[:\s]+([a-zA-Z0-9_-]+)", r"[Dd]elegating to[:\s]+([a-zA-Z0-9_-]+)", r"[Ss]ub-?request[:\s]+([a-zA-Z0-9_-]+)",
)


def chains(entries: DataFrame, patterns: tuple[str, ...] = CHAIN_PATTERNS) -> DataFrame:
    """(parent, child, confidence, first time) of chained correlations: 1.0 from fields, 0.85 from messages; the first evidence of a pair counts."""
    from cinderlog.operators.predicates import field

    own = F.col("correlation_id")
    child = F.coalesce(F.nullif(field("child_correlation_id"), F.lit("")), F.nullif(field("spawned_request"), F.lit("")))
    parent = F.coalesce(F.nullif(field("parent_correlation_id"), F.lit("")), F.nullif(field("parent_request_id"), F.lit("")))
    pair = lambda p, c, conf, i: F.struct(p.alias("parent"), c.alias("child"), F.lit(conf).alias("confidence"), F.lit(i).alias("nth"))
    found = [pair(own, child, 1.0, 0), pair(parent, own, 1.0, 1)]
    for i, p in enumerate(patterns):
        got = F.nullif(F.regexp_extract("message", p, 1), F.lit(""))
        got = F.when(got != own, got)
        found.append(pair(got, own, 0.85, i + 2) if "parent" in p.lower() else pair(own, got, 0.85, i + 2))
    each = entries.where("correlation_id IS NOT NULL").select("timestamp", *POSITION, F.explode(F.array(*found)).alias("x")).where("x.parent IS NOT NULL AND x.child IS NOT NULL")
    first = F.struct(F.col("timestamp").isNull().alias("late"), "timestamp", *POSITION, "x.nth")
    return each.groupBy("x.parent", "x.child").agg(F.min_by("x.confidence", first).alias("confidence"), F.min_by("timestamp", first).alias("timestamp"))


def chain_roots(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Correlations that are nobody's child."""
    ids = entries.where("correlation_id IS NOT NULL").select(F.col("correlation_id").alias("id")).union(links.select("parent")).union(links.select("child")).distinct()
    return ids.join(links.select(F.col("child").alias("id")).distinct(), "id", "left_anti")


def descendants(links: DataFrame, root: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Every correlation below a root, with its depth and path."""
    start = links.sparkSession.createDataFrame([(root,)], "key string")
    return _walk(start, links.select(F.col("parent").alias("parent_key"), F.col("child").alias("child_key")), max_depth)
