"""URL verdicts: prefix rules first, and for the rest trust and distrust carried over a host graph.

The graph's edges are absolute links between hosts, counted per pair before any shuffle of rows,
and the two directions between a host and its parent domain. Personalised PageRank starts from
hosts with pages that a rule allows (trust, along edges) and from hosts with pages that a rule
blocks (distrust, against edges); a host whose distrust exceeds its trust by more than TIE of it is
blocked. Scores shrink with the number of pages, so they are compared as they are; the SQL rounds them to
DIGITS places first, which from some hundred thousand pages on can let hosts of few shares through.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and is allowed;
null html has no links; equal rows are judged alike; no page, no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.stages import drop, small, stage

#: (verdict, host, path): the production rules. A rule list is part of the plan: at most some hundred entries.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?\s*[a-z][a-z0-9+.\-]*://([^/?#"'\s<>]+)"""
ROUNDS, DAMPING, DIGITS = 8, 0.85, 9
#: Sums of equal parts in another order differ by less than this part of them.
TIE = 1e-9
#: Host scores are broadcast up to this many hosts; beyond, the join is shuffled and skew is split.
MOST_HOSTS = 20_000


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) of links and of parent domains; one row per pair."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    named = pages.select("host").union(links.select("dst")).distinct().select(F.split("host", r"\.").alias("labels")).where("size(labels) > 2")
    suffix = lambda i: F.array_join(F.slice("labels", i, F.size("labels")), ".")
    up = named.select(F.explode(F.sequence(F.lit(1), F.size("labels") - 2)).alias("i"), "labels").select(suffix(F.col("i")).alias("child"), suffix(F.col("i") + 1).alias("parent")).distinct()
    both = up.select(F.col("child").alias("src"), F.col("parent").alias("dst")).union(up.select(F.col("parent").alias("src"), F.col("child").alias("dst")))
    return links.union(both.withColumn("weight", F.lit(1.0))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Seeds (kind, node, x) and edges (edge_kind, src, dst, share) to scores (kind, node, x)."""
    base = seeds.select("kind", "node", (F.col("x") * (1 - damping)).alias("x"))
    state, old = seeds, None
    for k in range(1, rounds + 1):
        passed = state.join(edges, F.expr("kind = edge_kind AND node = src")).select("kind", F.col("dst").alias("node"), (F.col("x") * F.col("share") * damping).alias("x"))
        state = passed.union(base).groupBy("kind", "node").agg(F.sum("x").alias("x"))
        if k % 4 == 0 and k < rounds:
            state = stage(state)
            if old is not None:
                drop(old)
            old = state
    return state


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = seen.select("page_id", "host", "path", first_rule(F.col("host"), F.col("path"), rules).alias("first"))
    counted = stage(ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("first.verdict") == "allow").alias("good"), F.count_if(F.col("first.verdict") == "block").alias("bad"), F.count("*").alias("pages")))
    pairs = stage(host_edges(seen.where("host <> ''").select("host", "html")))
    total = F.lit(float(counted.agg(F.sum("pages")).first()[0] or 1))
    seeds = counted.select(F.lit("trust").alias("kind"), F.col("host").alias("node"), (F.col("good") / total).alias("x")).union(counted.select(F.lit("distrust"), "host", F.col("bad") / total)).where("x > 0")
    out, into = (pairs.groupBy(c).agg(F.sum("weight").alias("all")).withColumnRenamed(c, "end") for c in ("src", "dst"))
    forward = pairs.join(out, F.col("src") == F.col("end")).select(F.lit("trust").alias("edge_kind"), "src", "dst", (F.col("weight") / F.col("all")).alias("share"))
    back = pairs.join(into, F.col("dst") == F.col("end")).select(F.lit("distrust").alias("edge_kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("all")).alias("share"))
    scores = propagate(stage(seeds), stage(forward.union(back)), rounds)
    per_host = stage(scores.groupBy(F.col("node").alias("_host")).agg(*[F.sum(F.when(F.col("kind") == k, F.col("x")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")]))
    trust, distrust = (F.coalesce(F.col(k), F.lit(0.0)) for k in ("trust", "distrust"))
    return ruled.join(small(per_host, MOST_HOSTS), F.col("host") == F.col("_host"), "left").select(
        "page_id", "host", "path", F.col("first.rule").alias("rule"), F.coalesce(F.col("first.verdict"), F.when(distrust > trust * (1 + TIE), "block").otherwise("allow")).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )


def _sql(rounds: int = ROUNDS) -> str:
    case = "".join(f" WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{v}'}}" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    link = LINK.replace("'", "''")
    steps = "".join(
        f""", s{k} AS MATERIALIZED (SELECT kind, node, sum(x) AS x FROM (
  SELECT e.kind, e.dst AS node, s.x * e.share * {DAMPING}::DOUBLE AS x FROM s{k - 1} s JOIN edges e ON s.kind = e.kind AND s.node = e.src
  UNION ALL SELECT kind, node, x * (1 - {DAMPING}::DOUBLE) FROM s0) GROUP BY ALL)"""
        for k in range(1, rounds + 1)
    )
    return rf"""
WITH seen AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{HOST}', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '{PATH}', 1), '') AS path, html FROM pages),
ruled AS MATERIALIZED (SELECT *, CASE{case} END AS f FROM seen),
counted AS (SELECT host, count(*) FILTER (f.verdict = 'allow') AS good, count(*) FILTER (f.verdict = 'block') AS bad FROM ruled WHERE host <> '' GROUP BY host),
linked AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM ruled WHERE host <> ''),
links AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM linked WHERE src <> dst GROUP BY ALL),
labelled AS (SELECT DISTINCT string_split(host, '.') AS l FROM (SELECT host FROM ruled UNION SELECT dst FROM links) WHERE len(string_split(host, '.')) > 2),
numbered AS (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM labelled),
up AS (SELECT DISTINCT array_to_string(l[i:], '.') AS child, array_to_string(l[i + 1:], '.') AS parent FROM numbered),
pairs AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM links UNION ALL SELECT child, parent, 1.0::DOUBLE FROM up UNION ALL SELECT parent, child, 1.0::DOUBLE FROM up) GROUP BY ALL),
edges AS MATERIALIZED (SELECT 'trust' AS kind, src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM pairs
  UNION ALL SELECT 'distrust', dst, src, weight / sum(weight) OVER (PARTITION BY dst) FROM pairs),
total AS (SELECT count(*)::DOUBLE AS n FROM ruled WHERE host <> ''),
s0 AS MATERIALIZED (SELECT * FROM (SELECT 'trust' AS kind, host AS node, good / n AS x FROM counted, total UNION ALL SELECT 'distrust', host, bad / n FROM counted, total) WHERE x > 0){steps},
per_host AS (SELECT node, round(coalesce(sum(x) FILTER (kind = 'trust'), 0), {DIGITS}) AS trust, round(coalesce(sum(x) FILTER (kind = 'distrust'), 0), {DIGITS}) AS distrust FROM s{rounds} GROUP BY node)
SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN per_host ON host = node
"""


SQL = _sql()
