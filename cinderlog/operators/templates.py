"""Message templates by a fixed-depth parse tree.

Messages of one number of words and one first word (``<*>`` for a variable one) meet in a leaf. There each
joins the most similar template, at least half alike, whose differing words become ``<*>``, or opens
a new one. Leaves do not touch each other except through the cap on templates of all leaves, so they
run side by side: a first pass finds where the capped creation stands, a second forbids creations
after it. Rows stream through a task sorted by leaf and position; its state is the leaf's templates,
never its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.schema import POSITION

ANY, SIMILAR, MOST, EXAMPLES = "<*>", 0.5, 200, 3
# Words that vary from message to message.
VARIABLE = r"\A(?:-?\d+(?:\.\d+)?|0x[0-9a-fA-F]+|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|/.+)\z"
SCHEMA = "n_tokens int, key string, file string, line_number long, template string, count long, examples array<string>"


class Template:
    def __init__(self, words: list[str], at: tuple) -> None:
        self.words, self.at, self.count, self.examples = list(words), at, 0, []

    def likeness(self, words: list[str]) -> float:
        return sum(a == b or ANY in (a, b) for a, b in zip(self.words, words, strict=True)) / len(words)

    def take(self, words: list[str], message: str) -> None:
        self.words = [a if a == b else ANY for a, b in zip(self.words, words, strict=True)]
        self.count += 1
        if len(self.examples) < EXAMPLES:
            self.examples.append(message)


def place(templates: list[Template], words: list[str], message: str, at: tuple, similar: float, open_: bool) -> None:
    best = max(templates, key=lambda t: t.likeness(words), default=None)
    if best is None or best.likeness(words) < similar:
        if not open_:
            return
        best = Template(words, at)
        templates.append(best)
    best.take(words, message)


def _run(leaves: DataFrame, similar: float, most: int, last: tuple | None) -> DataFrame:
    def rows(leaf: tuple, found: list[Template]) -> pd.DataFrame:
        return pd.DataFrame([(*leaf, *t.at, " ".join(t.words), t.count, t.examples) for t in found], columns=["n_tokens", "key", "file", "line_number", "template", "count", "examples"])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf, found = None, []
        for batch in batches:
            for n, key, file, line, message in batch[["n_tokens", "key", "file", "line_number", "message"]].itertuples(index=False):
                if (n, key) != leaf:
                    if found:
                        yield rows(leaf, found)
                    leaf, found = (n, key), []
                at, words = (file, line), message.split()
                if words:
                    place(found, words, message, at, similar, len(found) < most and (last is None or at <= last))
        if found:
            yield rows(leaf, found)

    return leaves.repartition("n_tokens", "key").sortWithinPartitions("n_tokens", "key", *POSITION).mapInPandas(each, SCHEMA)


def leaves_of(entries: DataFrame) -> DataFrame:
    """Messages with their leaf; a message without words has the key '' and joins no template."""
    trimmed = F.regexp_replace("message", r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    leaf = F.transform(F.array(F.split(trimmed, r"(?U)[\s\x1c-\x1f]+")), lambda w: F.struct(F.size(w).alias("n_tokens"), F.when(w[0].rlike(VARIABLE), ANY).otherwise(w[0]).alias("key")))[0]
    return entries.select(*POSITION, "message", leaf.alias("leaf")).select(*POSITION, "message", "leaf.n_tokens", "leaf.key")


def mine(entries: DataFrame, similar: float = SIMILAR, most: int = MOST) -> DataFrame:
    """template, count, percentage (2 digits), examples, variable_positions; commonest first, then the order of creation."""
    leaves = leaves_of(entries)
    # templates are few: kept, so that messages are read once where the cap does not bite
    first = _run(leaves, similar, most, None).persist()
    opened = first.orderBy(*POSITION).select(*POSITION).limit(most + 1).collect()
    # the cap bites only if more templates are opened than it allows
    found = _run(leaves, similar, most, (opened[most - 1]["file"], opened[most - 1]["line_number"])) if len(opened) > most else first
    total = entries.agg(F.count("*").alias("_total"))
    at = F.expr(f"filter(transform(split(template, ' '), (t, i) -> if(t = '{ANY}', i, -1)), i -> i >= 0)")
    return found.join(F.broadcast(total)).select("template", "count", F.round(100.0 * F.col("count") / F.col("_total"), 2).alias("percentage"), "examples", at.alias("variable_positions"), *POSITION).orderBy(F.desc("count"), *POSITION).drop(*POSITION)


def coverage(entries: DataFrame, mined: DataFrame) -> DataFrame:
    """One row: messages, templates, and the part of the messages that one took."""
    return mined.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("taken"), F.count("*").alias("unique_templates")).join(entries.agg(F.count("*").alias("total_lines"))).select("total_lines", "unique_templates", F.round(F.when(F.col("total_lines") > 0, F.col("taken") / F.col("total_lines")).otherwise(0.0), 4).alias("coverage"))
