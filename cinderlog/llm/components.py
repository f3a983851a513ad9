"""Connected components of a link table, by labels that pass along links and jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.stages import drop, stage


#: Labels are broadcast up to so many nodes, some 16 MB; beyond, joins are shuffled.
MOST_NODES = 500_000


def components(links: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """Staged links (a, b) to a staged table (node, label): the least node of each node's component, for nodes with a link.

    Each round halves the longest chain of labels, at least, so rounds grow with the logarithm of a
    component's diameter; nothing but a count comes to the driver.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a")).where("src <> dst")
    both = stage(both.groupBy("src", "dst").agg(F.lit(0).alias("one")).select("src", "dst"))
    labels = stage(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("label")))
    few = labels.count() <= most
    while True:
        known = F.broadcast(labels) if few else labels
        near = both.join(known.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        met = near.join(known, "node").select("node", "label", F.least("label", "near").alias("less"))
        jump = known.select(F.col("node").alias("less"), F.col("label").alias("far"))
        new = stage(met.join(jump, "less", "left").select("node", F.least("less", F.coalesce("far", "less")).alias("label"), (F.least("less", F.coalesce("far", "less")) < F.col("label")).alias("moved")))
        moved = not new.where("moved").isEmpty()
        drop(labels)
        labels = new
        if not moved:
            drop(both)
            out = labels.select("node", "label")
            out._stage_path = labels._stage_path
            return out
