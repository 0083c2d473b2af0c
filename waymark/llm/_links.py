"""Connected components of links, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waymark.scratch import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, label``: the smallest node reachable, for every node that has a link.

    ``links`` has columns a and b. Each round gives a node the least label among its
    neighbours' and then its label's own label, so that long chains shorten by
    doubling. Rounds are written to the shared folder and the one before is deleted,
    so the plan stays short and a lost executor costs one round at most.
    """
    edges = scratch.keep(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "edges")
    first = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    labels = scratch.keep(first.select("node", F.least("node", "least").alias("label"), F.lit(True).alias("moved")), "labels-0")
    turn = 0
    while labels.filter("moved").limit(1).count():
        heard = edges.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        own = labels.select("node", F.col("label").alias("old"))
        nearer = own.join(heard, "node").select("node", "old", F.least("old", "heard").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = nearer.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label"), "old")
        turn += 1
        labels = scratch.keep(new.select("node", "label", (F.col("label") != F.col("old")).alias("moved")), f"labels-{turn}")
        scratch.drop(f"labels-{turn - 1}")
    return labels.select("node", "label")
