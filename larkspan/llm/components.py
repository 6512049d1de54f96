"""Connected components by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from larkspan.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the least node of its component.

    A step gives each node the least label among itself and its neighbours. From
    the fifth step on it then takes that label's own label as well, so that long
    chains halve. All steps are joins and minima, which fold before the shuffle;
    a node with very many edges is one row on its side of the join, and the
    other side can be split.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.store(both.where("a != b").distinct(), "edges")
    labels = scratch.store(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    step = 0
    while True:
        step += 1
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("was"))
        new = near.union(labels.select("node", "label", F.col("label").alias("was"))).groupBy("node").agg(F.min("label").alias("label"), F.min("was").alias("was"))
        if step > 4:
            above = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
            new = new.join(above, "label").select("node", F.least("label", "next").alias("label"), "was")
        seen = Observation()
        later = scratch.store(new.observe(seen, F.count_if(F.col("label") != F.col("was")).alias("moved")).select("node", "label"), "labels")
        scratch.drop(labels)
        labels = later
        if not seen.get["moved"]:
            scratch.drop(edges)
            return labels
