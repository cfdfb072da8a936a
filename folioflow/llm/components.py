"""Connected components of an edge table, without driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm._spark import discard, durable


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node.

    Each round gives a node the smallest label among itself and its neighbours, then lets
    labels point at labels (pointer jumping), so paths shrink by half or more per round.
    The state of a round is written to the checkpoint folder; only a flag reaches the driver.
    Empty edge tables give an empty result.
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    written = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        target = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = durable(hooked.join(target, "component").select("node", "old", F.least("component", "next").alias("component")))
        discard(written)
        labels, written = jumped.select("node", "component"), jumped
        if jumped.filter(F.col("old") != F.col("component")).isEmpty():
            discard(both)
            return labels


def extended(known: DataFrame, edges: DataFrame) -> DataFrame:
    """``components`` of the edges behind ``known`` and of further ``edges(a, b)``.

    Only the components of ``known`` that the new edges touch go through rounds again, each
    as one node, which is its smallest.
    """
    if edges.isEmpty():
        return known
    at = {end: known.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")) for end in ("a", "b")}
    ends = edges.join(at["a"], "a", "left").join(at["b"], "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    between = components(ends)
    grown = known.join(between.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return durable(grown.unionByName(between.join(known.select("node"), "node", "left_anti").select("node", "component")))
