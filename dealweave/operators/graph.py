"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.session import cut_lineage, release


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """One row (node, component) per distinct node; the component is its smallest node.

    Min-label propagation with pointer jumping: each round takes the smallest
    label among a node's neighbours and then the label of that label, so the
    rounds grow with the logarithm of the longest path.  Labels are
    checkpointed each round and never leave the executors; only the count of
    changed labels does.  Null nodes and edges with a null end are ignored,
    nodes without edges are their own component.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null and a <> b")
    both = cut_lineage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = nodes.select(F.col(node).alias("n")).filter("n is not null").distinct().withColumn("l", F.col("n"))
    linked = both.select(F.col("a").alias("n")).distinct()
    labels = table = cut_lineage(labels.join(linked, "n", "left_semi"))
    while True:
        near = both.join(labels, both["b"] == labels["n"]).groupBy("a").agg(F.min("l").alias("m"))
        step = (
            labels.join(near, labels["n"] == near["a"], "left")
            .select("n", F.col("l").alias("old"), F.least("l", F.coalesce("m", "l")).alias("l"))
        )
        jump = labels.select(F.col("n").alias("jn"), F.col("l").alias("jl"))
        step = cut_lineage(
            step.join(jump, step["l"] == jump["jn"], "left").select("n", "old", F.least("l", F.coalesce("jl", "l")).alias("l"))
        )
        release(table)
        labels, table = step.select("n", "l"), step
        if step.filter("old <> l").isEmpty():
            break
    release(both)
    every = nodes.select(F.col(node).alias("n")).filter("n is not null").distinct()
    return every.join(labels, "n", "left").select(F.col("n").alias(node), F.coalesce("l", "n").alias("component"))
