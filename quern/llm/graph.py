"""Connected components by contraction: every round hooks nodes to smaller neighbours and shrinks the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import scratch


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b) that isn't the smallest of its component.

    ``label`` is the smallest node reachable. Nodes absent from the result label themselves. Each round
    at least halves the nodes with edges, so rounds grow with the logarithm of the graph. Minima are
    combined before the shuffle, and joins are plain equi-joins that adaptive execution can split, so
    a node with very many edges loads no single task.
    """
    left = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    left = scratch.table(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    labels = scratch.table(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), name)
    while not left.isEmpty():
        hook = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        for _ in range(2):
            further = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
            hook = hook.join(further, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        hook, old, edge = scratch.table(hook, name), labels, left
        labels = labels.join(hook.withColumnRenamed("node", "label"), "label", "left")
        labels = scratch.table(labels.select("node", F.coalesce("to", "label").alias("label")), name)
        for end in ("a", "b"):
            left = left.join(hook.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        left = left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left = scratch.table(left, name)
        scratch.drop(hook, old, edge)
    scratch.drop(left)
    return labels.where("node <> label")
