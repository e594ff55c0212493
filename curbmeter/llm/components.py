"""Connected components by contraction, all of it in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbmeter.llm.shared import store


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; a component is named by its smallest node.

    Each round maps every node to the smallest of its neighbours and itself,
    follows that map once more, and replaces the links' ends by where they
    lead. Links inside one node vanish, so rounds go on until none is left.
    The number of rounds grows with the logarithm of a component's diameter;
    a node with very many links is folded by map-side minima.
    """
    left = store(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    names = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).union(left.select("b", "a"))
        step = store(both.groupBy("node").agg(F.least("node", F.min("to")).alias("to")), "step")
        ahead = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        step = store(step.join(ahead, "to").select("node", F.col("further").alias("to")), "step")
        if names is None:
            names = step.withColumnRenamed("to", "component")
        else:
            moved = step.select(F.col("node").alias("component"), "to")
            names = names.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        names = store(names, "names")
        ends = left
        for end in ("a", "b"):
            moved = step.select(F.col("node").alias(end), "to")
            ends = ends.join(moved, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        left = store(
            ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
        )
    if names is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return names
