"""Connected components by contraction, with no link or label held on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.store import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b), whose ids must be random (hashes) and of one type.

    Each round lets every node take the least id among itself and its neighbours, and goes on with the links between
    different ids taken. With random ids a constant share of the nodes goes in each round, so the rounds are as the
    logarithm of the nodes. Links of a node to itself make it a component of its own; an empty table gives an empty one.
    A node with very many links is no trouble: least ids are pre-aggregated, and the joins are of plain exchanges that
    the adaptive engine can split.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
    left, right = (least.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    rest = edges.join(left, "a").join(right, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    rest = written(rest)
    if rest.isEmpty():
        return least.withColumnRenamed("label", "component")
    above = components(rest).select(F.col("node").alias("label"), "component")
    return least.join(above, "label", "left").select("node", F.coalesce("component", "label").alias("component"))
