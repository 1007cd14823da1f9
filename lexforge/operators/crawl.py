"""Closure of a set of files over their links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text
from lexforge.sources.shared import kept


def missing_targets(found: DataFrame, files: DataFrame) -> DataFrame:
    """(target, refs): link targets that are no file, with how many links name each."""
    known = files.select(text.fold(F.col("url")).alias("k_")).distinct()
    named = found.where("target <> ''").groupBy("target").agg(F.count(F.lit(1)).alias("refs"))
    return named.join(known, text.fold(F.col("target")) == F.col("k_"), "left_anti")


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): all that ``seeds`` (node) reach over ``edges`` (src, dst), with the fewest steps.

    A loop of joins, one for each step, as link graphs have cycles; each round's new nodes are checkpointed, so plans stay
    short and nothing is on the driver."""
    new = kept(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = new, 0
    while not new.isEmpty():
        depth += 1
        step = new.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new = kept(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = kept(seen.unionByName(new))
    return seen
