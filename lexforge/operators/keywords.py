"""Keyword indexes, trees of keywords and contents, context ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text
from lexforge.operators.catalog import running
from lexforge.sources.shared import kept


def flat_keywords(uses: DataFrame) -> DataFrame:
    """(sort_key, display, topics) of ``uses`` (seq, keyword, topic): one for each keyword without case, spelt as first
    met, with its different topics in the order met."""
    key = text.fold(F.col("keyword")).alias("sort_key")
    firsts = uses.groupBy(key, "topic").agg(F.min(F.struct("seq", "keyword")).alias("x"))
    display = F.min("x")["keyword"].alias("display")
    topics = F.transform(F.array_sort(F.collect_list(F.struct("x.seq", "topic"))), lambda t: t["topic"]).alias("topics")
    return firsts.groupBy("sort_key").agg(display, topics)


def tree(nodes: DataFrame) -> DataFrame:
    """(node, path, depth, char_index, sort_key) of ``nodes`` (node, parent, name): names joined from the root by a comma and
    a space; char_index is the bytes of the parent's path and 2, 0 at the root. One join for each level, however many there are;
    each level is checkpointed, so none is computed twice. Nodes that no root reaches are left out."""
    level = kept(nodes.where("parent is null").select("node", F.col("name").alias("path"), F.lit(0).alias("depth"), F.lit(0).alias("char_index")))
    out, depth = level, 0
    children = nodes.where("parent is not null").select("node", "parent", "name")
    while True:
        depth += 1
        above = level.select(F.col("node").alias("parent"), F.col("path").alias("above"))
        level = kept(children.join(above, "parent").select("node", F.concat_ws(", ", "above", "name").alias("path"), F.lit(depth).alias("depth"), (F.octet_length("above") + 2).alias("char_index")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.withColumn("sort_key", text.fold(F.col("path")))


def layout(nodes: DataFrame) -> DataFrame:
    """Offsets and pointers of a contents tree in level order, from ``nodes`` (node, parent, depth, ordinal: an array that
    orders a level). (node, offset, parent_offset, next_offset, child_offset, seq): a node takes 20 bytes, 28 with children,
    from 4096 on; no pointer is 0; seq counts nodes with a page up to and with this one."""
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("kids"))
    rows = nodes.join(kids, F.col("node") == F.col("of"), "left").withColumn("size", F.when(F.col("kids") > 0, 28).otherwise(20)).drop("of")
    rows = running(rows, ["depth", "ordinal"], F.col("size"), "before").withColumn("offset", 4096 + F.col("before"))
    rows = running(rows, ["depth", "ordinal"], F.col("has_page").cast("int"), "pages_before").withColumn("seq", F.col("pages_before") + F.col("has_page").cast("int"))
    later = F.lead("node").over(Window.partitionBy("depth", "parent").orderBy("ordinal"))
    rows = rows.withColumn("next_offset", F.when(later.isNotNull(), F.col("offset") + F.col("size")).otherwise(0))
    parents = rows.select(F.col("node").alias("p"), F.col("offset").alias("parent_offset"))
    first = rows.where("parent is not null").groupBy(F.col("parent").alias("c")).agg(F.min("offset").alias("child_offset"))
    rows = rows.join(parents, F.col("parent") == F.col("p"), "left").join(first, F.col("node") == F.col("c"), "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("node", "offset", none("parent_offset"), "next_offset", none("child_offset"), "seq")


def context_ids(defines: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, file) of ``defines`` (seq, name, id) and ``aliases`` (seq, name, file): the first alias of a name, with its
    case, the last define of an id that has one."""
    first = aliases.groupBy("name").agg(F.min(F.struct("seq", "file")).alias("x")).select("name", F.col("x.file").alias("file"))
    return defines.join(first, "name").groupBy("id").agg(F.max_by("file", "seq").alias("file"))


def unknown_names(defines: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name) of defines without an alias, which are left out of the map."""
    return defines.join(aliases, "name", "left_anti").select("name").distinct()
