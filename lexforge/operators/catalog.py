"""Catalogues: topics, string and URL dictionaries, section offsets, directory order.

Numbers that the format gives one after the other (topic numbers, offsets) are global running sums. They are computed in two
levels: sums of ranges of rows, which are few, are added up in order, and each range counts on from its own start, so that no
task holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text
from lexforge.sources.shared import kept

NO_TITLE, WITH_TITLE = 2, 6


def running(rows: DataFrame, order: list[str], value: Column, name: str, parts: int = 64) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows before, in the order of the columns ``order``, which must
    tell rows apart."""
    # kept, as ranges are sampled: computed twice they could differ
    dealt = kept(rows.withColumn("v_", value.cast("bigint")).repartitionByRange(parts, *order).withColumn("p_", F.spark_partition_id()))
    inner = F.coalesce(F.sum("v_").over(Window.partitionBy("p_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy("p_").agg(F.sum("v_").alias("s_"))
    before = F.coalesce(F.sum("s_").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("p_", before.alias("b_"))  # at most ``parts`` rows
    return dealt.withColumn("in_", inner).join(F.broadcast(bases), "p_").withColumn(name, F.col("b_") + F.col("in_")).drop("p_", "b_", "in_", "v_")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` numbered from 0."""
    return running(rows, order, F.lit(1), name)


def contents_code(title: Column, url: Column) -> Column:
    return F.when(url.contains("#"), 0).when(title == "", NO_TITLE).otherwise(WITH_TITLE)


def topics(pages: DataFrame, order: list[str]) -> DataFrame:
    """(topic, title, url, in_contents) of pages (title, url and the columns ``order``)."""
    url = F.regexp_replace("url", "^/", "")
    rows = pages.select(*order, "title", url.alias("url"))
    return numbered(rows, order, "topic").select("topic", "title", "url", contents_code(F.col("title"), F.col("url")).alias("in_contents"))


def find_topics(keys: DataFrame, column: str, found: DataFrame) -> DataFrame:
    """``keys`` with topic: the first topic whose URL equals the column's, without a leading slash and case; null if none."""
    fold = lambda c: text.fold(F.regexp_replace(c, "^/", ""))
    first = found.groupBy(fold(F.col("url")).alias("k_")).agg(F.min("topic").alias("topic"))
    return keys.join(first, fold(F.col(column)) == F.col("k_"), "left").drop("k_")


def distinct_strings(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(str, first): different non-empty strings, with the place of the first."""
    place = F.struct(*order)
    return rows.where(F.col(column) != "").groupBy(F.col(column).alias("str")).agg(F.min(place).alias("first"))


def string_offsets(strings: DataFrame) -> DataFrame:
    """(str, offset): byte offsets of strings in the order of ``first``; a string of less than a block of 4096 bytes does not
    cross a block's end.

    Where a block ends depends on all strings before, so this is a fold over (length) in order: one task, which holds a
    few bytes for each different string."""
    import pandas as pd

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", ignore_index=True)
        at, out = 1, []
        for size in rows["size"]:
            end = (at & ~0xFFF) + 0x1000
            if at + size + 1 > end and size + 1 <= 0x1000:
                at = end
            out.append(at)
            at += size + 1
        return pd.DataFrame({"n": rows.n, "offset": out})

    sized = numbered(strings, ["first"], "n").select("n", "str", F.octet_length("str").alias("size"))
    placed = sized.select("n", "size", F.lit("all").alias("one")).groupBy("one").applyInPandas(place, "n bigint, offset bigint")
    return sized.join(placed, "n").select("str", "offset")


def url_table_offset(topic: Column) -> Column:
    """Offset of the 12-byte row of a topic, with 4 bytes of padding after every 341 rows."""
    return 12 * topic + 4 * F.floor(topic / 341)


def byte_counts(rows: DataFrame, column: str) -> DataFrame:
    """(byte, n): how often each byte value, in hexadecimal, occurs in a text column's UTF-8; null counts as empty. Each batch is
    counted on its own, so that 256 numbers of it travel and no byte does."""
    import numpy as np
    import pyarrow as pa

    def count(batches):
        for batch in batches:
            data = batch.column(0).cast(pa.large_binary()).drop_null()
            offsets = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, 8 * data.offset) if len(data) else [0, 0]
            raw = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
            n = np.bincount(raw, minlength=256)
            yield pa.RecordBatch.from_arrays([pa.array([f"{b:02X}" for b in range(256)]), pa.array(n)], ["byte", "n"])

    each = rows.select(F.col(column).cast("binary").alias("data")).mapInArrow(count, "byte string, n bigint")
    return each.groupBy("byte").agg(F.sum("n").alias("n")).where("n > 0")


def directory(entries: DataFrame) -> DataFrame:
    """``entries`` (name and more) in directory order (case folded, then as written), with rank from 0."""
    return numbered(entries.withColumn("fold_", text.fold(F.col("name"))), ["fold_", "name"], "rank").drop("fold_")
