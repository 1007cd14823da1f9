"""Positional full-text index: postings, statistics, code sizes, and searches over postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text
from lexforge.sources.shared import kept

ROOT_DOC, ROOT_COUNT, ROOT_PLACE = 2, 1, 5
NODE = 4096


def postings(words: DataFrame, key: str) -> DataFrame:
    """(word, ctx, key, positions): ascending places of each word of each page. The words of a page are together already,
    so this needs no exchange."""
    return words.groupBy(key, "word", "ctx").agg(F.array_sort(F.collect_list("pos")).alias("positions")).select("word", "ctx", key, "positions")


def statistics(words: DataFrame, key: str) -> DataFrame:
    """One row: pages with words, words, their characters, the longest, different (word, ctx), and their characters."""
    totals = words.groupBy("word", "ctx").agg(F.count(F.lit(1)).alias("n"))
    sums = totals.agg(F.sum("n").alias("total_words"), F.sum(F.col("n") * F.length("word")).alias("total_length"), F.max(F.length("word")).alias("longest"), F.count(F.lit(1)).alias("unique_words"), F.sum(F.length("word")).cast("bigint").alias("unique_length"))
    both = sums.unionByName(words.agg(F.count_distinct(key).alias("pages")), allowMissingColumns=True)  # two rows
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def deltas(found: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """Postings with the step from the word's previous page, and the steps between places.

    A common word is on every page, so rows are dealt by ranges of (word, ctx, page), not by word: within a range the page
    before is the row before, and for the words that span ranges, fewer than there are ranges, the last page of each range
    is handed on."""
    word = ["word", "ctx"]
    dealt = kept(found.repartitionByRange(parts, *word, key).withColumn("p_", F.spark_partition_id()))
    lasts = dealt.groupBy("p_", *word).agg(F.max(key).alias("last_"))
    several = lasts.groupBy(*word).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").drop("n_")
    before = F.lag("last_").over(Window.partitionBy(*word).orderBy("p_"))
    handed = lasts.join(F.broadcast(several), word).select("p_", *word, before.alias("handed_"))
    rows = dealt.withColumn("before_", F.lag(key).over(Window.partitionBy("p_", *word).orderBy(key))).join(F.broadcast(handed), ["p_", *word], "left")
    steps = F.zip_with("positions", F.concat(F.array(F.lit(0)), F.slice("positions", F.lit(1), F.size("positions") - 1)), lambda a, b: a - b)
    delta = F.col(key) - F.coalesce("before_", "handed_", F.lit(0))
    return rows.withColumn("doc_delta", delta).withColumn("steps", steps).select("word", "ctx", key, "positions", "doc_delta", "steps")


def code_sizes(stepped: DataFrame, key: str) -> DataFrame:
    """(word, ctx, key, bits, bytes): each page's entry in scale/root code, padded to whole bytes."""
    places = F.aggregate("steps", F.lit(0), lambda acc, s: acc + text.code_bits(s, ROOT_PLACE))
    bits = text.code_bits(F.col("doc_delta"), ROOT_DOC) + text.code_bits(F.size("positions"), ROOT_COUNT) + places
    return stepped.select("word", "ctx", key, bits.alias("bits"), F.ceil(bits / 8).cast("int").alias("bytes"))


def word_entries(sizes: DataFrame) -> DataFrame:
    """(word, ctx, docs, data_bytes) of each index entry."""
    return sizes.groupBy("word", "ctx").agg(F.count(F.lit(1)).alias("docs"), F.sum("bytes").alias("data_bytes"))


def prefix_lengths(entries: DataFrame) -> DataFrame:
    """Entries with prefix: characters shared with the word before in (word, ctx) order within the same first letter or
    digit (words of different first characters share none, so the windows can be apart)."""
    order = Window.partitionBy(F.substring("word", 1, 1)).orderBy("word", "ctx")
    before = F.coalesce(F.lag("word").over(order), F.lit(""))
    rows = entries.withColumn("before", before)
    shared = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("word"), F.length("before")))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substring(F.col("word"), i, 1) == F.substring(F.col("before"), i, 1)) & (F.length("before") >= i), i).otherwise(acc))
    return rows.withColumn("prefix", shared).drop("before")


def leaves(entries: DataFrame, groups: int = 64) -> DataFrame:
    """Entries with leaf: the index node that each falls in. Nodes are filled in word order, and prefixes start anew with
    each, so where one ends depends on all before; each of at most 37 first characters is packed on its own."""
    import pandas as pd

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["word", "ctx"], ignore_index=True)
        leaf, used, last, out, shared = 0, 0, "", [], []
        varint = lambda v: max(1, -(-int(v).bit_length() // 7))

        def common(a: str, b: str) -> int:
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n

        for word, docs, size in zip(rows.word, rows.docs, rows.data_bytes, strict=True):
            entry = lambda p, w=word, d=docs, s=size: 2 + len(w) - p + 1 + varint(d) + 6 + varint(s)
            prefix = common(word, last) if used else 0
            if used and 8 + used + entry(prefix) > NODE:
                leaf, used, prefix = leaf + 1, 0, 0
            used += entry(prefix)
            last = word
            out.append(leaf)
            shared.append(prefix)
        return rows.assign(leaf=out, prefix=shared)

    part = entries.withColumn("part", F.substring("word", 1, 1))
    return part.groupBy("part").applyInPandas(pack, "word string, ctx int, docs bigint, data_bytes bigint, part string, leaf int, prefix int")


def search(found: DataFrame, word: str, key: str, titles_only: bool = False) -> DataFrame:
    """(key, hits) of the pages that have a word."""
    rows = found.where(F.col("word") == word.lower())
    rows = rows.where("ctx = 1") if titles_only else rows
    return rows.groupBy(key).agg(F.sum(F.size("positions")).alias("hits"))


def phrase(found: DataFrame, words: list[str], key: str) -> DataFrame:
    """(key, hits) of the pages where the words stand one after the other."""
    parts = None
    for i, w in enumerate(words):
        rows = found.where(F.col("word") == w.lower()).select(key, F.explode("positions").alias("p")).select(key, (F.col("p") - i).alias("p"))
        parts = rows if parts is None else parts.join(rows, [key, "p"])
    return parts.groupBy(key).agg(F.count(F.lit(1)).alias("hits"))
