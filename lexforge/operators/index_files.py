"""Index files of archives: postings and keywords of each archive as bytes, and back.

Codes of words are made in all tasks; what depends on all that comes before, the layout of one file, is one task for each archive.
A file is less than 4 GiB by its format, which bounds that task. Collections beyond that are several archives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import index_bytes


def word_data(found: DataFrame, key: str) -> DataFrame:
    """(archive, word, ctx, pages, data) of postings (archive, word, ctx, key, positions)."""
    rows = found.groupBy("archive", "word", "ctx").agg(F.array_sort(F.collect_list(F.struct(F.col(key).cast("bigint").alias("page"), "positions"))).alias("each"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [[(x["page"], x["positions"]) for x in row.as_py()] for row in batch.column("each")]
            data = pa.array([index_bytes.page_codes(x) for x in each], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in each], pa.int64()), data], ["archive", "word", "ctx", "pages", "data"])

    return rows.mapInArrow(run, "archive string, word string, ctx int, pages bigint, data binary")


def fts_files(found: DataFrame, key: str, codepage: int = 1252, lcid: int = 0x409) -> DataFrame:
    """(archive, data): the full-text index of each archive, from postings (archive, word, ctx, key, positions). key numbers
    pages from 0; an archive without words has none."""
    size = F.size("positions")
    totals = found.groupBy("archive").agg(F.count_distinct(key).alias("all_pages"), F.sum(size).alias("total"), F.sum(size * F.length("word")).alias("total_length"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first, rows = rows.iloc[0], rows.sort_values(["word", "ctx"])
        words = zip(rows.word, rows.ctx, rows["pages"], rows["data"], strict=True)
        data = index_bytes.write_fts(((w, int(c), int(n), d) for w, c, n, d in words), int(first.all_pages), int(first.total), int(first.total_length), codepage, lcid)
        return pd.DataFrame({"archive": [first.archive], "data": [data]})

    return word_data(found, key).join(totals, "archive").groupBy("archive").applyInPandas(run, "archive string, data binary")


def fts_entries(files: DataFrame) -> DataFrame:
    """(archive, word, ctx, page, positions) read from full-text indexes (archive, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column("archive").to_pylist(), batch.column("data"), strict=True):
                rows = []
                for word, context, count, coded in index_bytes.read_fts(data.as_py()):
                    rows += [(archive, word, context, page, places) for page, places in index_bytes.read_pages(coded, count)]
                    if len(rows) >= 10_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return files.select("archive", "data").mapInArrow(run, "archive string, word string, ctx int, page bigint, positions array<int>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["archive", "word", "ctx", "page", "positions"])


def all_keywords(listed: DataFrame, marked: DataFrame) -> DataFrame:
    """Keywords of index files (archive, sort_key, display, see_also, depth, char_index, topics, ordinal) and those marked on
    pages (archive, sort_key, display, topics), one row each: equal ones stay apart, the listed first, by ordinal."""
    own = marked.select("archive", "sort_key", "display", F.lit(None).cast("string").alias("see_also"), F.lit(0).alias("depth"), F.lit(0).alias("char_index"), "topics", F.lit(0).alias("ordinal"), F.lit(1).alias("origin"))
    return listed.withColumn("origin", F.lit(0)).unionByName(own)


def keyword_files(keywords: DataFrame, codepage: int = 1252, lcid: int = 0x409) -> DataFrame:
    """(archive, name, data): the files BTree, Data, Map and Property of each archive's keywords (as ``all_keywords`` gives
    them), in the order of sort_key."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(bytes_=rows.sort_key.str.encode("utf-8")).sort_values(["bytes_", "origin", "ordinal"], kind="stable")
        each = zip(rows.display, rows.see_also, rows.depth, rows.char_index, rows.topics, strict=True)
        files = index_bytes.write_keywords([(d, s or None, int(n), int(c), [int(t) for t in ts]) for d, s, n, c, ts in each], codepage, lcid)
        return pd.DataFrame({"archive": rows.archive.iloc[0], "name": list(files), "data": list(files.values())})

    return keywords.groupBy("archive").applyInPandas(run, "archive string, name string, data binary")


def keyword_entries(files: DataFrame) -> DataFrame:
    """(archive, number, display, see_also, depth, char_index, topics) of the trees among ``files``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["display", "see_also", "depth", "char_index", "topics", "number"]
        for frame in frames:
            for archive, data in zip(frame.archive, frame["data"], strict=True):
                rows = pd.DataFrame(list(index_bytes.read_keywords(data)), columns=names)
                yield rows.assign(archive=archive)[["archive", "number", *names[:5]]]

    trees = files.where("name = 'BTree'").select("archive", "data")
    return trees.mapInPandas(run, "archive string, number bigint, display string, see_also string, depth int, char_index bigint, topics array<bigint>")


def host(url: Column) -> Column:
    """The host of a URL, by which pages are parted into archives."""
    return F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1)
