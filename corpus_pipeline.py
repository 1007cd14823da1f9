"""A training corpus from raw documents: STAGES in order, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one with the ids of each text in
place of the text. What a stage returns is written as Parquet and read again as the next one's docs.

Null and empty texts are not toxic, have no language and go in the second stage. Null doc_ids are kept; they belong to
no label. Null languages and sources are values of their own: no training text, and a source to mix. Of rows that repeat
a doc_id and text one stays after near-dedup; of equally good documents of a group the one with the least doc_id. An
empty table gives an empty one. Columns other than those of documents are left out at the start, whatever their names.
Long texts go through whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import bpe, langall, langid, minhash, mixing, toxicity  # noqa: F401 (tests take langid from here)
from lexforge.llm.queries import table, tokenizer
from lexforge.llm.store import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).where("not is_toxic").select(COLUMNS)


def unknown_language_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language known (less familiar than the cut of the language they are like), go."""
    return langall.known(docs).select(COLUMNS)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more) stays."""
    return minhash.deduplicated(docs, threshold=80).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, by the rate of their source, and put in mixed order."""
    return mixing.mixed(docs).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as BPE ids, with a digest of the text that they decode to."""
    return bpe.round_trip(docs.select(COLUMNS), tokenizer("word_bpe_49k.json")).select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("toxicity", toxic_out),
    ("language ID", unknown_language_out),
    ("MinHash near-dedup", near_copies_out),
    ("source mixing", mixed),
    ("BPE encoding and decoding", encoded),
]

#: SQL expresses neither the classifiers nor the encoder; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
