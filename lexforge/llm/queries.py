"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import arc, bpe, langid, minhash, mixing, quality, tokens, toxicity, urls, webp
from lexforge.llm.store import shared_dir, written

#: The id that ends each document in token files.
END_ID = 2


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "text", "source", "n_copies", "copy_no", "mix_key")


def op2_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.measured(written(webp.stored(table(spark, sf_dir, "documents"))))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    tokens.write(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), folder, END_ID)
    return tokens.read(spark, folder)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out()))
    named = langid.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, chain)
    return scored.select("doc_id", *(f"p_{c}" for c in toxicity.CATEGORIES), "is_toxic", (~F.col("is_toxic")).alias("kept"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = urls.host_and_path(F.expr("substring(url, instr(url, '://') + 3)"))
    listed = pages.where(F.col("url").contains("://") & host.rlike(rf"(^|\.)({'|'.join(urls.SPAM_HOSTS)})\."))
    return urls.judged(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op9_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).drop("d2")


def op10_warc_from_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    parts = arc.write(table(spark, sf_dir, "pages"), folder)
    return arc.read(spark, folder, parts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_source_mixing, op2_lossless_webp, op3_bpe_round_trip, op4_token_files, op5_language_id, op6_minhash_near_dedup, op7_toxicity_chain, op8_url_filter, op9_quality_outliers, op10_warc_from_arc)
}

#: Near copies as a graph: exact sets of shingles, pairs that share one, links, and the least id that links reach.
_OP6 = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
), both_ways AS MATERIALIZED (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT DISTINCT x AS doc_id, x AS other FROM both_ways UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.other = b.x
), least_id AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id,
  coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_source_mixing": mixing.ORACLE,
    "op6_minhash_near_dedup": _OP6,
    "op8_url_filter": urls.oracle(),
    "op9_quality_outliers": quality.oracle(),
    "op10_warc_from_arc": arc.ORACLE,
}
