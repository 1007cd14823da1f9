"""Mixing sources to target weights by Poisson replication. DataFrame and SQL functions only.

Each source gets the mean number of repetitions at which its share of all characters becomes its target weight, while the
corpus keeps its size. A document's number of copies is the Poisson distribution of that mean inverted at a uniform
number that a seeded hash of its doc_id gives: the first k whose cumulative probability reaches it. Rows are exploded by
their copies and put in the order of a hash of seed, doc_id and copy.

A null source is a source of its own. A source without any character keeps its rows (rate 1). Null doc_ids are one id to
the hash. Rows that repeat a doc_id get the same number of copies each. An empty table gives an empty one. Further columns
are carried along; columns named n_copies, copy_no or mix_key are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.store import bounded, written

SEED = 20_24
#: The default target weight of a source is its characters to this power: below 1 it lifts small sources.
POWER = 0.7


def _number(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts, as a number."""
    text = F.concat_ws("|", F.lit(str(SEED)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(source_, rate, cdf): the mean repetitions of each source, and its cumulative Poisson probabilities from 0 on, as
    far as they are below 1 for doubles. weights: target weight by source, 0 for sources not named."""
    sizes = docs.groupBy(F.col("source").alias("source_")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(POWER))).otherwise(0.0))
    else:
        sizes = sizes.withColumn("weight", F.coalesce(*(F.when(F.col("source_") == k, F.lit(float(v))) for k, v in weights.items()), F.lit(0.0)))
    sizes = written(sizes)
    total = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()  # two numbers
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.lit(total["size"]) * F.col("weight") / F.lit(total["weight"] or 1.0) / F.col("size"))
    steps = F.sequence(F.lit(1), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int"))
    log_p = lambda s, k: s["log_p"] + F.log(F.col("rate") / k)
    start = F.struct((-F.col("rate")).alias("log_p"), F.array(F.exp(-F.col("rate"))).alias("cdf"))
    fold = F.aggregate(steps, start, lambda s, k: F.struct(log_p(s, k).alias("log_p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + F.exp(log_p(s, k)))).alias("cdf")))
    table = sizes.select("source_", rate.alias("rate"))
    return written(table.select("source_", "rate", F.when(F.col("rate") > 0, fold["cdf"]).otherwise(F.array(F.lit(1.0))).alias("cdf")))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The copies of the rows of ``docs`` (doc_id, text, source and more) in mixed order, with n_copies (of the row),
    copy_no (from 1) and mix_key, by which they are ordered."""
    docs = docs.drop("n_copies", "copy_no", "mix_key")
    table = bounded(rates(docs, weights))
    u = (_number(F.col("doc_id")) + 0.5) / float(1 << 52)
    joined = docs.join(table, docs["source"].eqNullSafe(table["source_"])).withColumn("u_", u)
    counted = joined.withColumn("n_copies", F.size(F.filter("cdf", lambda c: c < F.col("u_")))).drop("source_", "rate", "cdf", "u_")
    copies = counted.where("n_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    return copies.withColumn("mix_key", _number(F.col("doc_id"), F.col("copy_no"))).orderBy("mix_key", "doc_id", "copy_no")


#: The rows of mixed() over documents with default weights.
ORACLE = f"""
WITH sizes AS (
  SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source
), weighed AS (
  SELECT source, size, CASE WHEN size > 0 THEN pow(size, {POWER}) ELSE 0 END AS weight FROM sizes
), rated AS (
  SELECT source, CASE WHEN size = 0 THEN 1.0
    ELSE sum(size) OVER () * weight / sum(weight) OVER () / size END AS rate FROM weighed
), terms AS (
  SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
  FROM rated, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 31) AS BIGINT))) AS k)
), cdf AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms
), drawn AS (
  SELECT *, (CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5)
    / 4503599627370496.0 AS u FROM documents
), counted AS (
  SELECT d.doc_id, any_value(d.text) AS text, d.source, CAST(count(*) FILTER (c.c < d.u) AS INTEGER) AS n_copies
  FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source GROUP BY d.doc_id, d.source
)
SELECT doc_id, text, source, n_copies, CAST(copy_no AS INTEGER) AS copy_no,
  CAST('0x' || substr(md5('{SEED}|' || CAST(doc_id AS VARCHAR) || '|' || CAST(copy_no AS VARCHAR)), 1, 13) AS BIGINT) AS mix_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM counted)
"""
