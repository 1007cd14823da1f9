"""Quality rules: robust multivariate outliers. DataFrame and SQL functions only.

Each text gives counts (words, their characters, symbols, repeated lines, words in repeated 3-word windows). Texts with
fewer than 50 words, or with more than half their words in repeated windows, fail the base rule. The others are judged by
a vector of four transformed statistics in thousandths (whole numbers, so that sums are exact and in any order the same):
ln(1 + words), ln(1 + characters a word), ln(1 + symbols per 1000 words), ln(1 + repeated words per 1000).

For each language and source, location and scatter are minimum-covariance-determinant estimates: from two starts (all
rows; the rows within one deviation of the mean in every statistic) STEPS concentration steps each take the covariance of
the three quarters of rows that lie nearest; the start that ends with the smaller determinant is taken, its covariance made
consistent for the normal distribution. Texts whose squared Mahalanobis distance is beyond the chi-square quantile of
1 - TAIL are rejected. RIDGE is added to the variances, so that statistics that hardly vary don't make a covariance
singular. Which rows are nearest is decided by classes of distance (64 for each power of e), all of a class or none, so
that counts decide and nothing is sorted. Groups of fewer than MIN_GROUP rows are estimated together.

A null or empty text has no words and fails the base rule. Null languages or sources are groups of their own. Repeated
rows count, and get a row, each. An empty table gives an empty result. Columns not named are neither read nor returned.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.store import bounded, written

STEPS, SHRINK, SHARE, TAIL = 3, 50, 0.75, 1e-6
#: Least variances of the four statistics, in thousandths squared.
RIDGE = (250_000.0, 10_000.0, 640_000.0, 2_250_000.0)
P = len(RIDGE)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _chi4(x: float) -> float:
    """Chi-square distribution of four degrees of freedom."""
    return 1 - math.exp(-x / 2) * (1 + x / 2)


def _quantile4(p: float) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi4(mid) < p else (low, mid)
    return low


def _consistency() -> float:
    y = _quantile4(SHARE) / 2
    return SHARE / (1 - math.exp(-y) * (1 + y + y * y / 2))  # over the distribution of six degrees


#: Squared distances, before the covariance is made consistent, up to which texts are kept.
CUT = _quantile4(1 - TAIL) * _consistency()


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of each text.

    Repeated windows: a 64-bit hash of three words is put before the place of the window in one number, the numbers are
    sorted, and neighbours with one hash and the same words are repeats."""
    rows = docs.selectExpr("doc_id", "lang", "source", "coalesce(text, '') as t_")
    rows = rows.selectExpr("doc_id", "lang", "source", "regexp_count(t_, '[#*$%&|<>]') as n_symbols", r"filter(split(t_, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]') as l_", r"filter(split(t_, '[\\x20\\x09-\\x0D]+'), x -> x <> '') as w_")
    rows = rows.selectExpr("*", "size(w_) as n_", "length(array_join(w_, '')) as word_chars", "size(l_) - size(array_distinct(l_)) as n_dup_lines", "transform(w_, x -> xxhash64(x)) as h_").drop("l_")
    rows = rows.withColumn("b_", F.expr("length(bin(n_))"))
    rows = rows.withColumn("s_", F.expr("if(n_ < 4, array(), sort_array(transform(sequence(0, n_ - 3), i -> shiftleft(xxhash64(h_[i], h_[i + 1], h_[i + 2]), b_) | cast(i as bigint))))")).withColumn("m_", F.expr("shiftleft(1L, b_) - 1L"))
    rows = rows.withColumn("r_", F.expr("if(size(s_) < 2, array(), filter(sequence(0, size(s_) - 2), j -> shiftrightunsigned(s_[j], b_) = shiftrightunsigned(s_[j + 1], b_) and w_[cast(s_[j] & m_ as int) + 0] = w_[cast(s_[j + 1] & m_ as int) + 0] and w_[cast(s_[j] & m_ as int) + 1] = w_[cast(s_[j + 1] & m_ as int) + 1] and w_[cast(s_[j] & m_ as int) + 2] = w_[cast(s_[j + 1] & m_ as int) + 2]))"))
    covered = "size(array_distinct(flatten(transform(flatten(transform(r_, j -> array(s_[j] & m_, s_[j + 1] & m_))), k -> array(k, k + 1, k + 2)))))"
    rows = rows.selectExpr("doc_id", "lang", "source", *(f"cast({x} as bigint) as {y}" for x, y in (("n_", "n_words"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("n_dup_lines", "n_dup_lines"), (f"if(size(r_) = 0, 0, {covered})", "n_repeat_words"))))
    return rows.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


# SQL that Spark and DuckDB both take.
VECTOR = [
    "cast(round(1000 * ln(1 + n_words)) as bigint)",
    "cast(round(1000 * ln(1 + word_chars / cast(n_words as double))) as bigint)",
    "cast(round(1000 * ln(1 + 1000 * n_symbols / cast(n_words as double))) as bigint)",
    "cast(round(1000 * ln(1 + 1000 * n_repeat_words / cast(n_words as double))) as bigint)",
]
#: Exact sums of statistics and of their products.
SUMS = ["count(*) as n", *(f"cast(sum(cast(f{i} as decimal(38, 0))) as double) as s{i}" for i in range(P)), *(f"cast(sum(cast(f{i} * f{j} as decimal(38, 0))) as double) as q{i}{j}" for i, j in PAIRS)]


MOMENTS = [*(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in PAIRS)]
#: Sums over all groups, and the sums of a group with SHRINK rows of these more.
POOL = ["sum(n) as pn", *(f"sum({m}) as p{m}" for m in MOMENTS)]
SHRUNK = [f"n + {SHRINK} as n", *(f"{m} + {SHRINK} * (p{m} / pn) as {m}" for m in MOMENTS)]


def _covariance(i: int, j: int) -> str:
    return f"(q{i}{j} / n - (s{i} / n) * (s{j} / n)" + (f" + {RIDGE[i]})" if i == j else ")")


def estimate() -> list[tuple[str, str]]:
    """Steps of (name, expression) from sums to means m, the Cholesky factor c of the covariance and its determinant."""
    out = [(f"m{i}", f"s{i} / n") for i in range(P)]
    for i in range(P):
        for j in range(i + 1):
            rest = "".join(f" - c{i}{k} * c{j}{k}" for k in range(j))
            value = f"{_covariance(j, i)}{rest}"
            out.append((f"c{i}{j}", f"sqrt(greatest({value}, 1.0))" if i == j else f"({value}) / c{j}{j}"))
    return [*out, ("det", " * ".join(f"c{i}{i}" for i in range(P)))]


def distance() -> list[tuple[str, str]]:
    """Steps from a row with its group's estimate to the squared distance d2."""
    out = []
    for i in range(P):
        rest = "".join(f" - c{i}{k} * z{k}" for k in range(i))
        out.append((f"z{i}", f"(f{i} - m{i}{rest}) / c{i}{i}"))
    return [*out, ("d2", " + ".join(f"z{i} * z{i}" for i in range(P)))]


CLASS = "cast(floor(64 * ln(1 + d2)) as bigint)"
FACTORS = [*(f"m{i}" for i in range(P)), *(f"c{i}{j}" for i in range(P) for j in range(i + 1))]
BOX = " and ".join(f"abs(f{i} - m{i}) <= sqrt({_covariance(i, i)})" for i in range(P))


def _chain(rows: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    for name, value in steps:
        rows = rows.withColumn(name, F.expr(value))
    return rows


def _grouped(rows: DataFrame) -> DataFrame:
    """The estimates of each group and start, from the chosen rows."""
    sums = written(rows.groupBy("g", "start").agg(*(F.expr(x) for x in SUMS)))
    pool = sums.groupBy("start").agg(*(F.expr(x) for x in POOL))  # a row for each of two starts
    return written(_chain(sums.join(F.broadcast(pool), "start").selectExpr("g", "start", *SHRUNK), estimate()))


def estimates(vectors: DataFrame) -> DataFrame:
    """(g, m.., c.., det): the estimates of each group g of ``vectors`` (g, f0..)."""
    first = _grouped(vectors.withColumn("start", F.lit(0)))
    inside = vectors.join(bounded(first.drop("start")), "g").where(BOX).select(*vectors.columns, F.lit(1).alias("start"))
    now = written(first.unionByName(_grouped(inside)))
    for _ in range(STEPS):
        near = _chain(vectors.join(bounded(now.select("g", "start", *FACTORS)), "g"), distance()).withColumn("class", F.expr(CLASS)).select("g", "start", "class", *(f"f{i}" for i in range(P)))
        counts = written(near.groupBy("g", "start", "class").agg(F.count(F.lit(1)).alias("rows")))
        sums = counts.selectExpr("g", "start", "class", "sum(rows) over (partition by g, start order by class) as up_to", "sum(rows) over (partition by g, start) as whole")
        limit = written(sums.where(f"up_to >= {SHARE} * whole").groupBy("g", "start").agg(F.min("class").alias("last")))
        now = _grouped(near.join(bounded(limit), ["g", "start"]).where("class <= last"))
    return now.groupBy("g").agg(F.min(F.struct("det", "start", *FACTORS)).alias("x")).select("g", "x.*")


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2) for each row of
    ``docs`` (doc_id, text, lang, source); d2 is null for texts that fail the base rule."""
    rows = written(statistics(docs))
    passed = rows.where("not base_failed")
    group = "concat_ws('|', length(coalesce(lang, '')), coalesce(lang, ''), coalesce(source, ''), lang is null, source is null) as g"
    vectors = written(passed.selectExpr("*", group, *(f"{x} as f{i}" for i, x in enumerate(VECTOR))))
    final = bounded(written(estimates(vectors.select("g", *(f"f{i}" for i in range(P))))))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    scored = _chain(vectors.join(final, "g"), distance()).selectExpr(*names, f"d2 <= {CUT} as kept", "d2")
    failed = rows.where("base_failed").selectExpr(*names, "false as kept", "cast(null as double) as d2")
    return scored.unionByName(failed)


def oracle() -> str:
    """DuckDB SQL of judged() over documents, without d2: the same steps as common table expressions."""

    def steps(name: str, source: str, chain: list[tuple[str, str]]) -> str:
        out, last = "", source
        for k, (column, value) in enumerate(chain):
            out += f", {name}{k} AS MATERIALIZED (SELECT *, {value} AS {column} FROM {last})"
            last = f"{name}{k}"
        return out + f", {name} AS (SELECT * FROM {last})"

    f = ", ".join(f"f{i}" for i in range(P))
    sums = ", ".join(SUMS)
    out = rf"""
WITH base AS (
  SELECT doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(text, '') AS t,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, row_number() OVER () AS r
  FROM documents
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
  FROM base, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)
), repeats AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS c FROM repeats, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), counted AS (
  SELECT b.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words
  FROM base b LEFT JOIN covered c ON b.r = c.r
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
), vectors AS MATERIALIZED (
  SELECT r, length(coalesce(lang, '')) || '|' || coalesce(lang, '') || '|' || coalesce(source, '') || (lang IS NULL) || (source IS NULL) AS g,
    {", ".join(f"{x} AS f{i}" for i, x in enumerate(VECTOR))} FROM judged WHERE NOT base_failed
), sums AS MATERIALIZED (SELECT g, 0 AS start, {sums} FROM vectors GROUP BY g)"""

    def shrunk(name: str) -> str:
        return f", {name}_ AS MATERIALIZED (SELECT g, start, {', '.join(SHRUNK)} FROM {name} JOIN (SELECT start, {', '.join(POOL)} FROM {name} GROUP BY start) USING (start))"

    out += shrunk("sums")
    out += steps("first", "sums_", estimate())
    out += f", boxes AS MATERIALIZED (SELECT g, 1 AS start, {sums} FROM (SELECT g, {', '.join(f'v.f{i}' for i in range(P))} FROM vectors v JOIN first USING (g) WHERE {BOX}) GROUP BY g)"
    out += shrunk("boxes")
    out += steps("box", "boxes_", estimate())
    columns = ", ".join(["g", *FACTORS, "det"])
    out += f", now0 AS (SELECT {columns}, 0 AS start FROM first UNION ALL SELECT {columns}, 1 AS start FROM box)"
    for s in range(STEPS):
        out += steps(f"near{s}_", f"(SELECT v.g, n.start, {f}, {', '.join(FACTORS)} FROM vectors v JOIN now{s} n ON v.g = n.g)", distance())
        out += f", classed{s} AS MATERIALIZED (SELECT g, start, {CLASS} AS class, {f} FROM near{s}_)"
        out += f", rows{s} AS (SELECT g, start, class, count(*) AS k FROM classed{s} GROUP BY ALL)"
        out += f", upto{s} AS (SELECT g, start, class, sum(k) OVER (PARTITION BY g, start ORDER BY class) AS up_to, sum(k) OVER (PARTITION BY g, start) AS whole FROM rows{s})"
        out += f", limit{s} AS (SELECT g, start, min(class) AS last FROM upto{s} WHERE up_to >= {SHARE} * whole GROUP BY g, start)"
        out += f", sums{s} AS MATERIALIZED (SELECT g, start, {sums} FROM classed{s} JOIN limit{s} USING (g, start) WHERE class <= last GROUP BY g, start)"
        out += shrunk(f"sums{s}")
        out += steps(f"est{s}_", f"sums{s}_", estimate())
        out += f", now{s + 1} AS (SELECT {columns}, start FROM est{s}_)"
    out += f", final AS (SELECT * FROM now{STEPS} QUALIFY row_number() OVER (PARTITION BY g ORDER BY det, start) = 1)"
    out += steps("dist", f"(SELECT r, {f}, {', '.join(FACTORS)} FROM vectors JOIN final USING (g))", distance())
    return out + f" SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(d2 <= {CUT}, false) AS kept FROM judged j LEFT JOIN dist d ON j.r = d.r"
