"""URL filters: rules on hosts and paths, then a blocked Bloom filter of listed URLs that passes possible hits to an exact
hash join. DataFrame and SQL functions only.

URLs are canonical for the list: no scheme, user or fragment, host in lower case without ``www.`` and default port, no
slash at the path's end, query parameters sorted and without those of trackers (utm_...). The filter has blocks of 256
bits in four longs; a URL sets two bits in each long of one block. It has 16 bits or more for each listed URL, so that
about one in a thousand others passes, and the join removes those.

A null URL, or one without ``://``, has an empty host and path, fits no rule, is in no list and is allowed. An empty list
allows all that no rule blocks. Rows that repeat get a row each. Further columns are carried along; columns with the names
of the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.store import bounded, written

#: (verdict, host, path): fits the host and its subdomains if the URL's path starts with the rule's; the longest wins.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
BITS = 16
#: Blocks (40 bytes each) up to which the filter is broadcast; a larger one is joined by shuffle on the block.
BROADCAST_BLOCKS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What stands after the first ``://``; empty without one."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substring(url_, instr(url_, '://') + 3)")), F.lit(""))


def host_and_path(rest: Column) -> tuple[Column, Column]:
    return F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def canonical(rest: Column, host: Column, path: Column) -> Column:
    """The form of a URL in which it is listed; null for an empty host."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)?$", ""), r"^www\.", "")
    query = F.split(F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda q: (q != "") & ~q.startswith("utm_"))), "&")
    return F.when(host != "", F.concat(name, F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def parsed(pages: DataFrame) -> DataFrame:
    """``pages`` with host, path and canonical form (canon_) of url."""
    rows = pages.drop("host", "path", "rule", "verdict", "url_", "rest_", "canon_").withColumn("url_", F.col("url")).withColumn("rest_", _rest(F.col("url_")))
    host, path = host_and_path(F.col("rest_"))
    rows = rows.withColumns({"host": host, "path": path})
    return rows.withColumn("canon_", canonical(F.col("rest_"), F.col("host"), F.col("path"))).drop("url_", "rest_")


def ruled(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; null if none does."""
    rule = verdict = None
    for kind, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _masks(url: Column) -> list[Column]:
    """Four masks of two bits, from a second hash of the URL."""
    bit = lambda i: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h2_, {6 * i}) & 63 as int))")
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(4)]


def _hashed(rows: DataFrame, blocks: int) -> DataFrame:
    rows = rows.withColumn("h2_", F.xxhash64(F.col("canon_"), F.lit(1)))
    return rows.withColumns({"block_": F.pmod(F.xxhash64("canon_"), F.lit(blocks)), **{f"m{w}_": m for w, m in enumerate(_masks(F.col("canon_")))}}).drop("h2_")


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of the blocks that have any bit set; ``listed`` has canon_."""
    return _hashed(listed, blocks).groupBy(F.col("block_").alias("block")).agg(*(F.bit_or(f"m{w}_").alias(f"w{w}") for w in range(4)))


def judged(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict of url; blocked are, where no rule fits, the URLs of ``listed`` (url)."""
    known = written(parsed(listed.select("url")).where("canon_ is not null").select("canon_").distinct())
    blocks = max(1, -(-known.count() * BITS // 256))
    table = written(bloom(known, blocks))
    table = bounded(table, BROADCAST_BLOCKS)
    rule, verdict = ruled(rules)
    rows = parsed(pages).withColumns({"rule": rule, "verdict": verdict})
    done = rows.where("verdict is not null or canon_ is null").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    rest = _hashed(rows.where("verdict is null and canon_ is not null"), blocks).join(table, F.col("block_") == F.col("block"), "left")
    passes = F.lit(True)
    for w in range(4):
        passes &= F.coalesce(F.col(f"w{w}").bitwiseAND(F.col(f"m{w}_")) == F.col(f"m{w}_"), F.lit(False))
    names = done.columns
    rest = rest.withColumn("hit_", passes).select(*names, "hit_")
    misses = rest.where("not hit_").withColumn("verdict", F.lit("allow"))
    exact = rest.where("hit_").join(known.withColumn("found_", F.lit(True)), "canon_", "left").withColumn("verdict", F.when(F.col("found_"), "block").otherwise("allow"))
    return done.unionByName(misses.select(names)).unionByName(exact.select(names)).drop("canon_")


#: Hosts whose pages the query lists: fixed values.
SPAM_HOSTS = ["casino-win", "cheap-pills", "free-bets"]

_CANON = r"""regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '^www\.', '')
  || regexp_replace(path, '/+$', '')
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END"""


def oracle() -> str:
    def case(value) -> str:
        return " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(k, h, p)}'" for k, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))

    return rf"""
WITH rests AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, rest, translate(regexp_extract(rest, '(?s)^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM rests
), queried AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
    lambda q: q <> '' AND NOT starts_with(q, 'utm_'))) AS kept FROM parts
), canons AS (
  SELECT *, CASE WHEN host <> '' THEN {_CANON} END AS canon FROM queried
), listed AS (
  SELECT DISTINCT canon FROM canons WHERE regexp_matches(host, '(^|\.)({"|".join(SPAM_HOSTS)})\.') AND canon IS NOT NULL
), ruled AS (
  SELECT page_id, host, path, canon, CASE {case(lambda k, h, p: h + p)} END AS rule,
    CASE {case(lambda k, h, p: k)} END AS said FROM canons
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN listed l ON r.canon = l.canon
"""
