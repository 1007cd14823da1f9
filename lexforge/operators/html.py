"""HTML pages to titles, links, link objects, text runs and words.

Pages are dealt by their key once, before anything is exploded; the windows and groups by page that follow need no other
exchange, and what travels is the page, not its tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text

TOKEN = r"(?s)<!-->|<!--->|<!--.*?-->|<!--.*|<[^>]*>|<.*|&[^;]{0,9};|&|[^<&]+"
WORD = "[a-z][a-z0-9']*|[0-9][a-z0-9.']*"
LONGEST_WORD = 99
_VALUE = r"""\s*=\s*(?:"([^"]*)|'([^']*)|([^>\s"'][^>\s]*))"""


def titles(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, title): the text of the first title element, white space collapsed; empty without one."""
    return pages.select(key, text.collapse(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title", 1)).alias("title"))


def links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, seq, ref): values of all href, then of all src attributes, without empty ones. A name that continues a word,
    as in data-src, is none."""
    def found(name: str):
        pattern = f"(?i)(?<![a-z0-9_-]){name}{_VALUE}"
        groups = [F.regexp_extract_all(html, F.lit(pattern), k) for k in (1, 2, 3)]
        return F.filter(F.transform(F.arrays_zip(*groups), lambda g: F.concat(g["0"], g["1"], g["2"])), lambda v: v != "")

    return pages.select(key, F.posexplode(F.concat(found("href"), found("src"))).alias("seq", "ref"))


def resolved_links(found: DataFrame, base) -> DataFrame:
    """``links`` with target: the path from the root of the site, empty if external. base: the page's directory."""
    return found.withColumn("target", text.resolve(base, F.col("ref")))


def tokens(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, token): comments, tags, entities and text in the order of a scanner."""
    return pages.select(key, html).repartition(key).select(key, F.posexplode(F.regexp_extract_all(html, F.lit(TOKEN), 0)).alias("pos", "token"))


def text_runs(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, run, ctx, text): stretches of text without a tag between; ctx 1 in a title before the body, 0 in the body
    outside scripts and styles. A comment does not end a run."""
    t = tokens(pages, key, html).where(~F.col("token").startswith("<!--"))
    tag = F.when(F.col("token").startswith("<"), text.fold(F.substring("token", 2, 8)))
    t = t.withColumn("tag", tag)
    order = Window.partitionBy(key).orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("body_event", F.when(F.col("tag").startswith("/body"), 0).when(F.col("tag").startswith("body"), 1))
    t = t.withColumn("body", F.coalesce(F.last("body_event", True).over(before), F.lit(0)))
    t = t.withColumn("title_event", F.when(F.col("body") == 0, F.when(F.col("tag").startswith("title"), 1).when(F.col("tag").startswith("/title"), 0)))
    inside = F.col("body") == 1
    t = t.withColumn("script_event", F.when(inside, F.when(F.col("tag").startswith("script"), 1).when(F.col("tag").startswith("/script"), 0)))
    t = t.withColumn("style_event", F.when(inside, F.when(F.col("tag").startswith("style"), 1).when(F.col("tag").startswith("/style"), 0)))
    state = lambda c: F.coalesce(F.last(c, True).over(until), F.lit(0))
    t = t.select(key, "pos", "token", "tag", "body", state("title_event").alias("title"), state("script_event").alias("script"), state("style_event").alias("style"), F.count("tag").over(until).alias("run"))
    ctx = F.when((F.col("body") == 0) & (F.col("title") == 1), 1).when((F.col("body") == 1) & (F.col("script") == 0) & (F.col("style") == 0), 0)
    plain = F.when(F.col("token").rlike("^&[^;]*;$"), text.text_entity(F.col("token"))).otherwise(F.col("token"))
    kept = t.where("tag is null").select(key, "run", "pos", ctx.alias("ctx"), plain.alias("part")).where("ctx is not null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "")
    return kept.groupBy(key, "run", "ctx").agg(joined.alias("text"))


def words(runs: DataFrame, key: str) -> DataFrame:
    """(key, pos, ctx, word): lower-case words with their places, counted over title and body. Words of more than 99
    characters are left out but have a place."""
    each = runs.select(key, "run", "ctx", F.posexplode(F.regexp_extract_all(text.fold(F.col("text")), F.lit(WORD), 0)).alias("i", "raw"))
    placed = each.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("run", "i")) - 1)
    return placed.select(key, "pos", "ctx", F.translate("raw", "'", "").alias("word")).where(F.length("word") <= LONGEST_WORD)


def plain_words(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, pos, word) of plain text."""
    found = F.transform(F.regexp_extract_all(text.fold(F.col(column)), F.lit(WORD), 0), lambda w: F.translate(w, "'", ""))
    return docs.select(key, F.posexplode(found).alias("pos", "word")).where(F.length("word") <= LONGEST_WORD)


def link_objects(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, seq, kind, value): Keyword and ALink Name parameters inside object elements."""
    order = Window.partitionBy(key).orderBy("pos")
    t = tokens(pages, key, html).where(F.col("token").startswith("<") & ~F.col("token").startswith("<!--"))
    t = t.withColumn("tag", text.fold(F.regexp_extract("token", r"^<\s*(/?[A-Za-z0-9]*)", 1)))
    t = t.withColumn("open", F.last(F.when(F.col("tag") == "object", 1).when(F.col("tag") == "/object", 0), True).over(order))
    value = lambda name: F.regexp_extract("token", rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^>\s"']+))""", 0)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?s)^\s*[A-Za-z]+\s*=\s*", ""), "(?s)^[\"'](.*)[\"']$", "$1")
    p = t.where("tag = 'param' and open = 1").select(key, "pos", text.fold(text.decode_attribute(bare(value("name")))).alias("name"), text.decode_attribute(bare(value("value"))).alias("value"))
    kind = F.when(F.col("name") == "keyword", "keyword").when(F.col("name") == "alink name", "alink")
    return p.select(key, kind.alias("kind"), "value", F.row_number().over(order).alias("n"), "pos").where("kind is not null and value <> ''").select(key, (F.row_number().over(order) - 1).alias("seq"), "kind", "value")
