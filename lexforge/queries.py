"""The registered queries on the driver's tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import text
from lexforge.operators import catalog, crawl, fts, html, keywords

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def url_path(url: Column) -> Column:
    """The path of an absolute URL, without a leading slash."""
    return F.regexp_extract(url, "^[a-z]+://[^/?#]*/?([^?#]*)", 1)


_URL_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1)"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def fold(x: str) -> str:
    return _FOLD.format(x)


_TITLE = r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '[ \t\r\n]+', ' ', 'g'), ' ')"

# A scanner's tokens, the state at each, the text runs, and the words with their places.
_TOKENS = rf"""
tokens AS (
  SELECT page_id, unnest(t) AS token, unnest(range(len(t))) AS pos
  FROM (SELECT page_id, regexp_extract_all(html, '{html.TOKEN}') AS t FROM pages)
), tags AS (
  SELECT *, CASE WHEN token LIKE '<%' THEN {fold("substr(token, 2, 8)")} END AS tag FROM tokens WHERE token NOT LIKE '<!--%'
), bodies AS (
  SELECT *, coalesce(last_value(CASE WHEN tag LIKE '/body%' THEN 0 WHEN tag LIKE 'body%' THEN 1 END IGNORE NULLS)
    OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS body FROM tags
), states AS (
  SELECT *, coalesce(last_value(CASE WHEN body = 0 AND tag LIKE 'title%' THEN 1 WHEN body = 0 AND tag LIKE '/title%' THEN 0 END IGNORE NULLS) OVER w, 0) AS title,
    coalesce(last_value(CASE WHEN body = 1 AND tag LIKE 'script%' THEN 1 WHEN body = 1 AND tag LIKE '/script%' THEN 0 END IGNORE NULLS) OVER w, 0) AS script,
    coalesce(last_value(CASE WHEN body = 1 AND tag LIKE 'style%' THEN 1 WHEN body = 1 AND tag LIKE '/style%' THEN 0 END IGNORE NULLS) OVER w, 0) AS style,
    count(tag) OVER w AS run
  FROM bodies WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), parts AS (
  SELECT page_id, run, pos, CASE WHEN body = 0 AND title = 1 THEN 1 WHEN body = 1 AND script = 0 AND style = 0 THEN 0 END AS ctx,
    CASE WHEN NOT regexp_full_match(token, '&[^;]*;') THEN token WHEN token = '&amp;' THEN '&' WHEN token = '&lt;' THEN '<'
      WHEN token = '&gt;' THEN '>' WHEN token = '&quot;' THEN '"' WHEN token = '&apos;' THEN chr(39)
      WHEN regexp_full_match(token, '&#[0-9]+;') AND CAST(substr(token, 3, length(token) - 3) AS BIGINT) BETWEEN 1 AND 255
        THEN chr(CAST(substr(token, 3, length(token) - 3) AS INTEGER)) ELSE ' ' END AS part
  FROM states WHERE tag IS NULL
), runs AS (
  SELECT page_id, run, ctx, string_agg(part, '' ORDER BY pos) AS text FROM parts WHERE ctx IS NOT NULL GROUP BY page_id, run, ctx
)"""
_WORDS = rf"""{_TOKENS}, raws AS (
  SELECT page_id, run, ctx, unnest(w) AS raw, unnest(range(len(w))) AS i
  FROM (SELECT page_id, run, ctx, regexp_extract_all({fold("text")}, '{html.WORD.replace("'", "''")}') AS w FROM runs)
), placed AS (
  SELECT page_id, ctx, replace(raw, chr(39), '') AS word, row_number() OVER (PARTITION BY page_id ORDER BY run, i) - 1 AS pos FROM raws
), words AS (
  SELECT page_id, pos, ctx, word FROM placed WHERE length(word) <= {html.LONGEST_WORD}
)"""
_POSTINGS = f"""{_WORDS}, postings AS (
  SELECT word, ctx, page_id, list(pos ORDER BY pos) AS positions FROM words GROUP BY word, ctx, page_id
)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.words(html.text_runs(pages(spark, sf_dir), "page_id"), "page_id")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.postings(words(spark, sf_dir), "page_id")


def joined(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_titles(spark, sf_dir):
    return html.titles(pages(spark, sf_dir), "page_id")


_LINKS = r"""
found AS (
  SELECT page_id, list_concat(
    list_transform(regexp_extract_all(html, '(?i)(?:^|[^a-z0-9_-])href\s*=\s*(?:"[^"]*|''[^'']*|[^>\s"''][^>\s]*)'), lambda x: x),
    list_transform(regexp_extract_all(html, '(?i)(?:^|[^a-z0-9_-])src\s*=\s*(?:"[^"]*|''[^'']*|[^>\s"''][^>\s]*)'), lambda x: x)) AS l FROM pages
), refs AS (
  SELECT page_id, list_filter(list_transform(l, lambda x: regexp_replace(x, '(?is)^[^a-z]?(href|src)\s*=\s*["'']?', '')), lambda x: x <> '') AS r FROM found
), links AS (
  SELECT page_id, unnest(r) AS ref, CAST(unnest(range(len(r))) AS INTEGER) AS seq FROM refs
)"""
_RESOLVED = rf"""{_LINKS}, paths AS (
  SELECT page_id, seq, ref, trim(ref, ' ' || chr(9) || chr(10) || chr(13)) AS l FROM links
), cut AS (
  SELECT *, (l = '' OR l LIKE '#%' OR (instr(l, ':') > 0 AND (instr(l, '/') = 0 OR instr(l, '/') > instr(l, ':')))) AS ext,
    replace(regexp_extract(l, '(?s)^[^#?]*'), chr(92), '/') AS p FROM paths
), based AS (
  SELECT c.*, CASE WHEN p LIKE '/%' THEN substr(p, 2) ELSE regexp_extract({_URL_PATH}, '(?s)^(.*/)', 1) || p END AS full_path
  FROM cut c JOIN pages USING (page_id)
), folded AS (
  SELECT page_id, seq, ref, ext, p, list_reduce(string_split(full_path, '/'), lambda acc, x:
    CASE WHEN acc IS NULL OR acc = '!' THEN '!' WHEN x IN ('', '.') THEN acc
      WHEN x = '..' THEN (CASE WHEN acc = '' THEN '!' WHEN instr(acc, '/') = 0 THEN '' ELSE regexp_replace(acc, '/[^/]*$', '') END)
      WHEN acc = '' THEN x ELSE acc || '/' || x END, '') AS f FROM based
), resolved AS (
  SELECT page_id, seq, ref, CASE WHEN ext OR p = '' OR f = '!' THEN '' ELSE f END AS target FROM folded
)"""


@query(f"WITH {_LINKS} SELECT page_id, seq, ref FROM links")
def page_links(spark, sf_dir):
    return html.links(pages(spark, sf_dir), "page_id")


def resolved(spark, sf_dir):
    rows = pages(spark, sf_dir)
    found = html.links(rows, "page_id")
    bases = rows.select("page_id", text.dir_of(url_path(F.col("url"))).alias("base"))
    return html.resolved_links(found.join(bases, "page_id"), F.col("base")).drop("base")


@query(f"WITH {_RESOLVED} SELECT page_id, seq, ref, target FROM resolved")
def page_links_resolved(spark, sf_dir):
    return resolved(spark, sf_dir)


@query(f"""WITH {_RESOLVED} SELECT target, count(*) AS refs FROM resolved
WHERE target <> '' AND {fold('target')} NOT IN (SELECT {fold(_URL_PATH)} FROM pages) GROUP BY target""")
def missing_link_targets(spark, sf_dir):
    files = pages(spark, sf_dir).select(url_path(F.col("url")).alias("url"))
    return crawl.missing_targets(resolved(spark, sf_dir), files)


@query("""WITH RECURSIVE edges AS (
  SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem UNION SELECT DISTINCT l_partkey + 1000000, l_suppkey FROM lineitem WHERE l_quantity > 45
), reach AS (
  SELECT CAST(1 AS BIGINT) AS node UNION SELECT dst FROM reach JOIN edges ON node = src
) SELECT node FROM reach""")
def link_closure(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey") + 1_000_000
    edges = lines.select(F.col("l_suppkey").alias("src"), part.alias("dst")).union(lines.where("l_quantity > 45").select(part, "l_suppkey")).distinct()
    return crawl.closure(spark.createDataFrame([(1,)], "node bigint"), edges).select("node")


@query(rf"""WITH names AS (
  SELECT page_id, regexp_extract({fold("substr(html, 1, 2048)")}, 'charset[= "'':]*([a-z0-9-]*)', 1) AS n FROM pages
) SELECT page_id, CAST(CASE WHEN n IN ('utf-8', 'utf8') THEN 65001 WHEN n IN ('utf-16', 'utf-16le', 'unicode') THEN 1200
  WHEN regexp_matches(n, '^windows-[0-9]') THEN CAST(regexp_extract(n, '^windows-([0-9]+)', 1) AS INTEGER)
  WHEN n IN ('iso-8859-1', 'latin1') THEN 1252 ELSE 0 END AS INTEGER) AS codepage FROM names""")
def page_charset(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", text.charset(F.col("html")).alias("codepage"))


_LANGS = {"en": "0x0409 English", "de": "0x0407", "fr": "1036 French", "es": "0x0C0A"}
_LCIDS = {"en": 0x409, "de": 0x407, "fr": 1036, "es": 0xC0A}


@query("SELECT lang, CAST(lcid AS BIGINT) AS lcid, CAST(1252 AS INTEGER) AS codepage, false AS dbcs, count(*) AS docs FROM (SELECT lang, CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _LCIDS.items()) + " END AS lcid FROM documents) GROUP BY lang, lcid")
def lang_codepage(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for kv in _LANGS.items() for x in kv))
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).withColumn("lcid", text.lcid(names[F.col("lang")]))
    rows = rows.withColumn("codepage", text.codepage(F.col("lcid")))
    return rows.select("lang", "lcid", "codepage", text.is_dbcs(F.col("codepage")).alias("dbcs"), "docs")


@query(f"WITH {_TOKENS} SELECT page_id, run, CAST(ctx AS INTEGER) AS ctx, text FROM runs")
def text_runs(spark, sf_dir):
    return html.text_runs(pages(spark, sf_dir), "page_id")


@query(f"WITH {_POSTINGS} SELECT word, CAST(ctx AS INTEGER) AS ctx, page_id, array_to_string(positions, ' ') AS positions FROM postings")
def word_postings(spark, sf_dir):
    return postings(spark, sf_dir).select("word", "ctx", "page_id", joined("positions"))


@query(rf"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, word FROM (
  SELECT doc_id, replace(unnest(w), chr(39), '') AS word, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, regexp_extract_all({fold("text")}, '{html.WORD.replace("'", "''")}') AS w FROM documents)) WHERE length(word) <= 99""")
def document_words(spark, sf_dir):
    return html.plain_words(table(spark, sf_dir, "documents"), "doc_id")


@query(f"""WITH {_WORDS}, uniq AS (SELECT DISTINCT word, ctx FROM words)
SELECT count(*) AS total_words, CAST(sum(length(word)) AS BIGINT) AS total_length, CAST(max(length(word)) AS INTEGER) AS longest,
  (SELECT count(*) FROM uniq) AS unique_words, (SELECT CAST(sum(length(word)) AS BIGINT) FROM uniq) AS unique_length,
  count(DISTINCT page_id) AS pages FROM words""")
def fts_stats(spark, sf_dir):
    return fts.statistics(words(spark, sf_dir), "page_id")


_DELTAS = f"""{_POSTINGS}, deltas AS (
  SELECT *, page_id - lag(page_id, 1, 0) OVER (PARTITION BY word, ctx ORDER BY page_id) AS doc_delta,
    list_transform(range(1, len(positions) + 1), lambda i: positions[i] - (CASE WHEN i = 1 THEN 0 ELSE positions[i - 1] END)) AS steps FROM postings
)"""


def _bits(v: str, root: int) -> str:
    m = f"(CASE WHEN {v} = 0 THEN 0 ELSE length(bin({v})) END)"
    return f"(CASE WHEN {m} <= {root} THEN {root + 1} ELSE 2 * {m} - {root} END)"


_SIZES = f"""{_DELTAS}, sizes AS (
  SELECT word, ctx, page_id, {_bits("doc_delta", 2)} + {_bits("len(positions)", 1)} + list_sum(list_transform(steps, lambda s: {_bits("s", 5)})) AS bits FROM deltas
), entries AS (
  SELECT word, ctx, count(*) AS docs, CAST(sum(CAST(ceil(bits / 8) AS INTEGER)) AS BIGINT) AS data_bytes FROM sizes GROUP BY word, ctx
)"""


@query(f"WITH {_DELTAS} SELECT word, CAST(ctx AS INTEGER) AS ctx, page_id, CAST(doc_delta AS BIGINT) AS doc_delta, array_to_string(steps, ' ') AS steps FROM deltas")
def posting_deltas(spark, sf_dir):
    return fts.deltas(postings(spark, sf_dir), "page_id").select("word", "ctx", "page_id", "doc_delta", joined("steps"))


@query(f"WITH {_SIZES} SELECT word, CAST(ctx AS INTEGER) AS ctx, page_id, CAST(bits AS INTEGER) AS bits, CAST(ceil(bits / 8) AS INTEGER) AS bytes FROM sizes")
def posting_code_bits(spark, sf_dir):
    return fts.code_sizes(fts.deltas(postings(spark, sf_dir), "page_id"), "page_id")


def entries(spark, sf_dir):
    return fts.word_entries(fts.code_sizes(fts.deltas(postings(spark, sf_dir), "page_id"), "page_id"))


@query(f"""WITH {_SIZES}, lagged AS (
  SELECT *, coalesce(lag(word) OVER (ORDER BY word, ctx), '') AS b FROM entries
) SELECT word, CAST(ctx AS INTEGER) AS ctx, docs, data_bytes, CAST(len(list_filter(range(1, least(length(word), length(b)) + 1),
  lambda i: left(word, CAST(i AS INTEGER)) = left(b, CAST(i AS INTEGER)))) AS INTEGER) AS prefix FROM lagged""")
def word_prefix_lengths(spark, sf_dir):
    return fts.prefix_lengths(entries(spark, sf_dir))


@query()
def fts_leaf_packing(spark, sf_dir):
    return fts.leaves(entries(spark, sf_dir))


@query(f"WITH {_POSTINGS} SELECT {_HOST} AS host, word, CAST(ctx AS INTEGER) AS ctx, page_id, array_to_string(positions, ' ') AS positions FROM postings JOIN pages USING (page_id)")
def fts_index_files(spark, sf_dir):
    """The full-text index of each host's pages, written as a file and read back."""
    from lexforge.operators import index_files

    hosts = pages(spark, sf_dir).select("page_id", index_files.host(F.col("url")).alias("archive"))
    found = fts.postings(words(spark, sf_dir), "page_id").join(hosts, "page_id")
    read = index_files.fts_entries(index_files.fts_files(found, "page_id"))
    return read.select(F.col("archive").alias("host"), "word", "ctx", F.col("page").alias("page_id"), joined("positions"))


@query(f"WITH {_WORDS} SELECT page_id, count(*) AS hits FROM words WHERE word = 'the' GROUP BY page_id")
def search_word(spark, sf_dir):
    return fts.search(postings(spark, sf_dir), "the", "page_id")


@query(f"WITH {_WORDS} SELECT page_id, count(*) AS hits FROM words WHERE word = 'the' AND ctx = 1 GROUP BY page_id")
def search_title(spark, sf_dir):
    return fts.search(postings(spark, sf_dir), "the", "page_id", titles_only=True)


@query(f"WITH {_WORDS} SELECT a.page_id, count(*) AS hits FROM words a JOIN words b ON a.page_id = b.page_id AND b.pos = a.pos + 1 WHERE a.word = 'of' AND b.word = 'the' GROUP BY a.page_id")
def search_phrase(spark, sf_dir):
    return fts.phrase(postings(spark, sf_dir), ["of", "the"], "page_id")


_TOPICS = rf"""titled AS (
  SELECT page_id, {_TITLE} AS title, {_URL_PATH} AS url FROM pages
), topics AS (
  SELECT row_number() OVER (ORDER BY page_id) - 1 AS topic, title, url,
    CAST(CASE WHEN contains(url, '#') THEN 0 WHEN title = '' THEN 2 ELSE 6 END AS INTEGER) AS in_contents FROM titled
)"""


def topics(spark, sf_dir):
    rows = pages(spark, sf_dir)
    titled = html.titles(rows, "page_id").join(rows.select("page_id", url_path(F.col("url")).alias("url")), "page_id")
    return catalog.topics(titled, ["page_id"])


@query(f"WITH {_TOPICS} SELECT topic, title, url, in_contents FROM topics")
def topic_table(spark, sf_dir):
    return topics(spark, sf_dir)


@query(f"""WITH RECURSIVE {_TOPICS}, strings AS (
  SELECT title AS str, min(topic) AS first FROM topics WHERE title <> '' GROUP BY title
), numbered AS (
  SELECT str, octet_length(encode(str)) AS size, row_number() OVER (ORDER BY first) AS n FROM strings
), placed AS (
  SELECT n, str, size, CAST(1 AS BIGINT) AS off FROM numbered WHERE n = 1
  UNION ALL
  SELECT b.n, b.str, b.size, CASE WHEN p.off + p.size + 1 + b.size + 1 > ((p.off + p.size + 1) // 4096 + 1) * 4096 AND b.size + 1 <= 4096
    THEN ((p.off + p.size + 1) // 4096 + 1) * 4096 ELSE p.off + p.size + 1 END FROM placed p JOIN numbered b ON b.n = p.n + 1
) SELECT str, off AS "offset" FROM placed""")
def string_dictionary(spark, sf_dir):
    return catalog.string_offsets(catalog.distinct_strings(topics(spark, sf_dir), "title", ["topic"]))


@query(f"WITH {_TOPICS} SELECT topic, url, 12 * topic + 4 * (topic // 341) AS url_offset FROM topics")
def url_table_offsets(spark, sf_dir):
    return topics(spark, sf_dir).select("topic", "url", catalog.url_table_offset(F.col("topic")).alias("url_offset"))


@query("SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS size, CAST(coalesce(sum(octet_length(encode(html))) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS section_offset FROM pages")
def section_offsets(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", F.octet_length("html").cast("bigint").alias("size"))
    return catalog.running(rows, ["page_id"], F.col("size"), "section_offset")


@query(f"""WITH names AS (SELECT DISTINCT '/' || {_URL_PATH} AS name FROM pages)
SELECT name, row_number() OVER (ORDER BY {fold("name")}, name) - 1 AS rank FROM names""")
def directory_order(spark, sf_dir):
    return catalog.directory(pages(spark, sf_dir).select(F.concat(F.lit("/"), url_path(F.col("url"))).alias("name")).distinct())


_KEYWORDS = f"""WITH uses AS (
  SELECT {fold("p_type")} AS sort_key, p_type, p_size AS topic, min(p_partkey) AS seq FROM part GROUP BY ALL
), firsts AS (
  SELECT sort_key, topic, min(seq) AS seq FROM uses GROUP BY ALL
) SELECT f.sort_key, (SELECT p_type FROM uses u WHERE u.sort_key = f.sort_key ORDER BY seq LIMIT 1) AS display,
  string_agg(CAST(topic AS VARCHAR), ' ' ORDER BY seq) AS topics FROM firsts f GROUP BY f.sort_key"""


@query(_KEYWORDS)
def keyword_index(spark, sf_dir):
    uses = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_type").alias("keyword"), F.col("p_size").alias("topic"))
    return keywords.flat_keywords(uses).select("sort_key", "display", joined("topics"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY sort_key) - 1 AS BIGINT) AS number, display, topics FROM ({_KEYWORDS})")
def keyword_index_files(spark, sf_dir):
    """The keyword index written as a tree of blocks and read back."""
    from lexforge.operators import index_files

    uses = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_type").alias("keyword"), F.col("p_size").cast("bigint").alias("topic"))
    marked = keywords.flat_keywords(uses).withColumn("archive", F.lit("parts"))
    none = marked.where("false").select("archive", "sort_key", "display", F.lit(None).cast("string").alias("see_also"), F.lit(0).alias("depth"), F.lit(0).alias("char_index"), "topics", F.lit(0).alias("ordinal"))
    read = index_files.keyword_entries(index_files.keyword_files(index_files.all_keywords(none, marked)))
    return read.select("number", "display", joined("topics"))


_NODES = """nodes AS (
  SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS name, 0 AS depth, [CAST(r_regionkey AS BIGINT)] AS ordinal, false AS has_page FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 1, [n_regionkey, n_nationkey], true FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name, 2, [n_regionkey, s_nationkey, s_suppkey], true FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""


def nodes(spark, sf_dir):
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    order = lambda *c: F.array(*(F.col(x).cast("bigint") for x in c)).alias("ordinal")
    none = F.lit(None).cast("string")
    top = region.select(name("r", "r_regionkey").alias("node"), none.alias("parent"), F.col("r_name").alias("name"), F.lit(0).alias("depth"), order("r_regionkey"), F.lit(False).alias("has_page"))
    middle = nation.select(name("n", "n_nationkey"), name("r", "n_regionkey"), "n_name", F.lit(1), order("n_regionkey", "n_nationkey"), F.lit(True))
    low = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(name("s", "s_suppkey"), name("n", "s_nationkey"), "s_name", F.lit(2), order("n_regionkey", "s_nationkey", "s_suppkey"), F.lit(True))
    return top.union(middle).union(low)


@query(f"""WITH RECURSIVE {_NODES}, walk AS (
  SELECT node, name AS path, 0 AS depth, 0 AS char_index FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.node, w.path || ', ' || n.name, w.depth + 1, CAST(octet_length(encode(w.path)) + 2 AS INTEGER) FROM nodes n JOIN walk w ON n.parent = w.node
) SELECT node, path, CAST(depth AS INTEGER) AS depth, CAST(char_index AS INTEGER) AS char_index, {fold("path")} AS sort_key FROM walk""")
def keyword_tree(spark, sf_dir):
    return keywords.tree(nodes(spark, sf_dir))


@query(f"""WITH {_NODES}, sized AS (
  SELECT *, CASE WHEN node IN (SELECT parent FROM nodes WHERE parent IS NOT NULL) THEN 28 ELSE 20 END AS size FROM nodes
), placed AS (
  SELECT *, 4096 + coalesce(sum(size) OVER (ORDER BY depth, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
    count(*) FILTER (has_page) OVER (ORDER BY depth, ordinal) AS seq,
    lead(node) OVER (PARTITION BY depth, parent ORDER BY ordinal) AS later FROM sized
) SELECT p.node, CAST(p.off AS BIGINT) AS "offset", CAST(coalesce(q.off, 0) AS BIGINT) AS parent_offset,
  CAST(CASE WHEN p.later IS NULL THEN 0 ELSE p.off + p.size END AS BIGINT) AS next_offset,
  CAST(coalesce((SELECT min(c.off) FROM placed c WHERE c.parent = p.node), 0) AS BIGINT) AS child_offset, p.seq
FROM placed p LEFT JOIN placed q ON p.parent = q.node""")
def toc_layout(spark, sf_dir):
    return keywords.layout(nodes(spark, sf_dir))


@query("""WITH aliases AS (
  SELECT s_nationkey AS name, min_by(s_name, s_suppkey) AS file FROM supplier GROUP BY s_nationkey
) SELECT n_regionkey AS id, max_by(file, n_nationkey) AS file FROM nation JOIN aliases ON name = n_nationkey GROUP BY n_regionkey""")
def context_map(spark, sf_dir):
    defines = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("seq"), F.col("n_nationkey").alias("name"), F.col("n_regionkey").alias("id"))
    aliases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_nationkey").alias("name"), F.col("s_name").alias("file"))
    return keywords.context_ids(defines, aliases)




def archives_of_hosts(spark, sf_dir):
    """Each host's pages packed into an archive, as (path, content)."""
    from lexforge.sources import container

    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("archive")
    name = F.concat(F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("name")
    files = pages(spark, sf_dir).select(host, F.col("page_id").alias("seq"), name, F.encode("html", "UTF-8").alias("data"))
    return container.pack(files).select(F.col("archive").alias("path"), F.col("data").alias("content"))


@query(f"SELECT {_HOST} AS host, count(*) AS files, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes FROM pages GROUP BY 1")
def compile_stats(spark, sf_dir):
    from lexforge.sources import container

    found = container.entries(archives_of_hosts(spark, sf_dir)).where("section = 1")
    return found.groupBy(F.col("path").alias("host")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@query(f"""SELECT {_HOST} AS host, page_id, CAST(octet_length(encode(html)) AS BIGINT) AS length,
  CAST(coalesce(sum(octet_length(encode(html))) OVER (PARTITION BY {_HOST} ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM pages""")
def archive_listing(spark, sf_dir):
    from lexforge.sources import container

    found = container.entries(archives_of_hosts(spark, sf_dir)).where("section = 1")
    return found.select(F.col("path").alias("host"), F.regexp_extract("name", "^/(-?[0-9]+)", 1).cast("bigint").alias("page_id"), "length", "offset")


@query(f"SELECT {_HOST} AS host, CAST(ceil(sum(octet_length(encode(html))) / 32768) AS BIGINT) AS frames, CAST(sum(octet_length(encode(html))) AS BIGINT) AS size FROM pages GROUP BY 1 HAVING sum(octet_length(encode(html))) > 0")
def reset_frames(spark, sf_dir):
    from lexforge.sources import container

    tables = container.entries(archives_of_hosts(spark, sf_dir), with_content=True).where(F.col("name") == container.RESET_TABLE)
    little = lambda at, n: F.conv(F.concat(*(F.hex(F.substring("content", at + k, 1)) for k in range(n, 0, -1))), 16, 10).cast("bigint")
    return tables.select(F.col("path").alias("host"), little(4, 4).alias("frames"), little(16, 8).alias("size")).where("size > 0")


@query("""SELECT CAST(h AS VARCHAR) AS byte, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) GROUP BY h""")
def byte_histogram(spark, sf_dir):
    return catalog.byte_counts(table(spark, sf_dir, "documents"), "text")


@query("SELECT page_id, sha256(html) AS sha256, true AS same FROM pages WHERE html <> ''")
def container_round_trip(spark, sf_dir):
    from lexforge.plans import compile as plans

    return plans.round_trip(pages(spark, sf_dir).where("html <> ''"))
