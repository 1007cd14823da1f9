"""Help projects (.hhp) and site maps (.hhc, .hhk) as relations.

A project's text is a row (project, rel, data); its lines are exploded, numbered, and carry the section that they stand in.
Sections have columns of their own, so one scan serves all. Includes are followed with joins to a fixpoint; a file is
included once in each chain, so cycles end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text
from lexforge.sources.shared import kept

PARAMS = "array<struct<name string, value string>>"


def lines(files: DataFrame) -> DataFrame:
    """(project, rel, line_no, line) of the non-empty trimmed lines of ``files`` (project, rel, data string) that are no
    comments; a byte order mark is dropped."""
    plain = F.regexp_replace("data", "^\\x{FEFF}", "")
    rows = files.select("project", "rel", F.posexplode(F.split(plain, "\n")).alias("line_no", "line"))
    return rows.withColumn("line", text.trim(F.col("line"))).where("line <> '' and not startswith(line, ';')")


def sections(rows: DataFrame) -> DataFrame:
    """``lines`` of project files with section (case folded), without the section lines themselves."""
    head = F.col("line").rlike("^\\[.*\\]$")
    order = Window.partitionBy("project", "rel").orderBy("line_no")
    named = rows.withColumn("section", F.last(F.when(head, text.fold(F.regexp_extract("line", "^\\[(.*)\\]$", 1))), True).over(order))
    return named.where(~head & F.col("section").isNotNull())


def options(rows: DataFrame) -> DataFrame:
    """(project, options): a map; of one key the last assignment holds."""
    pairs = rows.where("section = 'options' and contains(line, '=')").select("project", "line_no", text.fold(text.trim(F.substring_index("line", "=", 1))).alias("key"), text.trim(F.regexp_extract("line", "(?s)^[^=]*=(.*)$", 1)).alias("value"))
    last = pairs.groupBy("project", "key").agg(F.max_by("value", "line_no").alias("value"))
    return last.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("options"))


def option(name: str, default: str = ""):
    return F.coalesce(F.try_element_at("options", F.lit(name)), F.lit(default))


def listed(rows: DataFrame, section: str = "files") -> DataFrame:
    """(project, seq, value) of a section's lines as paths; of [FILES], the first of those equal without case."""
    found = rows.where(F.col("section") == section).select("project", F.col("line_no").alias("seq"), text.slashes(F.col("line")).alias("value"))
    if section != "files":
        return found
    return found.groupBy("project", text.fold(F.col("value")).alias("k")).agg(F.min(F.struct("seq", "value")).alias("x")).select("project", "x.seq", "x.value")


def included(rows: DataFrame, section: str, files: DataFrame) -> DataFrame:
    """(project, seq, line) of a section, include lines replaced by the lines of the files they name; seq is an array of line
    numbers from the project file inwards. Files that are missing are left out; a chain of includes may be of any length, and
    ends where it comes to a file that it holds already."""
    own = rows.where(F.col("section") == section).select("project", F.array("line_no").alias("seq"), "line", F.array().cast("array<string>").alias("chain"))
    inside = lines(files).select("project", text.fold(F.col("rel")).alias("k"), "line_no", F.col("line").alias("new"))
    is_include = F.col("line").startswith("#include")
    done = None
    while True:
        part = own.where(~is_include).select("project", "seq", "line")
        done = part if done is None else done.unionByName(part)
        named = own.where(is_include).withColumn("k", text.fold(text.slashes(F.regexp_replace(text.trim(F.regexp_replace("line", "^#include", "")), "^[\"<]|[\">]$", ""))))
        named = named.where(~F.array_contains("chain", F.col("k")))
        if named.isEmpty():
            break
        own = kept(named.join(inside, ["project", "k"]).select("project", F.concat("seq", F.array("line_no")).alias("seq"), F.col("new").alias("line"), F.concat("chain", F.array("k")).alias("chain")))
    return done


def aliases(found: DataFrame) -> DataFrame:
    """(project, seq, name, file) of included [ALIAS] lines; what follows a semicolon is a comment."""
    return found.where("contains(line, '=')").select("project", "seq", text.trim(F.substring_index("line", "=", 1)).alias("name"), text.slashes(text.trim(F.regexp_extract("line", "(?s)^[^=]*=([^;]*)", 1))).alias("file"))


def defines(found: DataFrame) -> DataFrame:
    """(project, seq, name, id) of included [MAP] lines ``#define name id``."""
    pattern = "^#define\\s+(\\S+)[ \\t]+(.*)$"
    return found.where(F.col("line").rlike(pattern)).select("project", "seq", F.regexp_extract("line", pattern, 1).alias("name"), text.number(F.regexp_extract("line", pattern, 2)).alias("id"))


WINDOW_TEXT = ["type", "caption", "toc", "idx", "default_file", "home", "jump1_file", "jump1_text", "jump2_file", "jump2_text"]
WINDOW_PATHS = {"toc", "idx", "default_file", "home", "jump1_file", "jump2_file"}
# Fixed values of the format: validity bits of the numbers before and after the rectangle.
WINDOW_BEFORE = [("nav_style", 0x2), ("nav_width", 0x20), ("buttons", 0x100)]
WINDOW_AFTER = [("styles", 0x4), ("ex_styles", 0x8), ("show_state", 0x40), ("nav_closed", 0x200), ("nav_default", 0x2000), ("nav_pos", 0x400), ("notify_id", 0)]
RECT_BIT = 0x10


def windows(rows: DataFrame) -> DataFrame:
    """(project, seq, type, ..., rect, ..., valid_flags) of [WINDOWS] lines: comma-separated fields, quoted or not, and a
    rectangle in brackets."""
    joined = F.concat(F.regexp_replace("line", "^([^=]*)=", "$1,"), F.lit(","))
    t = F.transform(F.regexp_extract_all(joined, F.lit('("[^"]*"?[^,]*|[^",][^,]*|),'), 1), lambda x: F.when(x.startswith('"'), F.regexp_extract(x, '^"([^"]*)', 1)).otherwise(text.trim(x)))
    found = rows.where("section = 'windows'").select("project", F.col("line_no").alias("seq"), t.alias("t"))
    at = lambda i: F.coalesce(F.get("t", i if not isinstance(i, int) else F.lit(i)), F.lit(""))
    boxed = at(13).startswith("[")
    closing = F.array_position(F.transform(F.slice("t", 14, 4), lambda x: x.contains("]")), True)
    sides = F.when(boxed, F.when(closing > 0, closing).otherwise(F.lit(4))).otherwise(F.lit(1)).cast("int")
    found = found.withColumn("sides", sides).withColumn("boxed", boxed)
    signed = lambda x: text.number(F.regexp_replace(x, "[\\[\\]\\- ]", "")) * F.when(x.contains("-"), -1).otherwise(1)
    rect = F.when(F.col("boxed"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.when(k < F.col("sides"), signed(F.coalesce(F.get("t", k + 13), F.lit("")))).otherwise(F.lit(0).cast("bigint")).cast("int"))).otherwise(F.array(*[F.lit(0)] * 4))
    after = {name: at(F.col("sides") + 13 + i) for i, (name, _) in enumerate(WINDOW_AFTER)}
    before = {name: at(10 + i) for i, (name, _) in enumerate(WINDOW_BEFORE)}
    flags = F.when(F.col("boxed") & F.exists(F.slice("t", F.lit(14), F.col("sides")), lambda x: F.regexp_replace(x, "[\\[\\] ]", "") != ""), RECT_BIT).otherwise(0)
    for name, bit in [*WINDOW_BEFORE, *WINDOW_AFTER]:
        flags = flags + F.when((before | after)[name] != "", bit).otherwise(0)
    texts = [(text.slashes(at(i)) if name in WINDOW_PATHS else at(i)).alias(name) for i, name in enumerate(WINDOW_TEXT)]
    return found.select("project", "seq", *texts, *(text.number(v).alias(k) for k, v in before.items()), rect.alias("rect"), *(text.number(v).alias(k) for k, v in after.items()), flags.alias("valid_flags"))


_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<([^\s>]*)([^>]*)>?", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>/]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""", re.S)
_ENTITY = re.compile(r"&([^;&]{0,9});")


def entity(found: re.Match) -> str:
    name = found[1]
    if name in text.NAMED:
        return text.NAMED[name]
    if not name.startswith("#"):
        return found[0]
    digits = re.match(r"#[xX]([0-9a-fA-F]+)|#(\d+)", name)
    code = 0 if not digits else int(digits[1], 16) if digits[1] else int(digits[2])
    return chr(code) if 0 < code < 256 else ""


def _fold(s: str) -> str:
    return s.translate(str.maketrans(text.UPPER, text.LOWER))


def parse_site_map(source: str) -> tuple[list[tuple], list[tuple]]:
    """Nodes (node_id, parent_id, ordinal, depth, params) in document order, and the site's properties."""
    nodes, properties, stack, mode, pending = [], [], [None], "", []
    children: dict = {}
    for found in _TAG.finditer(source):
        name = _fold(found[1] or "")
        attributes: dict = {}
        for m in _ATTRIBUTE.finditer(found[2] or ""):
            attributes.setdefault(_fold(m[1]), _ENTITY.sub(entity, m[2] or m[3] or m[4] or ""))
        if name == "ul":
            own = children.get(stack[-1])
            stack.append(own[-1] if own else stack[-1])
        elif name == "/ul":
            if len(stack) > 1:
                stack.pop()
        elif name == "object":
            kind = _fold(attributes.get("type", ""))
            if kind in ("text/sitemap", "text/site properties"):
                mode, pending = kind, []
        elif name == "param" and mode:
            if key := _fold(attributes.get("name", "")):
                (pending if mode == "text/sitemap" else properties).append((key, attributes.get("value", "")))
        elif name == "/object":
            if mode == "text/sitemap":
                parent = stack[-1]
                siblings = children.setdefault(parent, [])
                depth = 0 if parent is None else nodes[parent][3] + 1
                nodes.append((len(nodes), parent, len(siblings), depth, pending))
                siblings.append(len(nodes) - 1)
            mode = ""
    return nodes, properties


def site_maps(files: DataFrame) -> DataFrame:
    """(project, rel, node_id, parent_id, ordinal, depth, params) of the site maps among ``files`` (project, rel, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for project, rel, data in zip(batch.project, batch.rel, batch.data, strict=True):
                for node, parent, ordinal, depth, params in parse_site_map(data or "")[0]:
                    rows.append((project, rel, node, parent, ordinal, depth, [{"name": k, "value": v} for k, v in params]))
            out = pd.DataFrame(rows, columns=["project", "rel", "node_id", "parent_id", "ordinal", "depth", "params"])
            yield out.astype({"parent_id": "Int32"})

    maps = files.where(text.fold(F.col("rel")).rlike("\\.hh[ck]$"))
    return maps.select("project", "rel", "data").mapInPandas(run, f"project string, rel string, node_id int, parent_id int, ordinal int, depth int, params {PARAMS}")


def site_properties(files: DataFrame) -> DataFrame:
    """(project, rel, ordinal, name, value) of the properties of the site maps among ``files`` (project, rel, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(project, rel, i, *x) for project, rel, data in zip(batch.project, batch.rel, batch.data, strict=True) for i, x in enumerate(parse_site_map(data or "")[1])]
            yield pd.DataFrame(rows, columns=["project", "rel", "ordinal", "name", "value"])

    maps = files.where(text.fold(F.col("rel")).rlike("\\.hh[ck]$"))
    return maps.select("project", "rel", "data").mapInPandas(run, "project string, rel string, ordinal int, name string, value string")


def param(name: str):
    """The first value of a parameter; empty without one."""
    return F.coalesce(F.get(F.filter("params", lambda p: p["name"] == name), F.lit(0))["value"], F.lit(""))


def locals_of(nodes: DataFrame) -> DataFrame:
    """(project, rel, node_id, i, value) of all non-empty ``local`` parameters, in document order."""
    each = nodes.select("project", "rel", "node_id", F.posexplode("params").alias("i", "p"))
    return each.where("p.name = 'local' and p.value <> ''").select("project", "rel", "node_id", "i", F.col("p.value").alias("value"))
