"""Whole compilations: a project's files to its relations, a collection of projects, and archives of pages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions import charset, records, text
from lexforge.operators import catalog, crawl, fts, html, index_files, keywords
from lexforge.sources import container, project
from lexforge.sources.shared import kept


def site_edges(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): which file names which, both case folded: links of pages by their directory, locals of site maps from the
    root."""
    pages = files.where(text.is_html_name(F.col("rel")))
    found = html.resolved_links(html.links(pages.select("rel", "data"), "rel", "data"), text.dir_of(F.col("rel")))
    local = project.locals_of(nodes).select("rel", text.resolve(F.lit(""), F.col("value")).alias("target"))
    both = found.select("rel", "target").unionByName(local).where("target <> ''")
    return both.select(text.fold(F.col("rel")).alias("src"), text.fold(F.col("target")).alias("dst")).distinct()


def compile_project(files: DataFrame, name: str) -> dict[str, DataFrame]:
    """The relations of one project. files: (project, rel, data binary) of all files at hand; name: its .hhp file.

    Returns options, files (all that listed files reach), missing (targets and listed files that are not there), topics,
    postings, statistics, keywords, links, context_ids, toc and index (site map nodes), properties, windows, and the files'
    text (decoded) and the project's own lines (own) that these come from."""
    is_project = text.fold(F.col("rel")) == name.lower()
    plain = files.where(is_project).select("project", "rel", charset.decode_text("data", F.lit(1252)).alias("data"))
    language = project.options(project.sections(project.lines(plain))).select("project", text.codepage(text.lcid(project.option("language"))).alias("codepage"))
    raw = files.join(language, "project", "left")  # pages that name no character set are in the code page of the language
    # checkpointed, as all relations come from these: their plans stay short, and no page is decoded twice
    decoded = kept(raw.select("project", "rel", charset.decode_text("data", F.coalesce("codepage", F.lit(1252))).alias("data")))
    own = kept(project.sections(project.lines(decoded.where(text.fold(F.col("rel")) == name.lower()))))
    chosen = project.options(own)
    nodes = kept(project.site_maps(decoded))
    edges = site_edges(decoded, nodes)
    maps = chosen.select(F.explode(F.array(project.option("contents file"), project.option("index file"))).alias("value")).where("value <> ''")
    listed = project.listed(own).select("value", "seq").unionByName(maps.select("value", F.lit(1 << 30).alias("seq")))
    seeds = listed.select(text.fold(text.slashes(F.col("value"))).alias("node")).distinct()
    reached = crawl.closure(seeds, edges)
    present = kept(decoded.withColumn("node", text.fold(F.col("rel"))).join(reached, "node"))
    missing = reached.join(decoded.select(text.fold(F.col("rel")).alias("node")), "node", "left_anti")
    pages = present.where(text.is_html_name(F.col("rel")))
    titled = html.titles(pages, "rel", "data").join(pages.select("rel", "depth"), "rel").withColumn("url", F.col("rel"))
    topics = kept(catalog.topics(titled, ["depth", "rel"]))
    words = html.words(html.text_runs(pages, "rel", "data"), "rel")
    by_topic = fts.postings(words, "rel").join(topics.select(F.col("url").alias("rel"), "topic"), "rel").drop("rel")
    objects = html.link_objects(pages, "rel", "data").join(topics.select(F.col("url").alias("rel"), "topic"), "rel")
    uses = objects.where("kind = 'keyword'").select(F.struct("topic", "seq").alias("seq"), F.col("value").alias("keyword"), "topic")
    links = objects.where("kind = 'alink'").select(F.struct("topic", "seq").alias("seq"), F.col("value").alias("keyword"), "topic")
    return {
        "decoded": decoded,
        "own": own,
        "links": keywords.flat_keywords(links),
        "properties": project.site_properties(decoded),
        "index": nodes.where(text.fold(F.col("rel")).endswith(".hhk")),
        "options": chosen,
        "files": present.select("rel", "depth"),
        "missing": missing,
        "topics": topics,
        "postings": by_topic,
        "statistics": fts.statistics(words, "rel"),
        "keywords": keywords.flat_keywords(uses),
        "context_ids": keywords.context_ids(project.defines(project.included(own, "map", decoded)), project.aliases(project.included(own, "alias", decoded))),
        "toc": nodes.where(text.fold(F.col("rel")).endswith(".hhc")),
        "windows": project.windows(own),
    }


def compile_archive(files: DataFrame, name: str, found: dict[str, DataFrame] | None = None) -> DataFrame:
    """(archive, data): one project as a whole archive, with its files, record files and index files. files: (project, rel,
data binary) at hand; name: its .hhp file; found: what ``compile_project`` gave, if it is at hand. Options say which index
    files it has. which index files it has.

    Pages, postings and compression are dealt to all tasks; the record files refer to one another by offset, and one task
    makes them from the relations, a short row for each topic, node and keyword."""
    found = found or compile_project(files, name)
    language = found["options"].select(text.lcid(project.option("language")).alias("lcid"), project.option("charset").alias("charset"), text.truthy(project.option("full-text search")).alias("fts"), text.truthy(project.option("full text search")).alias("fts2"), project.option("contents file").alias("toc_file"), project.option("index file").alias("index_file"))
    settings = language.withColumn("codepage", F.when(F.col("charset") != "", text.number(F.col("charset"))).otherwise(text.codepage(F.col("lcid")))).first()
    lcid, codepage, fts_wanted = (int(settings.lcid), int(settings.codepage), settings.fts or settings.fts2) if settings else (0x409, 1252, False)
    named = lambda df, path: df.where(text.fold(F.col("rel")) == text.fold(text.slashes(F.lit(path))))
    toc, index = (settings.toc_file, settings.index_file) if settings else ("", "")
    node = ["node_id", "parent_id", "depth", "params"]
    lines = lambda section: project.listed(found["own"], section).select("seq", "value")
    kinds = {
        "option": found["options"].select(F.explode("options").alias("key", "value")),
        "topic": found["topics"],
        "toc": named(found["toc"], toc).select(*node),
        "index": named(found["index"], index).select(*node),
        "property": named(found["properties"], toc).select("ordinal", "name", "value"),
        "keyword": found["keywords"],
        "link": found["links"],
        "window": found["windows"].drop("project"),
        "context": found["context_ids"],
        "merge": lines("merge files"),
        "subset": lines("subsets"),
        "type": lines("information types"),
    }
    if fts_wanted:
        kinds["text"] = found["statistics"].where("total_words > 0").select("total_words")
    rows = None
    for kind, df in kinds.items():
        one = df.select(F.lit(name).alias("archive"), F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
        rows = one if rows is None else rows.unionByName(one)

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        facts: dict[str, list[dict]] = {}
        for kind, row in zip(frame.kind, frame.row, strict=True):
            facts.setdefault(kind, []).append(json.loads(row))
        for each in facts.values():
            each.sort(key=lambda r: r.get("seq", r.get("ordinal", 0)) or 0)
        inside, raw = records.project_files(facts, codepage, lcid)
        out = [(name, True, k, v) for k, v in inside.items()] + [(name, False, k, v) for k, v in raw.items()]
        return pd.DataFrame(out, columns=["archive", "inside", "name", "data"])

    made = kept(rows.groupBy("archive").applyInPandas(make, "archive string, inside boolean, name string, data binary"))
    pages = files.join(found["files"], "rel").select(F.lit(name).alias("archive"), F.struct(F.lit(0).alias("part"), "depth", F.col("rel").alias("name")).alias("seq"), F.concat(F.lit("/"), "rel").alias("name"), "data")
    part = lambda df, n: df.select("archive", F.struct(F.lit(n).alias("part"), F.lit(0).alias("depth"), "name").alias("seq"), "name", "data")
    everything = pages.unionByName(part(made.where("inside"), 1))
    if fts_wanted:
        text_index = index_files.fts_files(found["postings"].withColumn("archive", F.lit(name)), "topic", codepage, lcid)
        everything = everything.unionByName(part(text_index.withColumn("name", F.lit("/$FIftiMain")), 2))
    return container.pack(everything, made.where("not inside").select("archive", "name", "data"), lcid)


def collection_members(files: DataFrame, master: str) -> DataFrame:
    """(seq, member, path, kind): the projects that a master project merges, in order, and the master, last. A merged
    project is found beside the master, or in a folder of its name (kind project); where there is none, an archive of
    its name in these places is taken as it is (kind archive); else the path is null (kind missing)."""
    own = project.sections(project.lines(files.where(text.fold(F.col("rel")) == master.lower()).select("project", "rel", charset.decode_text("data", F.lit(1252)).alias("data"))))
    names = project.listed(own, "merge files").select("seq", text.stem(F.col("value")).alias("member"))
    places = [(F.concat("member", F.lit(ending)), rank) for rank, ending in enumerate((".hhp", ".chm"))]
    places = [(path, 2 * rank + below) for one, rank in places for below, path in ((0, one), (1, F.concat("member", F.lit("/"), one)))]
    each = names.select("seq", "member", F.explode(F.array(*(F.struct(F.lit(rank).alias("rank"), path.alias("path")) for path, rank in places))).alias("place")).select("seq", "member", "place.*")
    there = each.join(files.select(F.col("rel").alias("path")).distinct(), "path", "left_semi").groupBy("seq").agg(F.min(F.struct("rank", "path")).alias("best"))
    kind = F.when(F.col("best").isNull(), "missing").when(F.col("best.rank") < 2, "project").otherwise("archive")
    merged = names.join(there, "seq", "left").select(F.col("seq").cast("bigint").alias("seq"), "member", F.col("best.path").alias("path"), kind.alias("kind"))
    last = files.sparkSession.createDataFrame([(1 << 62, master.rsplit(".", 1)[0], master, "master")], "seq bigint, member string, path string, kind string")
    return merged.unionByName(last)


def compile_collection(files: DataFrame, master: str) -> dict[str, DataFrame]:
    """The relations of a master project and of those that it merges, each with the column member. Members without a
    project file (see ``collection_members``) are left out."""
    out: dict[str, DataFrame] = {}
    found = collection_members(files, master).where("kind in ('project', 'master')")
    members = [(r.member, r.path) for r in found.orderBy("seq").collect()]  # a line each of one file
    for member, path in members:
        base = path[: path.rfind("/") + 1]
        inside = files.where(F.col("rel").startswith(base)).withColumn("rel", F.col("rel").substr(F.lit(len(base) + 1), F.length("rel")))
        for k, df in compile_project(inside, path[len(base) :]).items():
            df = df.withColumn("member", F.lit(member))
            out[k] = out[k].unionByName(df) if k in out else df
    return out


def round_trip(pages: DataFrame, archives: int = 8) -> DataFrame:
    """(page_id, sha256, same): pages packed into archives, unpacked again, and compared by digest."""
    name = F.concat(F.lit("/"), F.col("page_id").cast("string"), F.lit(".html"))
    files = pages.select(F.pmod("page_id", F.lit(archives)).cast("string").alias("archive"), F.col("page_id").alias("seq"), name.alias("name"), F.encode("html", "UTF-8").alias("data"))
    packed = container.pack(files).select(F.col("archive").alias("path"), F.col("data").alias("content"))
    read = container.extractable(container.entries(packed, with_content=True)).select("name", F.sha2("content", 256).alias("sha256"))
    was = files.select(F.col("seq").alias("page_id"), "name", F.sha2("data", 256).alias("was"))
    return was.join(read, "name", "left").select("page_id", F.col("was").alias("sha256"), F.coalesce(F.col("sha256") == F.col("was"), F.lit(False)).alias("same"))
