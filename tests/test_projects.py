"""Projects, site maps, archives and collections on small fixtures."""

import pytest
from compare import rows

from lexforge.operators import crawl, keywords
from lexforge.plans import compile as plans
from lexforge.sources import container, project

HHP = """﻿; comment
[OPTIONS]
Contents file=plots.hhc
Index file=words.hhk
Title=Old
title=New
Default Window=plan

[FILES]
gate.htm
GATE.HTM

[WINDOWS]
plan="Garden, plan","plots.hhc","words.hhk","gate.htm","gate.htm",,,,,0x2520,180,0x104e,[5,15,-25,35],0xc0000,,,,,,0

[ALIAS]
#include names.inc
AT_GATE=other.htm ; later

[MAP]
#include "ids.h"
#define AT_BEDS 0x1F6
#define AT_NONE 7
"""
FILES = {
    "garden.hhp": HHP,
    "names.inc": "AT_GATE=gate.htm ; first\nAT_BEDS=beds.htm\n",
    "ids.h": "#define AT_GATE 501\n#include <ids.h>\n",
    "plots.hhc": '<object type="text/site properties"><param name="ImageType" value="Folder"></object><ul><li><object type="text/sitemap"><param name="Name" value="A"><param name="Local" value="gate.htm"></object><ul><li><object type="text/sitemap"><param name="Name" value="B"><param name="Local" value="beds.htm"></object></ul><li><object type="text/sitemap"><param name="Name" value="C"></object></ul>',
    "words.hhk": '<ul><li><object type="text/sitemap"><param name="Name" value="arrival"><param name="Local" value="gate.htm"></object></ul>',
    "gate.htm": '<title>Gate</title><link href="paint.css"><body>Hello <a href="beds.htm">next</a> <a href="gone.htm">x</a>',
    "beds.htm": '<title> Rose\n beds </title><body>Roses hello<object><param name="Keyword" value="Deep soil"></object>',
    "paint.css": "p{}",
    "unused.htm": "<title>Unused</title>",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("p", k, bytearray(v.encode())) for k, v in FILES.items()], "project string, rel string, data binary")


@pytest.fixture(scope="module")
def compiled(files):
    return plans.compile_project(files, "garden.hhp")


def test_project_relations(compiled):
    options = compiled["options"].first().options
    assert options["title"] == "New"
    assert {r.rel for r in compiled["files"].collect()} == {"plots.hhc", "words.hhk", "gate.htm", "beds.htm", "paint.css"}
    assert {r.node for r in compiled["missing"].collect()} == {"gone.htm"}
    assert [(r.topic, r.title, r.url, r.in_contents) for r in sorted(compiled["topics"].collect())] == [(0, "Gate", "gate.htm", 6), (1, "Rose beds", "beds.htm", 6)]
    assert {(r.id, r.file) for r in compiled["context_ids"].collect()} == {(501, "gate.htm"), (502, "beds.htm")}
    hello = {(r.topic, r.ctx, tuple(r.positions)) for r in compiled["postings"].where("word = 'hello'").collect()}
    assert hello == {(0, 0, (1,)), (1, 0, (3,))}
    assert [(r.sort_key, r.display, r.topics) for r in compiled["keywords"].collect()] == [("deep soil", "Deep soil", [1])]


def test_windows(compiled):
    w = compiled["windows"].first()
    assert (w.type, w.caption, w.toc, w.home) == ("plan", "Garden, plan", "plots.hhc", "gate.htm")
    assert (w.nav_style, w.nav_width, w.buttons, w.rect, w.styles, w.notify_id) == (0x2520, 180, 0x104E, [5, 15, -25, 35], 0xC0000, 0)
    assert w.valid_flags == 0x2 | 0x20 | 0x100 | 0x10 | 0x4


def test_site_map_tree(compiled):
    toc = sorted(compiled["toc"].collect(), key=lambda r: r.node_id)
    assert [(r.node_id, r.parent_id, r.ordinal, r.depth) for r in toc] == [(0, None, 0, 0), (1, 0, 0, 1), (2, None, 1, 0)]
    nodes, properties = project.parse_site_map(FILES["plots.hhc"])
    assert properties == [("imagetype", "Folder")]
    assert project.parse_site_map("</ul></ul><ul><object type=text/sitemap><param name=Name value='&lt;x&#8364;'></object>")[0] == [(0, None, 0, 0, [("name", "<x")])]


def test_collection(spark):
    member = "[FILES]\na.htm\n"
    inside = {"all.hhp": "[MERGE FILES]\nflat.chm\nsub.chm\nnone.chm\n[FILES]\na.htm\n", "a.htm": "<title>M</title>", "flat.hhp": member, "sub/sub.hhp": member, "sub/a.htm": "<title>S</title>"}
    files = spark.createDataFrame([("p", k, bytearray(v.encode())) for k, v in inside.items()], "project string, rel string, data binary")
    out = plans.compile_collection(files, "all.hhp")
    assert {(r.member, r.title) for r in out["topics"].collect()} == {("flat", "M"), ("sub", "S"), ("all", "M")}


def test_closure_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",)], "node string")
    assert {tuple(r) for r in crawl.closure(seeds, edges).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_archives(spark, tmp_path):
    names = [("a", i, f"/d/{'Ab'[i % 2]}{i}.htm", bytearray(f"<p>{i}</p>".encode() * (i * 40))) for i in range(400)]
    names += [("b", 0, "/empty.txt", bytearray()), ("b", 1, "/../x", bytearray(b"up"))]
    files = spark.createDataFrame(names, "archive string, seq int, name string, data binary")
    packed = container.pack(files).select("archive", "data").collect()
    for r in packed:
        (tmp_path / f"{r.archive}.chm").write_bytes(r.data)
    (tmp_path / "bad.chm").write_bytes(b"ITSFnothing")
    loaded = spark.read.format("binaryFile").load(f"{tmp_path}/*.chm").select("path", "content")
    found = container.entries(loaded, with_content=True)
    got = {(r.path.rsplit("/", 1)[1][0], r.name): bytes(r.content) for r in found.where("section = 1").collect()}
    assert got == {(a, n): bytes(d) for a, _, n, d in names}
    assert [r.name for r in container.extractable(found).where("path like '%b.chm'").collect()] == []
    assert found.where("error is not null").count() == 1
    container.register(spark)
    listed = spark.read.format("chm").option("path", str(tmp_path)).load().where("section = 1")
    assert rows(["n", "l"], listed.select("name", "length").collect()) == rows(["n", "l"], [(n, len(d)) for _, _, n, d in names])


def test_first_alias_and_last_define(spark):
    defines = spark.createDataFrame([(0, "a", 1), (1, "b", 1), (2, "A", 2), (3, "a", 3)], "seq int, name string, id int")
    aliases = spark.createDataFrame([(0, "a", "x"), (1, "a", "y"), (2, "b", "z")], "seq int, name string, file string")
    assert {tuple(r) for r in keywords.context_ids(defines, aliases).collect()} == {(1, "z"), (3, "x")}
    assert [r.name for r in keywords.unknown_names(defines, aliases).collect()] == ["A"]


def test_long_chains_of_includes_and_of_parents(spark):
    files = {"p.hhp": "[ALIAS]\n#include 0.inc\n", **{f"{i}.inc": f"A{i}=f{i}.htm\n#include {i + 1}.inc\n" for i in range(30)}}
    rows = spark.createDataFrame([("p", k, v) for k, v in files.items()], "project string, rel string, data string")
    own = project.sections(project.lines(rows.where("rel = 'p.hhp'")))
    found = project.aliases(project.included(own, "alias", rows)).collect()
    assert {r.name for r in found} == {f"A{i}" for i in range(30)}
    chain = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(12)], "node int, parent int, name string")
    assert [(r.node, r.depth) for r in sorted(keywords.tree(chain).collect())] == [(i, i) for i in range(12)]


def test_pages_are_in_the_code_page_of_the_language(spark):
    inside = {"r.hhp": "[OPTIONS]\nLanguage=0x419\n[FILES]\na.htm\n".encode(), "a.htm": "<title>Сад</title>".encode("cp1251")}
    files = spark.createDataFrame([("r", k, bytearray(v)) for k, v in inside.items()], "project string, rel string, data binary")
    assert [r.title for r in plans.compile_project(files, "r.hhp")["topics"].collect()] == ["Сад"]


def test_lenient_utf8_is_linear_and_right():
    from lexforge.functions import charset

    assert charset.utf8_lenient(b"a\xe9b\xc3\xa9\xff") == "aébéÿ"
    assert len(charset.utf8_lenient(b"\xe9" * 400_000)) == 400_000


def test_a_project_becomes_an_archive(spark, tmp_path):
    from lexforge.functions import index_bytes, records

    hhp = HHP.replace("Title=Old", "Title=Old\nFull-text search=Yes\nBinary TOC=Yes\nBinary Index=Yes\nLanguage=0x407").replace("Index file=words.hhk\n", "Index file=words.hhk\n") + "[SUBSETS]\none\ntwo\n[MERGE FILES]\nshed.chm\n"
    source = FILES | {"garden.hhp": hhp}
    files = spark.createDataFrame([("p", k, bytearray(v.encode())) for k, v in source.items()], "project string, rel string, data binary")
    made = plans.compile_archive(files, "garden.hhp").selectExpr("archive as path", "data as content").cache()
    got = {r.name: r for r in container.entries(made, with_content=True).collect()}
    assert all(r.error is None for r in got.values())
    wanted = {"/#IVB", "/#TOPICS", "/#URLSTR", "/#URLTBL", "/#TOCIDX", "/#WINDOWS", "/#SUBSETS", "/#IDXHDR", "/#STRINGS", "/#SYSTEM", "/$FIftiMain", "/#ITBITS", *(f"/$WWKeywordLinks/{x}" for x in ("BTree", "Data", "Map", "Property")), "/$WWAssociativeLinks/Property"}
    assert wanted | {f"/{n}" for n in ("plots.hhc", "words.hhk", "gate.htm", "beds.htm", "paint.css")} <= set(got)
    assert "/unused.htm" not in got and bytes(got["/beds.htm"].content) == source["beds.htm"].encode()
    data = {n: bytes(r.content or b"") for n, r in got.items()}
    assert [x[0] for x in index_bytes.read_keywords(data["/$WWKeywordLinks/BTree"])] == ["arrival", "Deep soil"]
    words = {(w, c): list(index_bytes.read_pages(d, n)) for w, c, n, d in index_bytes.read_fts(data["/$FIftiMain"])}
    assert words["hello", 0] == [(0, [1]), (1, [3])] and words["rose", 1] == [(1, [0])]
    assert data["/#IDXHDR"][28:32] == b"\1\0\0\0" and b"shed.chm\0" in data["/#STRINGS"] and b"Garden, plan\0" in data["/#STRINGS"]
    assert data["/#SYSTEM"].count(b"New\0") == 1 and len(data["/#SUBSETS"]) == 28 and len(data["/#WINDOWS"]) == 204
    assert len(data["/#TOPICS"]) == 4 * 16 and records.struct.unpack_from("<I", data["/#TOPICS"])[0] == 4096
    folder = tmp_path / "out"
    done = container.extract(made, f"file://{folder}").collect()
    assert done and all(r.error is None for r in done)
    assert (folder / "gate.htm").read_bytes() == source["gate.htm"].encode() and (folder / "$WWKeywordLinks" / "Map").read_bytes() == data["/$WWKeywordLinks/Map"]


def test_index_files_only_where_options_ask(spark, files):
    made = plans.compile_archive(files, "garden.hhp").selectExpr("archive as path", "data as content")
    names = {r.name for r in container.entries(made).collect()}
    assert not names & {"/$FIftiMain", "/#TOCIDX", "/#IDXHDR", "/#SUBSETS"} and {"/#STRINGS", "/#TOPICS", "/$WWKeywordLinks/BTree"} <= names
