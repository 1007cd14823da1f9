"""Scalar rules on the edge cases of the fixtures."""

import pytest
from pyspark.sql import functions as F

from lexforge.functions import charset, lzx, text
from lexforge.operators import html


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("base", "link", "target"),
    [("", "../a.htm", ""), ("", "b/../c.htm#f", "c.htm"), ("", "mailto:q", ""), ("", "a%20b.htm", "a b.htm"), ("", "a+b.htm", "a+b.htm"), ("d/", "x\\y.htm?q", "d/x/y.htm"), ("d/e/", "../../f", "f"), ("d/", "/g", "g"), ("", "#x", ""), ("", "%zz", "%zz"), ("", "caf%C3%A9", "café"), ("", "a/./b//c", "a/b/c"), ("", "a/b:c", "a/b:c"), ("", "  ", "")],
)
def test_resolve(spark, base, link, target):
    assert one(spark, text.resolve(F.col("b"), F.col("l")), b=base, l=link) == target


@pytest.mark.parametrize(("given", "page"), [("0x409 English", 1252), ("1049", 1251), ("junk", 1252), ("0x0C0A", 1252), ("0x411", 932), ("0x0816", 1252)])
def test_code_pages(spark, given, page):
    assert one(spark, text.codepage(text.lcid(F.col("l"))), l=given) == page


@pytest.mark.parametrize(("given", "plain"), [("&foo;", "&foo;"), ("&#8364;", ""), ("a&amp;b&#39;", "a&b'"), ("&nosemicolon", "&nosemicolon"), ("x&#x41;", "xA")])
def test_attribute_entities(spark, given, plain):
    assert one(spark, text.decode_attribute(F.col("a")), a=given) == plain


def test_code_bits(spark):
    rows = spark.createDataFrame([(v,) for v in (0, 3, 4, 9)], "v bigint").select(text.code_bits(F.col("v"), 2).alias("b")).collect()
    assert [r.b for r in rows] == [3, 3, 4, 6]


def words_of(spark, source):
    pages = spark.createDataFrame([(1, source)], "id int, html string")
    return [(r.word, r.pos, r.ctx) for r in sorted(html.words(html.text_runs(pages, "id"), "id").collect(), key=lambda r: r.pos)]


def test_words(spark):
    page = "<title>T</title><body>%s</body>"
    assert words_of(spark, page % "it's 3.14'x. v1.2") == [("t", 0, 1), ("its", 1, 0), ("3.14x.", 2, 0), ("v1", 3, 0), ("2", 4, 0)]
    assert words_of(spark, "<body>a " + "b" * 100 + " c") == [("a", 0, 0), ("c", 2, 0)]
    assert [w for w, _, _ in words_of(spark, "<body>foo<!-- c -->bar foo<b>bar")] == ["foobar", "foo", "bar"]
    assert [w for w, _, _ in words_of(spark, "<body>don&#39;t a&copy;b <script>x</script><style>y</style>z")] == ["dont", "a", "b", "z"]
    assert words_of(spark, "") == words_of(spark, None) == []


def test_links(spark):
    pages = spark.createDataFrame([(1, "<a data-src=\"x\" href = 'y' ><img src=z><a href=\"\">"), (2, None)], "id int, html string")
    assert [(r.seq, r.ref) for r in html.links(pages, "id").collect()] == [(0, "y"), (1, "z")]


def test_link_objects(spark):
    source = '<param name="Keyword" value="no"><object type=x><param name="Keyword" value="a &amp; b"><param name="ALink Name" value=c><param name="Keyword" value=""></object>'
    found = html.link_objects(spark.createDataFrame([(1, source)], "id int, html string"), "id").collect()
    assert [(r.seq, r.kind, r.value) for r in found] == [(0, "keyword", "a & b"), (1, "alink", "c")]


def test_charsets(spark):
    assert charset.decode("é".encode("cp1252"), 1252) == "é"
    assert charset.decode(b"\xef\xbb\xbf\xc3\xa9\xff", 1252) == "éÿ"
    assert charset.decode(b"<meta charset=windows-1251>\xc0", 1252).endswith("А")
    assert charset.decode(b"\xff\xfeA\0", 1252) == "A"
    assert charset.encode("é€日", 1252) == b"\xe9\x80?"
    rows = spark.createDataFrame([(bytearray(b"\xe9"), 1252), (None, 1252)], "d binary, c int")
    assert [r.x for r in rows.select(charset.decode_text("d", "c").alias("x")).collect()] == ["é", None]


@pytest.mark.parametrize("data", [b"", b"a", b"abc" * 20000, bytes(range(256)) * 200, b"\0" * 65536, b"the quick brown fox " * 3000])
def test_lzx_round_trip(data):
    stream, ends = lzx.compress(data)
    assert ends[-1] == len(stream)
    assert lzx.decompress(stream, len(data)) == data


def test_lzx_raw_and_damaged_blocks():
    out = lzx.Out()
    out.put(0, 1)
    out.put(lzx.RAW, 3)
    out.put(5, 24)
    out.align()
    stream = bytes(out.words) + b"\1\0\0\0" * 3 + b"hello\0" + b"\0" * 64
    assert lzx.decompress(stream, 5) == b"hello"
    with pytest.raises(ValueError):
        lzx.decompress(b"\xff" * 40, 10)
