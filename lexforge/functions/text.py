"""Scalar functions on columns: text identity, entities, paths, languages, code sizes. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\r\n"

# Fixed values of the formats.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
DBCS_CODEPAGES = [932, 936, 949, 950, 1361]
#: Code page by full language id, then by its primary language (low ten bits); otherwise 1252.
CODEPAGE_BY_LCID = {
    0x0409: 1252, 0x0809: 1252, 0x0407: 1252, 0x040C: 1252, 0x0410: 1252, 0x040A: 1252, 0x0413: 1252, 0x041D: 1252, 0x0419: 1251,
    0x0422: 1251, 0x0402: 1251, 0x041A: 1250, 0x0405: 1250, 0x040E: 1250, 0x0415: 1250, 0x0418: 1250, 0x0408: 1253, 0x041F: 1254,
    0x0427: 1257, 0x0425: 1257, 0x0426: 1257, 0x040D: 1255, 0x0401: 1256, 0x041E: 874, 0x0411: 932, 0x0804: 936, 0x0412: 949,
    0x0404: 950, 0x042A: 1258,
}
CODEPAGE_BY_PRIMARY = {
    0x19: 1251, 0x22: 1251, 0x02: 1251, 0x1A: 1250, 0x05: 1250, 0x0E: 1250, 0x15: 1250, 0x18: 1250, 0x08: 1253, 0x1F: 1254,
    0x27: 1257, 0x25: 1257, 0x26: 1257, 0x0D: 1255, 0x01: 1256, 0x1E: 874, 0x11: 932, 0x12: 949, 0x04: 936, 0x2A: 1258,
}


def fold(c: Column) -> Column:
    """A-Z to a-z; other letters as they are."""
    return F.translate(c, UPPER, LOWER)


def trim(c: Column) -> Column:
    """Without spaces, tabs and line ends at both ends."""
    return F.btrim(c, F.lit(BLANK))


def slashes(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def collapse(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, "[ \\t\\r\\n]+", " "), F.lit(" "))


def dir_of(c: Column) -> Column:
    """Up to and with the last slash."""
    return F.regexp_extract(c, "(?s)^(.*/)", 1)


def stem(c: Column) -> Column:
    """The file name without directory and last extension."""
    return F.regexp_replace(F.substring_index(slashes(c), "/", -1), "\\.[^.]*$", "")


def is_html_name(c: Column) -> Column:
    name = fold(c)
    return name.contains(".ht") & ~name.contains(".hhc") & ~name.contains(".hhk")


def truthy(c: Column) -> Column:
    return F.coalesce(fold(trim(c)).isin("yes", "true", "1"), F.lit(False))


def number(c: Column) -> Column:
    """The number that a text begins with, as C reads it: 0x hexadecimal, 0 octal, else decimal; 0 without one."""
    t = fold(trim(c))
    return F.coalesce(
        F.when(t.rlike("^0x[0-9a-f]"), F.conv(F.regexp_extract(t, "^0x([0-9a-f]+)", 1), 16, 10))
        .when(t.rlike("^0[0-7]"), F.conv(F.regexp_extract(t, "^(0[0-7]+)", 1), 8, 10))
        .when(t.rlike("^[0-9]"), F.regexp_extract(t, "^([0-9]+)", 1))
        .cast("bigint"),
        F.lit(0).cast("bigint"),
    )


def lcid(language: Column) -> Column:
    n = number(language)
    return F.when(n == 0, F.lit(0x409)).otherwise(n).cast("bigint")


def codepage(lcid_: Column) -> Column:
    exact = F.create_map(*(F.lit(x) for kv in CODEPAGE_BY_LCID.items() for x in kv))
    primary = F.create_map(*(F.lit(x) for kv in CODEPAGE_BY_PRIMARY.items() for x in kv))
    return F.coalesce(F.try_element_at(exact, lcid_.cast("int")), F.try_element_at(primary, lcid_.cast("int").bitwiseAND(0x3FF)), F.lit(1252))


def is_dbcs(codepage_: Column) -> Column:
    return codepage_.isin(DBCS_CODEPAGES)


def _entity(name: Column, number_limit: int, too_large: str, unknown: Column) -> Column:
    """What an entity (without & and ;) stands for."""
    out = None
    for k, v in NAMED.items():
        out = F.when(name == k, v) if out is None else out.when(name == k, v)
    code = F.when(name.rlike("^#[xX][0-9a-fA-F]"), F.conv(F.regexp_extract(name, "^#[xX]([0-9a-fA-F]+)", 1), 16, 10)).when(name.rlike("^#[0-9]"), F.regexp_extract(name, "^#([0-9]+)", 1)).cast("bigint")
    return out.when(name.startswith("#") & code.between(1, number_limit), F.char(code)).when(name.startswith("#"), too_large).otherwise(unknown)


def text_entity(token: Column) -> Column:
    """A token ``&...;`` of running text: five names, nbsp and numbers up to 255 stand for a character, all else for a space."""
    return _entity(F.substring(token, 2, 100).substr(F.lit(1), F.length(token) - 2), 255, " ", F.lit(" "))


def decode_attribute(c: Column) -> Column:
    """Entities of attribute values: five names and numbers up to 255; larger numbers vanish, unknown names stay."""
    parts = F.regexp_extract_all(c, F.lit("(?s)&[^;]{0,9};|&|[^&]+"), 0)
    one = lambda t: F.when(t.startswith("&") & t.endswith(";") & (F.length(t) > 1), _entity(t.substr(F.lit(2), F.length(t) - 2), 255, "", t)).otherwise(t)
    return F.when(c.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(c)


def percent_decode(c: Column) -> Column:
    """%HH to the byte, the bytes read as UTF-8; malformed escapes and + stay."""
    parts = F.regexp_extract_all(c, F.lit("(?s)%[0-9A-Fa-f]{2}|[^%]+|%"), 0)
    one = lambda t: F.when(t.rlike("^%[0-9A-Fa-f]{2}$"), F.substring(t, 2, 2)).otherwise(F.hex(F.encode(t, "UTF-8")))
    return F.when(c.contains("%"), F.unhex(F.array_join(F.transform(parts, one), "")).cast("string")).otherwise(c)


def resolve(base: Column, link: Column) -> Column:
    """A link's path from the root, given the directory of the page that holds it; empty if external or unusable."""
    link = trim(link)
    colon, slash = F.instr(link, ":"), F.instr(link, "/")
    external = (link == "") | link.startswith("#") | ((colon > 0) & ((slash == 0) | (slash > colon)))
    path = slashes(percent_decode(F.regexp_extract(link, "(?s)^[^#?]*", 0)))
    full = F.when(path.startswith("/"), path.substr(F.lit(2), F.length(path))).otherwise(F.concat(base, path))
    none = F.lit(None).cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(none)
        return F.when(done.isNull(), none).when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    folded = F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), step)
    return F.when(external | (path == ""), "").otherwise(F.coalesce(F.array_join(folded, "/"), F.lit("")))


def charset(html: Column) -> Column:
    """The code page that the first ``charset`` of the first 2048 characters names: 65001 for UTF-8, 1200 for UTF-16, N for
    windows-N, 1252 for Latin-1; 0 if none of these."""
    name = F.regexp_extract(fold(F.substring(html, 1, 2048)), "charset[= \"':]*([a-z0-9-]*)", 1)
    return (
        F.when(name.isin("utf-8", "utf8"), 65001)
        .when(name.isin("utf-16", "utf-16le", "unicode"), 1200)
        .when(name.rlike("^windows-[0-9]"), F.regexp_extract(name, "^windows-([0-9]+)", 1).cast("int"))
        .when(name.isin("iso-8859-1", "latin1"), 1252)
        .otherwise(0)
    )


def bit_length(v: Column) -> Column:
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


def code_bits(v: Column, root: int) -> Column:
    """Bits of a number in scale/root code (scale 2)."""
    m = bit_length(v)
    return F.when(m <= root, root + 1).otherwise(2 * m - root)


def varint_bytes(v: Column) -> Column:
    """Bytes of a number in groups of seven bits."""
    return F.greatest(F.ceil(bit_length(v) / 7), F.lit(1)).cast("int")
