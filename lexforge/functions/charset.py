"""Decoding pages of unknown character sets, and encoding for a code page, by pandas UDFs."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

DBCS = (932, 936, 949, 950, 1361)
SINGLE = (1250, 1251, 1252, 1253, 1254, 1255, 1256, 1257, 1258, 874)


def sniff(data: bytes) -> int:
    """The code page that the first ``charset`` of the first 2048 bytes names; 0 if none that is known."""
    found = re.search(rb"charset[= \"':]*([a-z0-9-]*)", data[:2048].lower())
    name = found[1].decode() if found else ""
    if name in ("utf-8", "utf8"):
        return 65001
    if name in ("utf-16", "utf-16le", "unicode"):
        return 1200
    if page := re.match(r"windows-(\d+)", name):
        return int(page[1])
    return 1252 if name in ("iso-8859-1", "latin1") else 0


def codec(codepage: int) -> str:
    return f"cp{codepage}" if codepage in SINGLE else "latin-1"


def _latin_byte(e: UnicodeDecodeError) -> tuple[str, int]:
    return chr(e.object[e.start]), e.start + 1


codecs.register_error("lexforge.latin", _latin_byte)


def utf8_lenient(data: bytes) -> str:
    """UTF-8, in which bytes that do not fit count as Latin-1; linear in the bytes."""
    return data.decode("utf-8", "lexforge.latin")


def decode(data: bytes, fallback: int) -> str:
    """Text of a page: by its byte order mark, else by the set it names, else by the fallback code page."""
    if data[:3] == b"\xef\xbb\xbf":
        return utf8_lenient(data[3:])
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data[2:].decode("utf-16-le" if data[:1] == b"\xff" else "utf-16-be", "replace")
    page = sniff(data) or fallback
    if page == 65001:
        return utf8_lenient(data)
    if page == 1200:
        return data.decode("utf-16-le", "replace")
    return data.decode(codec(page), "replace")


def encode(text: str, codepage: int) -> bytes:
    """Text in a code page, ? for what it lacks; UTF-8 for code pages of two bytes."""
    if codepage in DBCS or codepage == 65001:
        return text.encode("utf-8")
    return text.encode(codec(codepage), "replace")


@F.pandas_udf(StringType())
def decode_text(data: pd.Series, codepage: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else decode(bytes(d), int(c)) for d, c in zip(data, codepage, strict=True)], dtype=object)


@F.pandas_udf(BinaryType())
def encode_text(text: pd.Series, codepage: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else encode(t, int(c)) for t, c in zip(text, codepage, strict=True)], dtype=object)
