"""Help archives: a directory of named entries, a raw section, and a section in LZX intervals.

``entries`` and ``contents`` read archives that Spark's binaryFile source has loaded, so any store that Spark reads will do;
the ``chm`` data source does the same behind spark.read.format. ``pack`` builds archives: the intervals of 64 KiB of all
archives are compressed in parallel, each a row of its own, then each archive is put together in one task, which holds
one archive.

Names that are absolute or climb out of the folder are never extracted. A damaged archive has an error in place of entries.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexforge.functions import lzx, text

# Fixed values of the format.
CHUNK, LISTING_HEAD, INDEX_HEAD, STRIDE = 4096, 0x14, 8, 5
SPACE = "::DataSpace/Storage/MSCompressed/"
CONTENT, CONTROL, SPAN = SPACE + "Content", SPACE + "ControlData", SPACE + "SpanInfo"
TRANSFORM = "{7FC28940-9D31-11D0-9B27-00A0C91E9C7C}"
RESET_TABLE = f"{SPACE}Transform/{TRANSFORM}/InstanceData/ResetTable"
FORMAT_IDS = ["7c01fd10-7baa-11d0-9e0c-00a0c922e6ec", "7c01fd11-7baa-11d0-9e0c-00a0c922e6ec"]
DIRECTORY_ID = "5d02926a-212e-11d0-9df9-00a0c922e6ec"


@dataclass
class Entry:
    name: str
    section: int
    offset: int
    length: int


def varint(n: int) -> bytes:
    """Groups of seven bits, the highest first, all but the last marked."""
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    while True:
        value = value << 7 | data[at] & 0x7F
        at += 1
        if data[at - 1] < 0x80:
            return value, at


def read_directory(data: bytes) -> tuple[list[Entry], int]:
    """The entries of an archive, and where its content begins."""
    if data[:4] != b"ITSF" or len(data) < 0x60:
        raise ValueError("not a help archive")
    directory, content = struct.unpack_from("<Q", data, 0x48)[0], struct.unpack_from("<Q", data, 0x58)[0]
    if data[directory : directory + 4] != b"ITSP":
        raise ValueError("no directory")
    size, chunks = struct.unpack_from("<I", data, directory + 0x10)[0], struct.unpack_from("<I", data, directory + 0x2C)[0]
    out = []
    for base in range(directory + 0x54, directory + 0x54 + chunks * size, size):
        if data[base : base + 4] != b"PMGL":
            continue
        at, end = base + LISTING_HEAD, base + size - struct.unpack_from("<I", data, base + 4)[0]
        while at < end:
            n, at = read_varint(data, at)
            name, at = data[at : at + n].decode("utf-8", "replace"), at + n
            section, at = read_varint(data, at)
            offset, at = read_varint(data, at)
            length, at = read_varint(data, at)
            out.append(Entry(name, section, offset, length))
    return out, content


def section_one(data: bytes, entries: list[Entry], content: int) -> bytes:
    """The decompressed section."""
    by_name = {e.name: e for e in reversed(entries)}
    if not {CONTENT, CONTROL, SPAN} <= set(by_name):
        raise ValueError("no description of the compressed section")
    control = content + by_name[CONTROL].offset
    if data[control + 4 : control + 8] != b"LZXC":
        raise ValueError("the section is not LZX")
    version, reset, window = struct.unpack_from("<3I", data, control + 8)
    unit = lzx.FRAME if version == 2 else 1
    size = struct.unpack_from("<Q", data, content + by_name[SPAN].offset)[0]
    stream = by_name[CONTENT]
    return lzx.decompress(data[content + stream.offset : content + stream.offset + stream.length], size, (window * unit - 1).bit_length(), reset * unit)


def read_entries(data: bytes, with_content: bool) -> list[tuple]:
    """(name, section, offset, length, content); the compressed section is decoded only if its content is asked for."""
    entries, content = read_directory(data)
    one = section_one(data, entries, content) if with_content and any(e.section == 1 for e in entries) else b""
    out = []
    for e in entries:
        body = None
        if with_content:
            whole, at = (one, e.offset) if e.section else (data, content + e.offset)
            if at + e.length > len(whole):
                raise ValueError(f"entry out of range: {e.name}")
            body = whole[at : at + e.length]
        out.append((e.name, e.section, e.offset, e.length, body))
    return out


SCHEMA = "path string, name string, section int, offset bigint, length bigint, content binary, error string"


def _rows(path: str, data: bytes, with_content: bool) -> list[tuple]:
    try:
        return [(path, *row, None) for row in read_entries(data, with_content)]
    except (ValueError, IndexError, struct.error) as e:
        return [(path, None, None, None, None, None, str(e))]


def entries(archives: DataFrame, with_content: bool = False) -> DataFrame:
    """The entries of ``archives`` (path, content), as in SCHEMA."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch.path, batch.content, strict=True):
                rows = pd.DataFrame(_rows(path, bytes(data), with_content), columns=["path", "name", "section", "offset", "length", "content", "error"])
                yield rows.astype({"section": "Int32", "offset": "Int64", "length": "Int64"})

    return archives.select("path", "content").mapInPandas(run, SCHEMA)


def extractable(found: DataFrame) -> DataFrame:
    """Entries that extraction writes, with the relative path to write to."""
    relative = text.slashes(F.col("name")).substr(F.lit(2), F.length("name"))
    safe = ~F.exists(F.split(relative, "/"), lambda p: p == "..") & ~relative.startswith("/") & ~relative.rlike("^[A-Za-z]:")
    return found.where(F.col("name").startswith("/") & (F.col("length") > 0) & safe).withColumn("relative", relative)


def extract(archives: DataFrame, folder: str) -> DataFrame:
    """(path, name, written, error): every entry that extraction writes, of ``archives`` (path, content), as a file below
    ``folder`` (a path or URI that driver and executors share) by its relative path. Archives of one run that hold the same
    name write the same file, so extract each to a folder of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            rows = []
            for path, name, relative, content in zip(batch.path, batch.name, batch.relative, batch.content, strict=True):
                try:
                    target = f"{root}/{relative}"
                    files.create_dir(target.rpartition("/")[0], recursive=True)
                    with files.open_output_stream(target) as out:
                        out.write(bytes(content))
                    rows.append((path, name, len(content), None))
                except OSError as e:
                    rows.append((path, name, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "name", "written", "error"]).astype({"written": "Int64"})

    found = extractable(entries(archives, with_content=True)).select("path", "name", "relative", "content")
    return found.mapInPandas(run, "path string, name string, written bigint, error string")


class Partition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.content = options["path"], options.get("content", "false").lower() == "true"

    def partitions(self) -> list[Partition]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = files.get_file_info(path)
        names = [path] if info.type == fs.FileType.File else [f.path for f in files.get_file_info(fs.FileSelector(path, recursive=True)) if f.path.lower().endswith(".chm")]
        return [Partition(n) for n in sorted(names)]

    def read(self, partition: Partition) -> Iterator[tuple]:
        from pyarrow import fs

        files = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with files.open_input_file(partition.path) as f:
            yield from _rows(partition.path, f.read(), self.content)


class ArchiveSource(DataSource):
    """spark.read.format("chm").option("content", "true").load(folder or file)"""

    @classmethod
    def name(cls) -> str:
        return "chm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def _chunks(items: list[tuple[str, bytes]], head: int) -> list[list[tuple[str, bytes]]]:
    """Next-fit packing of directory items, with room for a count and for a mark at every fifth item."""
    out: list[list[tuple[str, bytes]]] = []
    used = 0
    for name, data in items:
        marks = 2 + 2 * (len(out[-1]) // STRIDE) if out else 0
        if not out or head + used + len(data) + marks > CHUNK:
            out.append([])
            used = 0
        out[-1].append((name, data))
        used += len(data)
    return out


def _chunk(head: bytes, items: list[tuple[str, bytes]]) -> bytes:
    out = bytearray(CHUNK)
    body = head + b"".join(d for _, d in items)
    out[: len(body)] = body
    struct.pack_into("<H", out, CHUNK - 2, len(items))
    offsets = [0]
    for _, d in items:
        offsets.append(offsets[-1] + len(d))
    for j in range(1, -(-len(items) // STRIDE)):
        struct.pack_into("<H", out, CHUNK - 2 - 2 * j, offsets[j * STRIDE])
    return bytes(out)


def write_container(entries: list[Entry], raw: bytes, stream: bytes, language: int = 0x409) -> bytes:
    """An archive of entries in two sections."""
    key = lambda e: (e.name.translate(str.maketrans(text.UPPER, text.LOWER)).encode(), e.name)
    items = [(e.name, varint(len(e.name.encode())) + e.name.encode() + varint(e.section) + varint(e.offset) + varint(e.length)) for e in sorted(entries, key=key)]
    listing = _chunks(items, LISTING_HEAD)
    free = lambda head, c: CHUNK - head - sum(len(d) for _, d in c)
    made = [_chunk(b"PMGL" + struct.pack("<IIii", free(LISTING_HEAD, c), 0, i - 1, i + 1 if i + 1 < len(listing) else -1), c) for i, c in enumerate(listing)]
    level, depth, root = [(c[0][0], i) for i, c in enumerate(listing)], 1, -1
    while len(level) > 1:
        depth += 1
        index = _chunks([(n, varint(len(n.encode())) + n.encode() + varint(i)) for n, i in level], INDEX_HEAD)
        level = [(c[0][0], len(made) + i) for i, c in enumerate(index)]
        made += [_chunk(b"PMGI" + struct.pack("<I", free(INDEX_HEAD, c)), c) for c in index]
        root = level[-1][1]
    directory = 0x54 + CHUNK * len(made)
    content = 0x78 + directory
    head = b"ITSF" + struct.pack("<5I", 3, 0x60, 1, 0, language) + b"".join(uuid.UUID(x).bytes_le for x in FORMAT_IDS) + struct.pack("<5Q", 0x60, 0x18, 0x78, directory, content)
    head += struct.pack("<IIQII", 0x1FE, 0, content + len(raw) + len(stream), 0, 0)
    head += b"ITSP" + struct.pack("<6IiIIiII", 1, 0x54, 10, CHUNK, 2, depth, root, 0, max(0, len(listing) - 1), -1, len(made), language)
    head += uuid.UUID(DIRECTORY_ID).bytes_le + struct.pack("<Iiii", 0x54, -1, -1, -1)
    return head + b"".join(made) + raw + stream


def _name_list() -> bytes:
    names = [struct.pack("<H", len(n)) + n.encode("utf-16-le") + b"\0\0" for n in ("Uncompressed", "MSCompressed")]
    body = struct.pack("<H", 2) + b"".join(names)
    return struct.pack("<H", (2 + len(body)) // 2) + body


def assemble(files: list[tuple[str, int]], size: int, frames: list[bytes], extra: dict[str, bytes] | None = None, language: int = 0x409) -> bytes:
    """An archive of files (name, length) that follow one another in the compressed section, whose frames are given, and
    of raw entries."""
    entries, at = [], 0
    for name, length in files:
        entries.append(Entry(name, 1, at, length))
        at += length
    starts, total = [], 0
    for f in frames:
        starts.append(total)
        total += len(f)
    table = struct.pack("<4I3Q", 2, len(starts), 8, 0x28, size, total, lzx.FRAME) + b"".join(struct.pack("<Q", s) for s in starts)
    raw = bytearray()
    parts = {
        **(extra or {}),
        "::DataSpace/NameList": _name_list(),
        CONTROL: struct.pack("<I4s6I", 6, b"LZXC", 2, 2, 2, 1, 0, 0),
        SPAN: struct.pack("<Q", size),
        f"{SPACE}Transform/List": TRANSFORM.encode("utf-16-le")[:38],
        RESET_TABLE: table,
    }
    for name, data in parts.items():
        entries.append(Entry(name, 0, len(raw), len(data)))
        raw += data
    entries.append(Entry(CONTENT, 0, len(raw), total))
    return write_container(entries, bytes(raw), b"".join(frames), language)


def pack(files: DataFrame, raw: DataFrame | None = None, language: int = 0x409) -> DataFrame:
    """(archive, data) of ``files`` (archive string, seq, name, data binary): one archive for each name of an archive, with
    its files in the order of seq, and with the entries ``raw`` (archive, name, data), if any, that are not compressed."""
    size = F.octet_length("data").cast("bigint")
    order = Window.partitionBy("archive").orderBy("seq", "name")
    placed = files.select("archive", "seq", "name", "data", size.alias("length"), (F.sum(size).over(order) - size).alias("at"))
    first, last = F.floor(F.col("at") / lzx.INTERVAL), F.floor((F.col("at") + F.greatest("length", F.lit(1)) - 1) / lzx.INTERVAL)
    cut = placed.where("length > 0").withColumn("interval", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.lit(0), F.col("interval") * lzx.INTERVAL - F.col("at"))
    end = F.least(F.col("length"), (F.col("interval") + 1) * lzx.INTERVAL - F.col("at"))
    cut = cut.select("archive", "interval", "at", F.expr("data").substr((begin + 1).cast("int"), (end - begin).cast("int")).alias("part"), begin.alias("begin"))

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "begin"])
        data = b"".join(map(bytes, rows.part))
        stream, ends = lzx.compress(data)
        used = -(-len(data) // lzx.FRAME)
        frames = [stream[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)][:used]
        return pd.DataFrame({"archive": [rows.archive.iat[0]], "interval": [rows.interval.iat[0]], "frames": [frames]})

    compressed = cut.groupBy("archive", "interval").applyInPandas(gather, "archive string, interval bigint, frames array<binary>")
    listed = placed.select("archive", F.struct("seq", "name", "length").alias("f")).groupBy("archive").agg(F.array_sort(F.collect_list("f")).alias("files"))
    streams = compressed.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("interval", "frames"))).alias("intervals"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            extras = batch.extras if "extras" in batch else [None] * len(batch)
            for names, intervals, extra in zip(batch.files, batch.intervals, extras, strict=True):
                each = [(f["name"], int(f["length"])) for f in names]
                frames = [bytes(x) for i in (intervals if intervals is not None else []) for x in i["frames"]]
                out.append(assemble(each, sum(n for _, n in each), frames, {x["name"]: bytes(x["data"]) for x in extra} if extra is not None else None, language))
            yield pd.DataFrame({"archive": batch.archive, "data": out})

    listed = listed.join(streams, "archive", "left")
    if raw is not None:
        listed = listed.join(raw.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("name", "data"))).alias("extras")), "archive", "left")
    return listed.mapInPandas(build, "archive string, data binary")
