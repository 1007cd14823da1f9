"""Legacy archives: ARC files, versions 1 and 2, converted to WARC, and WARC files written and read.

An ARC file opens with a version block whose second line names the version. Each record is a header line, whose fields
the version fixes, a declared number of bytes, and a line feed; the URL may hold spaces, so fields count from the right.
A line that is no such header is skipped up to the next line feed; a record whose bytes end early is kept as far as it
goes and marked as truncated. The converter makes for each record a WARC record id from a hash of what it holds, an ISO
timestamp (missing digits count as the first month, day or zero; no date at all as 1970), a type (warcinfo for the version
block, response for HTTP answers, else resource), and digests of block and payload.

Archives are read as streams, plain or compressed record by record, in time linear in their size; what is held is one
record. ``write_arc`` archives pages in ARC files in the shared folder, of either version and either form in turn, and
``convert_files`` makes a WARC file of each: a first pass over the ARC files gives each record's digest, from which the
revisits of each file follow, and a second pass converts. Of pages with equal payloads of at least LEAST bytes the one
with the smallest page_id is the response; the others are revisits that hold the HTTP header only and refer to it.

Null html is empty. Null page_ids are kept, are never referred to while another page has the payload, and count as larger
than all. Rows that repeat the smallest page_id are all responses. A null URL is archived as RFC 6761's
``http://invalid/``. Columns other than page_id, url and html are not read. An empty table gives no records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import store

#: Bytes from which equal payloads are stored once.
LEAST = 100
# Fixed values of the formats.
FIELDS = {
    1: ["url", "ip", "date", "content_type", "length"],
    2: ["url", "ip", "date", "content_type", "result", "checksum", "location", "offset", "filename", "length"],
}
LAYOUT = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes
    truncated: bool = False


def arc_head(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 lexforge\n{LAYOUT[version]}\n".encode()
    more = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {more}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, fields: dict[str, str], block: bytes) -> bytes:
    fields = fields | {"length": str(len(block))}
    return " ".join(fields.get(k, "-") for k in FIELDS[version]).encode() + b"\n" + block + b"\n"


def opened(stream) -> io.BufferedReader:
    """A stream of an archive's bytes, decompressed if it is a gzip file of one member or many."""
    plain = io.BufferedReader(stream, 1 << 18)
    return io.BufferedReader(gzip.GzipFile(fileobj=plain), 1 << 18) if plain.peek(2)[:2] == b"\x1f\x8b" else plain


def parse_arc(data: bytes | io.BufferedReader, version: int = 1) -> Iterator[ArcRecord]:
    """The records of an ARC file, its version block first; ``version`` holds until a version block names one."""
    stream = opened(io.BytesIO(data)) if isinstance(data, bytes) else data
    while line := stream.readline():
        if not line.strip():
            continue
        if line.startswith(b"filedesc:"):  # the block of this record tells the version, and so the fields of this line too
            version = 2 if stream.peek(1)[:1] == b"2" else 1
        names = FIELDS[version]
        parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isascii() or not parts[-1].isdigit():
            continue
        length = int(parts[-1])
        block = stream.read(length)
        yield ArcRecord(dict(zip(names, parts, strict=True)), block, len(block) < length)


def timestamp(date: str) -> str:
    """ISO form of the up to 14 digits of an ARC date."""
    digits = date if date.isascii() and date.isdigit() and len(date) >= 4 else "1970"
    full = digits[:14] + "19700101000000"[len(digits[:14]) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(*parts: str) -> str:
    h = hashlib.sha256("\0".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """(header with its empty line, payload) of an HTTP message; no header if it is none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = b""
    http: dict[str, str] = field(default_factory=dict)

    def bytes(self) -> bytes:
        lines = "".join(f"{k}: {v}\r\n" for k, v in self.headers.items())
        return f"WARC/1.1\r\n{lines}Content-Length: {len(self.block)}\r\n\r\n".encode() + self.block + b"\r\n\r\n"


def convert(record: ArcRecord, refers_to: tuple[str, str] | None = None) -> WarcRecord:
    """The WARC record of an ARC record; with (record id, page) of an equal payload, a revisit of that."""
    f, block = record.fields, record.block
    http, payload = http_parts(block)
    date = timestamp(f["date"])
    kind = "warcinfo" if f["url"].startswith("filedesc:") else "response" if http else "resource"
    digest = hashlib.sha256(payload).hexdigest()
    headers = {"WARC-Type": "revisit" if refers_to else kind, "WARC-Record-ID": record_id(f["url"], date, hashlib.sha256(block).hexdigest()), "WARC-Date": date}
    if kind == "warcinfo":
        headers["WARC-Filename"] = f["url"].removeprefix("filedesc://")
    else:
        headers |= {"WARC-Target-URI": f["url"], "WARC-IP-Address": f["ip"], "WARC-Payload-Digest": f"sha256:{digest}"}
    if record.truncated:
        headers["WARC-Truncated"] = "length"
    if refers_to:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": refers_to[0], "X-Refers-To-Page": refers_to[1]}
        block = http
    headers["WARC-Block-Digest"] = f"sha256:{hashlib.sha256(block).hexdigest()}"
    headers["Content-Type"] = "application/warc-fields" if kind == "warcinfo" else "application/http; msgtype=response" if http else f["content_type"]
    return WarcRecord(headers, block)


def parse_warc(stream: io.BufferedReader) -> Iterator[WarcRecord]:
    """The records of a WARC file."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()).strip():
            name, value = line.decode("utf-8").rstrip("\r\n").split(": ", 1)
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if len(block) < int(headers["Content-Length"]):
            raise ValueError("the file ends within a record")
        http = http_parts(block)[0].decode("utf-8").split("\r\n")[1:]
        yield WarcRecord(headers, block, dict(line.split(": ", 1) for line in http if ": " in line))


def _packed(data: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _response(page: str, html: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page: {page}\r\nContent-Length: {len(html)}\r\n\r\n".encode() + html


def _one_line(url: str | None) -> str:
    url = re.sub(r"[\r\n]", " ", url or "").strip()
    return url if url and not url.startswith("filedesc:") else "http://invalid/"


def page_record(page: str) -> str:
    return record_id("page", page)


def _file(folder: str, part: int, kind: str) -> str:
    return f"{folder}/part-{part:05d}.{kind}"


def _records(folder: str, part: int) -> Iterator[ArcRecord]:
    """The records of an ARC file without its version block."""
    files, path = store.filesystem(_file(folder, part, "arc"))
    with files.open_input_file(path) as f, opened(f) as stream:
        yield from (r for r in parse_arc(stream) if not r.fields["url"].startswith("filedesc:"))


def _page_of(block: bytes) -> str:
    """The page that the HTTP header names."""
    found = re.search(rb"\r\nX-Page: (-?\d*)\r\n", http_parts(block)[0])
    return found[1].decode() if found else ""


def write_arc(pages: DataFrame, folder: str) -> list[int]:
    """Archive ``pages`` (page_id, url, html) in ARC files in ``folder``; the numbers of the files. Versions 1 and 2 take
    turns; of each three files two are compressed record by record."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, pack = 1 + part % 2, bytes if part % 3 == 2 else _packed

        def out(stream) -> None:
            stream.write(pack(arc_head(version, f"part-{part:05d}.arc", "20240101000000")))
            for batch in batches:
                for page, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
                    fields = {"url": _one_line(url.as_py()), "ip": "0.0.0.0", "date": "20240101000000", "content_type": "text/html", "result": "200"}
                    body = html.as_buffer().to_pybytes() if html.is_valid else b""
                    stream.write(pack(arc_record(version, fields, _response("" if not page.is_valid else str(page.as_py()), body))))

        store.commit_file(_file(folder, part, "arc"), out)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32())})

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    return sorted(r.part for r in rows.mapInArrow(archive, "part int").collect())


def _over(spark: SparkSession, parts: list[int]) -> DataFrame:
    """(part): a row and a task for each file."""
    listed = spark.createDataFrame([(k, p) for k, p in enumerate(parts)], "k bigint, part int")
    return spark.range(0, len(parts), 1, len(parts)).join(F.broadcast(listed), F.col("id") == F.col("k")).select("part")  # one row for each file


def revisits(spark: SparkSession, folder: str, parts: list[int]) -> DataFrame:
    """(part, n, refers_to): the records of the ARC files, numbered in each from 0, whose payload is another page's."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("part").to_pylist():
                rows = []
                for n, record in enumerate(_records(folder, part)):
                    payload = http_parts(record.block)[1]
                    if len(payload) >= LEAST:
                        page = _page_of(record.block)
                        rows.append((part, n, int(page) if page else None, hashlib.sha256(payload).digest()))
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "n", "page", "digest"])

    rows = store.written(_over(spark, parts).mapInArrow(digests, "part int, n bigint, page bigint, digest binary"))
    several = rows.groupBy("digest").agg(F.min("page").alias("refers_to"), F.count(F.lit(1)).alias("times")).where("times > 1 and refers_to is not null").drop("times")
    return rows.join(store.bounded(store.written(several)), "digest").where(~F.col("page").eqNullSafe(F.col("refers_to"))).select("part", "n", "refers_to")


def convert_files(spark: SparkSession, folder: str, parts: list[int]) -> None:
    """Write for each ARC file in ``folder`` a WARC file, compressed record by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, again in zip(batch.column("part").to_pylist(), batch.column("again").to_pylist(), strict=True):
                refers = {x["n"]: str(x["refers_to"]) for x in again or []}

                def out(stream, part=part, refers=refers) -> None:
                    files, path = store.filesystem(_file(folder, part, "arc"))
                    n = 0
                    with files.open_input_file(path) as f, opened(f) as legacy:
                        for record in parse_arc(legacy):
                            if record.fields["url"].startswith("filedesc:"):
                                stream.write(_packed(convert(record).bytes()))
                                continue
                            first, page = refers.get(n), _page_of(record.block)
                            made = convert(record, None if first is None else (page_record(first), first))
                            if page:
                                made.headers["WARC-Record-ID"] = page_record(page)
                            stream.write(_packed(made.bytes()))
                            n += 1

                store.commit_file(_file(folder, part, "warc.gz"), out)
            yield batch.select(["part"])

    lists = revisits(spark, folder, parts).groupBy("part").agg(F.collect_list(F.struct("n", "refers_to")).alias("again"))  # of one file each
    _over(spark, parts).join(lists, "part", "left").repartition(len(parts), "part").mapInArrow(run, "part int").count()


def write(pages: DataFrame, folder: str) -> list[int]:
    """Archive ``pages`` in ARC files in ``folder`` and convert these to WARC files; the numbers of the files."""
    parts = write_arc(pages, folder)
    if parts:
        convert_files(pages.sparkSession, folder, parts)
    return parts


def read(spark: SparkSession, folder: str, parts: list[int]) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records in the WARC files of ``folder``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for part in batch.column("part").to_pylist():
                files, path = store.filesystem(_file(folder, part, "warc.gz"))
                with files.open_input_file(path) as f, opened(f) as stream:
                    rows = [_row(r) for r in parse_warc(stream) if r.headers["WARC-Type"] != "warcinfo"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()], strict=True)], names)

    kinds = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    if not parts:
        return spark.createDataFrame([], kinds)
    return _over(spark, parts).mapInArrow(scan, kinds)


def _row(r: WarcRecord) -> tuple:
    page, refers = r.http["X-Page"], r.headers.get("X-Refers-To-Page")
    if r.headers["WARC-Type"] == "revisit":
        size, digest = int(r.http["Content-Length"]), r.headers["WARC-Payload-Digest"].removeprefix("sha256:")
    else:
        payload = http_parts(r.block)[1]
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return int(page) if page else None, size, digest, r.headers["WARC-Type"], None if refers is None else int(refers)


#: The rows of write() and read() over pages.
ORACLE = f"""
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), keyed AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM sized
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lead FROM keyed
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST} AND page_id <> lead THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND page_id <> lead THEN lead END AS refers_to
FROM firsts
"""
