"""Token ids in flat binary files with 64-bit document offsets, and a reader that maps them into memory.

A store is a folder with, for each range of doc_ids in ascending order,

* ``part-NNNNN.bin``: the ids of its documents, each with the end id, as little-endian unsigned integers of 2 bytes (of 4
  if the vocabulary needs them), and
* ``manifest.json``: the number of parts, the bytes of an id and the end id, and
* ``part-NNNNN.idx``: little-endian signed 64-bit integers: for n documents first n + 1 offsets, in ids, of the documents
  in the whole store, then n doc_ids, then n flags (1: the doc_id is null).

The first job sorts documents by range, encodes and writes ids and the parts' counts; exclusive prefix sums of the counts
(one number for each part) are the parts' bases; the second job writes the offsets. Files are written beside their name
and renamed, so a task that runs again leaves the same whole file.

Pieces are encoded once by the tokenizers library and then taken from a bounded table. That gives what the library gives
for whole texts, as the vocabulary's merges never cross pieces; texts beyond ASCII and Latin-1 letters, or with the form
of a special token, go to the library whole, or, where very long, in slices that end before white space, as no piece spans
a visible character and white space after it. Null and empty texts have the end id alone. Null doc_ids come first; rows
with one doc_id are in the order of a hash of their texts. Other columns are not read, so that their names cannot clash.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import flat, store
from lexforge.llm.pieces import CLASSES, PieceTable, contractions, plain


class Encoder:
    """The tokenizers library with a table of the pieces that it has encoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.table = PieceTable()

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.library.encode_batch(pieces, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each document) of the documents in ``data``."""
        usual = plain(data, offsets)
        parts, counts = [np.zeros(0, np.int64)], np.zeros(len(usual), np.int64)
        edges = np.flatnonzero(np.diff(usual.astype(np.int8))) + 1
        for i, j in zip([0, *edges], [*edges, len(usual)], strict=True) if len(usual) else []:
            a, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if usual[i]:
                ids, counts[i:j] = self._plain(a, o)
            else:
                ids, counts[i:j] = self._new([a[x:y].tobytes().decode() for x, y in zip(o[:-1], o[1:], strict=True)])
            parts.append(ids)
        return np.concatenate(parts), counts

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces: a contraction; letters, digits or other characters, each with one space before them; white space,
        without the last of it if something follows."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
        classes = CLASSES[data]
        change = np.ones(n + 1, bool)
        change[1:n] = classes[1:] != classes[:-1]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        change |= edge
        at = np.flatnonzero(change[1:n] & ~edge[1:n] & (classes[:-1] == 0)) + 1
        contractions(data, classes, change, edge, bare=True)
        change[at - 1] = True
        change[at[data[at - 1] == 32]] = False
        bounds = np.flatnonzero(change)
        hashes = flat.run_hashes(data, bounds)
        ids, lengths = self.table.encode(hashes, lambda k: self._new([data[a:b].tobytes().decode() for a, b in zip(bounds[k].tolist(), bounds[k + 1].tolist(), strict=True)]))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(ends[np.searchsorted(bounds, offsets)])


@functools.lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """The ids with the end id after each document's."""
    out = np.full(len(ids) + len(counts), end, np.int64)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out


def width_of(vocabulary: int, end: int) -> int:
    """The bytes of an id."""
    return 2 if max(vocabulary, end + 1) <= 1 << 16 else 4


def _part(folder: str, part: int, kind: str) -> str:
    return f"{folder}/part-{part:05d}.{kind}"


def write(docs: DataFrame, path: str, folder: str, end: int) -> int:
    """Encode ``docs`` (doc_id, text) with the vocabulary at ``path`` into the store at the URI ``folder``; the number of
    its parts."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the ranges' bounds are sampled keys, which go to the driver: a hash of the text stands for it there
    keyed = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text", "xxhash64(text) as h")
    ordered = keyed.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = load(path), TaskContext.get().partitionId()
        kind = f"<u{width_of(encoder.size, end)}"
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        null: list[np.ndarray] = []

        def out(stream) -> None:
            for batch in batches:
                data, offsets = flat.texts_of(batch.column("text"))
                key = batch.column("doc_id")
                null.append(np.asarray(key.is_null()).astype("<i8"))
                ids.append(np.asarray(key.fill_null(0)).astype("<i8"))
                for _, _, each in flat.portions(data, offsets):
                    parts = [encoder.encode(*x) for x in each]
                    got, n = np.concatenate([x for x, _ in parts]), sum(x for _, x in parts)
                    stream.write(with_end(got, n, end).astype(kind).tobytes())
                    counts.append(n + 1)

        store.commit_file(_part(folder, part, "bin"), out)
        each = np.concatenate([np.zeros(0, np.int64), *counts]).astype("<i8")
        store.commit_file(_part(folder, part, "cnt"), lambda f: f.write(struct.pack("<q", len(each)) + b"".join(x.tobytes() for x in (each, *ids, *null))))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "n_ids": pa.array([int(each.sum())], pa.int64())})

    made = {r.part: r.n_ids for r in ordered.mapInArrow(encode, "part bigint, n_ids bigint").collect()}
    n = max(made, default=-1) + 1
    bases = np.concatenate([[0], np.cumsum([made.get(p, 0) for p in range(n)], dtype=np.int64)]).tolist()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("id").to_pylist():
                files, at = store.filesystem(_part(folder, part, "cnt"))
                with files.open_input_file(at) as f:
                    x = np.frombuffer(f.read(), "<i8")
                starts = bases[part] + np.concatenate([[0], np.cumsum(x[1 : 1 + x[0]])])
                rest = x[1 + x[0] :].tobytes()
                store.commit_file(_part(folder, part, "idx"), lambda f, s=starts, r=rest: f.write(s.astype("<i8").tobytes() + r))
            yield batch

    if n:
        spark.range(0, n, 1, n).mapInArrow(index, "id bigint").count()
    told = json.dumps({"parts": n, "width": width_of(load(path).size, end), "end": end}).encode()
    store.commit_file(f"{folder}/manifest.json", lambda f: f.write(told))
    return n


def manifest(folder: str) -> dict[str, int]:
    """What a store says of itself: parts, width, end."""
    files, path = store.filesystem(f"{folder}/manifest.json")
    with files.open_input_file(path) as f:
        return json.loads(f.read())


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in a store, from its files, mapped into memory where the
    file system can."""
    told = manifest(folder)
    parts, width = told["parts"], told["width"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("id").to_pylist():
                yield _read_part(folder, part, width)

    if not parts:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return spark.range(0, parts, 1, parts).mapInArrow(scan, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def mapped(uri: str, kind: str) -> np.ndarray:
    """The integers in a file, mapped into memory if it is local or on a mounted folder."""
    files, path = store.filesystem(uri)
    if files.type_name == "local":
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def _read_part(folder: str, part: int, width: int) -> pa.RecordBatch:
    index, ids = mapped(_part(folder, part, "idx"), "<i8"), mapped(_part(folder, part, "bin"), f"<u{width}")
    n = (len(index) - 1) // 3
    starts, null = np.array(index[: n + 1]), index[2 * n + 1 :]
    local = (starts - starts[0]).tolist()
    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(local[:-1], local[1:], strict=True)]
    keys = pa.array(np.array(index[n + 1 : 2 * n + 1]), mask=np.array(null).astype(bool))
    return pa.RecordBatch.from_arrays([keys, pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
