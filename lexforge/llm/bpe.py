"""BPE encoding and decoding with a public vocabulary of words with end marks.

Texts are normalised (NFC, lower case) and cut into pieces as the vocabulary's file says. The pieces of a batch that
are not yet in the worker's table are encoded together: the symbols of all of them lie in one flat array, and in each
round every word merges all places of its lowest-rank pair, found by binary search over the sorted pair keys.

Null and empty texts have no ids; their decoded text is empty. Ids need not be unique, repeated rows get a row each, and
columns other than those named are not read. Texts of ASCII and Latin-1 letters are cut by array operations, all others
by a pattern; both give the same pieces. A long text is encoded in slices that end before white space, which always parts
pieces; only its ids (4 bytes each) are held whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexforge.llm import flat
from lexforge.llm.pieces import CLASSES, DIGIT, LOWER, PieceTable, contractions, plain

# Fixed values of the vocabulary's file: white space, and the pattern of pieces.
_WHITE = "".join(map(chr, [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")
_WHITES = regex.compile(f"[{_WHITE}]+")
_NONE = np.int64(1 << 40)


def byte_chars() -> dict[int, str]:
    """The character that stands for each byte: itself if it shows, else one of those from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Bpe:
    """A vocabulary, read from its file, and what a worker has encoded with it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        chars = byte_chars()
        self.first = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[chars[b] + suffix] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, new = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.new = keys[order], order.astype(np.int64), new[order]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        names = {i: s for s, i in (vocab | self.added).items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.table = PieceTable()

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) of the words, by merge rounds over all of them at once."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.first[data]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        while len(symbols):
            key = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[1:] == word[:-1]), self.ranks[at], _NONE)
            begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(np.append(rank, _NONE), begins)
            each = np.repeat(least, np.diff(np.append(begins, len(symbols))))
            if (idle := each == _NONE).any():
                done_symbols.append(symbols[idle])
                done_words.append(word[idle])
            hit = (rank == each[:-1]) & ~idle[:-1]
            follows = np.zeros(len(hit), bool)
            follows[1:] = hit[1:] & hit[:-1] & (word[1:-1] == word[:-2])
            if follows.any():  # a pair of one symbol, twice or more in a row: every other place, from the left
                place = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~follows, place, 0))
                hit &= (place - begin) % 2 == 0
            where = np.flatnonzero(hit)
            symbols[where] = self.new[at[where]]
            keep = ~idle
            keep[where + 1] = False
            symbols, word = symbols[keep], word[keep]
        symbols, word = np.concatenate([*done_symbols, symbols]), np.concatenate([*done_words, word])
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))

    def _new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        special = {i: self.added[p.decode()] for i, p in enumerate(pieces) if p[:1] == b"<" and p.decode(errors="replace") in self.added}
        if not special:
            return self.merge(pieces)
        ids, lengths = self.merge([b"a" if i in special else p for i, p in enumerate(pieces)])
        at = np.cumsum(lengths) - lengths
        for i, x in special.items():  # "a" is a word of one id
            ids[at[i]] = x
        return ids, lengths

    def _pieces(self, text: str) -> list[bytes]:
        out = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.added:
                out.append(part.encode())
            elif part:
                part = _WHITES.sub(" ", unicodedata.normalize("NFC", part))
                out += [p.encode() for p in _PIECE.findall(part.replace("Σ", "σ").lower())]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each document) of the documents in ``data``."""
        usual = plain(data, offsets)
        if usual.all():
            return self._encode_plain(data, offsets)
        whole = np.zeros(len(offsets) - 1, np.int64)
        parts: list = [None] * len(whole)
        edges = np.flatnonzero(np.diff(usual.astype(np.int8))) + 1
        for i, j in zip([0, *edges], [*edges, len(whole)], strict=True):
            a, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            parts[i], whole[i:j] = self._encode_plain(a, o) if usual[i] else self._encode_any(a, o)
        return np.concatenate([p for p in parts if p is not None]), whole

    def _encode_plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        data = LOWER[data]
        classes = CLASSES[data]
        change = np.ones(n + 1, bool)
        if n:
            change[1:n] = (classes[1:] != classes[:-1]) | (classes[1:] == DIGIT)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        change |= edge
        contractions(data, classes, change, edge, bare=False)
        bounds = np.flatnonzero(change)
        if len(bounds) < 2:
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        keep = classes[bounds[:-1]] != 0
        hashes = flat.run_hashes(data, bounds)[keep]
        starts, ends = bounds[:-1][keep], bounds[1:][keep]
        ids, lengths = self.table.encode(hashes, lambda at: self._new([data[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
        return ids, self._by_document(lengths, flat.counts_of(starts, offsets))

    def _encode_any(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces = [self._pieces(data[a:b].tobytes().decode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        each = [p for x in pieces for p in x]
        bounds = np.cumsum([0, *map(len, each)])
        ids, lengths = self.table.encode(flat.run_hashes(np.frombuffer(b"".join(each), np.uint8), bounds), lambda at: self._new([each[k] for k in at.tolist()]))
        return ids, self._by_document(lengths, np.array([len(x) for x in pieces], np.int64))

    @staticmethod
    def _by_document(lengths: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(pieces)])])

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids, in UTF-8: their names parted by one space, as this vocabulary has no decoder."""
        return b" ".join(map(self.names.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


_DECIMAL: list[bytes] = []


def decimals(n: int) -> list[bytes]:
    if len(_DECIMAL) < n:
        _DECIMAL.extend(b"%d" % i for i in range(len(_DECIMAL), n))
    return _DECIMAL


def encoded_parts(encoder, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """(first document, end, ids in one or more arrays, ids of each document) of runs of whole documents; a document that
    is longer than a chunk is a run of its own and is encoded in slices."""
    for i, j, each in flat.portions(data, offsets):
        got = [encoder.encode(*x) for x in each]
        yield i, j, [ids for ids, _ in got], sum(counts for _, counts in got)


#: Ids that are joined to one string at once.
_STEP = 1 << 16


def _digest(ids: np.ndarray, names: list[bytes]) -> str:
    """SHA-256 of the names of ids, parted by one space."""
    h = hashlib.sha256()
    for a in range(0, len(ids), _STEP):
        h.update((b" " if a else b"") + b" ".join(map(names.__getitem__, ids[a : a + _STEP].tolist())))
    return h.hexdigest()


def _round_trip(path: str, others: list[str], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        decimal = decimals(len(bpe.names))
        for batch in batches:
            data, offsets = flat.texts_of(batch.column("text"))
            for i, j, parts, counts in encoded_parts(bpe, data, offsets):
                ids = parts[0] if len(parts) == 1 else np.concatenate(parts)
                ends = np.concatenate([[0], np.cumsum(counts)])
                spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
                columns = [batch.column(c).slice(i, j - i) for c in others]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                columns += [pa.array(counts), pa.array([_digest(ids[a:b], decimal) for a, b in spans], pa.string()), pa.array([_digest(ids[a:b], bpe.names) for a, b in spans], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*others, *(["ids"] if with_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"])

    return flat.released(run)


def _kinds(rows: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in columns)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """The columns of ``docs`` other than text and the new ones, then ids (array of int) and n_tokens of the text, a digest
    of the ids in decimal, and one of the text that is decoded from them. One pass through Python encodes and decodes."""
    new = ("text", "ids", "n_tokens", "ids_sha256", "decoded_sha256")
    others = [c for c in docs.columns if c not in new]
    return docs.select(*others, "text").mapInArrow(_round_trip(path, others, True), f"{_kinds(docs, others)}ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``round_trip``, without the ids."""
    return docs.select("doc_id", "text").mapInArrow(_round_trip(path, ["doc_id"], False), f"{_kinds(docs, ['doc_id'])}n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """The columns of ``docs`` other than text and those of ``round_trip``, then ids and n_tokens of the text."""
    return round_trip(docs, path).drop("ids_sha256", "decoded_sha256")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """The columns of ``rows`` other than ids and text, then text: that of ids (null: null)."""
    others = [c for c in rows.columns if c not in ("text", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = (None if not x.is_valid else bpe.decode(x.values.to_pylist()).decode() for x in batch.column("ids"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string())], [*others, "text"])

    return rows.select(*others, "ids").mapInArrow(flat.released(run), f"{_kinds(rows, others)}text string")
