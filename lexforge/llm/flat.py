"""Words of many texts in flat numpy arrays.

A batch of texts is one array of UTF-8 bytes and the offsets of its documents. Runs of bytes of one class (word, space,
digits...) are found by comparing neighbours, and each run gets a 64-bit hash: the sum of a random number for each byte
times a random odd number for its place in the run, mixed. Equal runs have equal hashes; of n different runs two have
the same with a chance of about n * n / 2**65.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; the arrays made for them take about 40 times as much. Longer documents are
#: worked on in slices (``in_slices``).
CHUNK = 1 << 19


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: 0


def give_back() -> None:
    """Return freed memory to the system: workers are used again by later stages, which need it."""
    pa.default_memory_pool().release_unused()
    _libc()(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, giving freed memory back after each batch and at the task's end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        try:
            yield from run(each())
        finally:
            give_back()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = numbers(256, 1)
_PLACE = numbers(256, 2) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = numbers(max(n, 2 * len(_PLACE)), 2) | np.uint64(1)
    return _PLACE


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces_of(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def in_slices(data: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of one text of about ``limit`` bytes each, cut only between a visible ASCII character and ASCII white space;
    a stretch without such a place is one range, however long."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + limit)
        while b < n:
            end = min(n, b + limit)
            before, here = data[b - 1 : end - 1], data[b:end]
            found = np.flatnonzero(SPACE[here] & (before > 32) & (before < 127))
            if len(found):
                b += int(found[0])
                break
            b = end
        yield a, b
        a = b


def portions(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """(first document, end, (bytes, offsets) of them) of runs of at most ``limit`` bytes; a longer document is a run of
    its own, which comes in slices, each as one document."""
    for i, j in pieces_of(offsets, limit):
        own = data[offsets[i] : offsets[j]]
        if len(own) <= limit:
            yield i, j, iter([(own, offsets[i : j + 1] - offsets[i])])
        else:
            yield i, j, ((own[a:b], np.array([0, b - a])) for a, b in in_slices(own, limit))


def runs(classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal classes, which end at documents' ends: run k is bounds[k] to bounds[k + 1]."""
    n = len(classes)
    if not n:
        return np.zeros(1, np.int64)
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(classes[1:], classes[:-1], out=change[1:n])
    change[offsets] = True
    return np.flatnonzero(change)


def run_hashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the runs, which cover the whole of ``data``."""
    if len(bounds) < 2:
        return np.zeros(0, np.uint64)
    lengths = np.diff(bounds)
    places = _places(int(lengths.max()))
    at = np.arange(len(data), dtype=np.int32)
    at -= np.repeat(bounds[:-1].astype(np.int32), lengths)
    with np.errstate(over="ignore"):
        x = _BYTE[data]
        x *= places[at]
        return mix(np.add.reduceat(x, bounds[:-1]) + lengths.astype(np.uint64))


def start_hashes(data: np.ndarray, bounds: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Like run_hashes, of the first n bytes of each run, for each n of the ascending ``sizes``; of the whole run for 0."""
    if len(bounds) < 2:
        return [np.zeros(0, np.uint64)] * len(sizes)
    lengths = np.diff(bounds)
    places = _places(int(lengths.max()))
    at = np.arange(len(data), dtype=np.int32)
    at -= np.repeat(bounds[:-1].astype(np.int32), lengths)
    out = []
    with np.errstate(over="ignore"):
        x = _BYTE[data]
        x *= places[at]
        for n in sorted(sizes, key=lambda n: -(n or 1 << 30)):
            if n:
                x[at >= n] = 0
            out.append(mix(np.add.reduceat(x, bounds[:-1]) + (np.uint64(n << 40) if n else lengths.astype(np.uint64))))
    return [out[k] for k in np.argsort(np.argsort([-(n or 1 << 30) for n in sizes]))]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[k], starts[k] + 1, ... (lengths[k] of them) for each k, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def counts_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the ascending ``starts`` lie in each document."""
    return np.diff(np.searchsorted(starts, offsets))


def byte_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: The bytes that part words in the operators that count or shingle them.
SPACE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters and digits of ASCII, and all bytes of other characters.
ALNUM = byte_table(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
#: Letters of ASCII, and all bytes of other characters.
ALPHA = byte_table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, words in each document) of the runs of bytes for which ``inside`` holds."""
    classes = inside[data]
    bounds = runs(classes, offsets)
    if len(bounds) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    keep = classes[bounds[:-1]]
    starts = bounds[:-1][keep]
    return run_hashes(data, bounds)[keep], starts, bounds[1:][keep], counts_of(starts, offsets)
