"""Pre-tokenised pieces of texts, and a bounded table of pieces already encoded."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from lexforge.llm import flat

LETTER, DIGIT, OTHER = 1, 2, 3
#: Class of each byte; bytes of characters beyond ASCII count as letters, which holds for the plain documents below.
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[list(b"\t\n\x0b\x0c\r ")] = 0
CLASSES[48:58] = DIGIT
CLASSES[65:91] = CLASSES[97:123] = CLASSES[128:] = LETTER
#: a-z for A-Z, and the same for the letters of Latin-1 (second bytes 0x80 to 0x9E after 0xC3).
LOWER = flat.LOWER.copy()
LOWER[0x80:0x9F] += 32


def plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents hold only ASCII and letters of Latin-1, and no ``<|``, as special tokens have."""
    odd = (data >= 0x80) & (data != 0xC3)
    lead = np.zeros(len(data), bool)
    lead[1:] = data[:-1] == 0xC3
    odd = (odd & ~lead) | (lead & ((data == 0x97) | (data == 0xB7)))
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    return np.diff(np.searchsorted(np.flatnonzero(odd), offsets)) == 0


def contractions(data: np.ndarray, classes: np.ndarray, change: np.ndarray, edge: np.ndarray, bare: bool) -> None:
    """Join an apostrophe that stands alone to the s, t, m, d, re, ve or ll that follows; ``change`` marks where pieces
    begin, ``edge`` where documents do. bare: not after a space, which then belongs to the apostrophe."""
    n = len(data)
    at = np.flatnonzero((data[:-1] == 39) & change[: n - 1] & (classes[1:] == LETTER) & change[1:n] & ~edge[1:n]) if n else np.zeros(0, np.int64)
    if bare:
        at = at[edge[at] | (data[at - 1] != 32)]
    if not len(at):
        return
    one = np.isin(data[at + 1], list(b"stmd"))
    second = np.minimum(at + 2, n - 1)
    two = (at + 2 < n) & ~change[second] & np.isin(data[at + 1].astype(int) * 256 + data[second], [0x7265, 0x7665, 0x6C6C])
    for hit, length in ((one, 1), (two & ~one, 2)):
        change[at[hit] + 1] = False
        change[at[hit] + 1 + length] = True


class PieceTable:
    """Ids of pieces by the pieces' 64-bit hashes, for as many pieces as ``limit`` with ``most`` ids in all, about 30 MB;
    when it is full it starts anew."""

    def __init__(self, limit: int = 500_000, most: int = 3_000_000):
        self.limit, self.most = limit, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encode(self, hashes: np.ndarray, new: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece) of pieces with these hashes; ``new`` gives them for the pieces at some places."""
        if not len(hashes):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        codes, unique = pd.factorize(hashes)
        known = self._known(unique)
        if len(self.keys) + (~known).sum() > self.limit or len(self.ids) > self.most:
            self.clear()
            known[:] = False
        if not known.all():
            first = np.empty(len(unique), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            ids, lengths = new(first[~known])
            fresh, starts = unique[~known], len(self.ids) + np.cumsum(lengths) - lengths
            order = np.argsort(fresh)
            at = np.searchsorted(self.keys, fresh[order])
            self.keys, self.starts, self.lengths = (np.insert(old, at, own[order]) for old, own in ((self.keys, fresh), (self.starts, starts), (self.lengths, lengths)))
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        at = np.searchsorted(self.keys, unique)
        lengths = self.lengths[at][codes]
        return self.ids[flat.ragged(self.starts[at][codes], lengths)], lengths

    def _known(self, unique: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(unique), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)] == unique
