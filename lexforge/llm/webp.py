"""Lossless WebP (VP8L): a decoder of the whole bitstream, an encoder, and media columns made with them.

The decoder reads RIFF containers, prefix codes (simple and normal, with groups chosen by an entropy image), literals,
back-references with the two-dimensional distance map, colour caches, and inverts the predictor, cross-colour,
subtract-green and palette transforms (with bundled pixels). Images with one group of codes are decoded by tables and array
operations (``_by_tables``), those with several groups symbol by symbol.

``store`` keeps payloads of bytes as grey images: rows of 64 pixels, at most 16384 of them, the byte in each channel. Each
image has prefix codes of its own and back-references; by its content it takes a palette with bundled pixels (at most 16
different bytes), the predictor of the left neighbour (differences have less entropy than bytes), or neither, and
subtract-green makes red and blue equal. Small images are made and read several at a time, by the same array operations for
all of them, as numpy's cost for each call is most of what a small one takes. Larger payloads are a row of RIFF files. A null text is an empty one: a payload
of 64 zero bytes. Repeated rows get a row each; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexforge.llm import flat

# Fixed values of the format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
CACHE_FACTOR = 0x1E35A7BD
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
SIDE = 16384
BLACK = 0xFF000000


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        a = self.at
        return int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends within its data")

    def read(self, n: int) -> int:
        a = self.at
        self.at = end = a + n
        if end > self.end:
            raise ValueError("the image ends within its data")
        return int.from_bytes(self.data[a >> 3 : (end + 7) >> 3], "little") >> (a & 7) & ((1 << n) - 1)


@functools.cache
def _reversed(n: int) -> np.ndarray:
    """Each number of n bits, its bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


class Code:
    """A canonical prefix code, given by the code length of each symbol, as a table: the next ``most`` bits of a stream
    lead to 16 times the symbol plus the length of its code."""

    def __init__(self, lengths: dict[int, int]):
        self.only = next(iter(lengths)) if len(lengths) == 1 else None
        if self.only is not None:
            self.most, self.table = 0, np.array([self.only << 4])
            return
        if not lengths:
            raise ValueError("a prefix code without symbols")
        order = sorted([n << 16 | s for s, n in lengths.items()])
        self.most = order[-1] >> 16
        each = np.array(order)
        spans = 1 << self.most - (each >> 16)
        if spans.sum() != 1 << self.most:
            raise ValueError("the prefix code is not complete")
        self.table = np.repeat((each & 0xFFFF) << 4 | each >> 16, spans).take(_reversed(self.most))

    @functools.cached_property
    def entries(self) -> list[int]:
        return self.table.tolist()

    def read(self, bits: Bits) -> int:
        entry = self.entries[bits.peek(self.most)]
        bits.skip(entry & 15)
        return entry >> 4


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        symbols += [bits.read(8)] if two else []
        return Code(dict.fromkeys(symbols, 1))
    lengths, several = {}, 4 + bits.read(4)
    each = bits.read(3 * several)
    for symbol in CODE_LENGTH_ORDER[:several]:
        if each & 7:
            lengths[symbol] = each & 7
        each >>= 3
    of_lengths = Code(lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    out: dict[int, int] = {}
    symbol, last = 0, 8
    entries, mask, ahead = of_lengths.entries, (1 << of_lengths.most) - 1, bits.peek(14 * size)
    used = 0
    while symbol < size and left:
        left -= 1
        entry = entries[ahead & mask]
        ahead >>= entry & 15
        used += entry & 15
        x = entry >> 4
        if x < 16:
            if x:
                out[symbol] = last = x
            symbol += 1
            continue
        n, extra = (3, 2) if x == 16 else (3, 3) if x == 17 else (11, 7)
        n += ahead & ((1 << extra) - 1)
        ahead >>= extra
        used += extra
        if x == 16:
            out |= dict.fromkeys(range(symbol, symbol + n), last)
        symbol += n
    bits.skip(used)
    if symbol > size:
        raise ValueError("more code lengths than symbols")
    return Code(out or {0: 0})


def _far(bits: Bits, prefix: int) -> int:
    """The length or distance code that a prefix and its extra bits stand for."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _blocks(n: int, size: int) -> int:
    return (n + (1 << size) - 1) >> size


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image, as ARGB numbers, one row after the other."""
    return _pixels(bits, width, height, *_head_of(bits, width, height, main))


def _head_of(bits: Bits, width: int, height: int, main: bool) -> tuple[int, np.ndarray | None, int, list[list[Code]]]:
    """(cache bits, groups of the blocks, block size bits, prefix codes of each group)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, choose, size = 1, None, 0
    if main and bits.read(1):
        size = bits.read(3) + 2
        choose = (read_pixels(bits, _blocks(width, size), _blocks(height, size), False) >> 8) & 0xFFFF
        groups = int(choose.max()) + 1
    codes = [[read_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    return cache_bits, choose, size, codes


def _pixels(bits: Bits, width: int, height: int, cache_bits: int, choose: np.ndarray | None, size: int, codes: list[list[Code]]) -> np.ndarray:
    n, (green, *rest) = width * height, codes[0]
    if len(codes) == 1 and (whole := _by_tables(bits, width, n, cache_bits, codes[0])) is not None:
        return whole
    out, cache, k, across = [0] * n, [0] * (1 << cache_bits), 0, _blocks(width, size)

    def put(pixel: int) -> None:
        nonlocal k
        out[k] = pixel
        k += 1
        if cache_bits:
            cache[(pixel * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel

    while k < n:
        if choose is not None:
            y, x = divmod(k, width)
            green, *rest = codes[int(choose[(y >> size) * across + (x >> size)])]
        s = green.read(bits)
        if s < 256:
            red = rest[0].read(bits)
            blue = rest[1].read(bits)
            put(rest[2].read(bits) << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            length = _far(bits, s - 256)
            distance = _far(bits, rest[3].read(bits))
            if distance > 120:
                distance -= 120
            else:
                dx, dy = NEAR[distance - 1]
                distance = max(1, dx + dy * width)
            if distance > k or length > n - k:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                put(out[k - distance])
        else:
            put(cache[s - 280])
    return np.array(out, np.uint32)


#: Bytes of a stream whose bit positions are looked up at once.
WINDOW = 1 << 13
_EIGHT = np.arange(8)
#: Extra bits of a length or distance prefix, and the least number that it stands for.
_EXTRA = np.array([0, 0] + [(p - 2) >> 1 for p in range(2, 40)])
_LEAST = np.array([1, 2] + [((2 + (p & 1)) << ((p - 2) >> 1)) + 1 for p in range(2, 40)])
#: By 16 times a prefix plus the length of its code: the bits of code and extra bits together.
_SPAN = (np.arange(16) + _EXTRA[:, None]).ravel()


@functools.lru_cache(64)
def _near(width: int) -> np.ndarray:
    """The distances that the codes from 1 to 120 stand for."""
    return np.array([max(1, x + y * width) for x, y in NEAR])


def _by_tables(bits: Bits, width: int, n: int, cache_bits: int, codes: list[Code]) -> np.ndarray | None:
    """The n pixels of an image with one group of codes.

    A token's length in bits is looked up at every bit of a window, as if a token began there; then the tokens that do
    begin there are walked from one to the next. References and cache hits become the place of an earlier pixel, and
    places are followed back to literals, all pixels at once. None, with nothing read, for two odd streams: one whose only
    green symbol is no literal, and hits on a cache entry that nothing was put into.
    """
    green, red, blue, alpha, far = codes
    colours = ((red, 16), (blue, 0), (alpha, 24))
    if green.only is not None:
        if green.only >= 256:
            return None
        if all(c.only is not None for c, _ in colours):
            return np.full(n, green.only << 8 | sum(c.only << shift for c, shift in colours), np.uint32)
    plain = sum(c.only << shift for c, shift in colours if c.only is not None)
    data, at, found, parts = bits.data + bytes(48), bits.at, 0, []
    longest = green.most + max(red.most + blue.most + alpha.most, far.most + 32)
    while found < n:
        first = at >> 3
        size = min(WINDOW, (n - found) * longest // 8 + 2, len(bits.data) - first)
        if size <= 0:
            raise ValueError("the image ends within its data")
        words = np.ndarray((size,), "<u4", data, first, (1,))
        wide = np.ndarray((size + 24,), "<u8", data, first, (1,))

        def ahead(p: np.ndarray, m, wide=wide) -> np.ndarray:
            return (wide[p >> 3] >> (p & 7).astype(np.uint64)).astype(np.int64) & ((1 << m) - 1)

        entry = green.table.take(((words.astype(np.int64)[:, None] >> _EIGHT) & ((1 << green.most) - 1)).ravel())
        length = entry & 15
        copies = np.flatnonzero(entry >= 256 << 4)
        if cache_bits:
            copies = copies[entry[copies] < 280 << 4]
        value = None
        if any(c.only is None for c, _ in colours):
            literals = np.flatnonzero(entry < 256 << 4)
            p, value = literals + length[literals], entry >> 4
            value[literals] = value[literals] << 8 | plain
            for c, shift in colours:
                if c.only is None:
                    e = c.table[ahead(p, c.most)]
                    p = p + (e & 15)
                    value[literals] |= e >> 4 << shift
            length[literals] = p - literals
        if len(copies):
            p = copies + _SPAN.take(entry[copies] - (256 << 4))
            length[copies] = p + _SPAN.take(far.table.take(ahead(p, far.most))) - copies
        after = np.empty(8 * size + 1, np.int64)
        np.minimum(np.arange(8 * size) + length, 8 * size, out=after[:-1])
        after[-1] = 8 * size
        begun = _walk(after, at - 8 * first)
        kind = entry[begun] >> 4
        counts, places = np.ones(len(begun), np.int64), np.zeros(len(begun), np.int64)
        values = value[begun] if value is not None else kind << 8 | plain
        own = np.flatnonzero((kind >= 256) & (kind < 280))
        if len(own):
            prefix, p = kind[own] - 256, begun[own]
            extra, p = _EXTRA[prefix], p + (entry[p] & 15)
            counts[own] = _LEAST[prefix] + ahead(p, extra)
            p = p + extra
            e = far.table[ahead(p, far.most)]
            p, prefix = p + (e & 15), e >> 4
            d = _LEAST[prefix] + ahead(p, _EXTRA[prefix])
            places[own] = np.where(d > 120, d - 120, _near(width)[np.minimum(d, 120) - 1])
        if cache_bits:
            hit = kind >= 280
            places[hit], values[hit] = -1, kind[hit] - 280
        ends = found + np.cumsum(counts)
        last = int(np.searchsorted(ends, n))
        if last < len(begun) and ends[last] > n:
            raise ValueError("a back-reference leaves the image")
        parts.append((counts[: last + 1], places[: last + 1], values[: last + 1]))
        last = min(last, len(begun) - 1)
        found, at = int(ends[last]), 8 * first + int(begun[last] + length[begun[last]])
        if at > 8 * len(bits.data):
            raise ValueError("the image ends within its data")
    counts, places, values = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not places.any():
        out = values.astype(np.uint32)
    elif (out := _resolved(n, counts, places, values, cache_bits)) is None:
        return None
    bits.at = at
    return out


def _walk(after: np.ndarray, at: int) -> np.ndarray:
    """at, after[at], after[after[at]] and so on, up to the last place, which leads to itself and is left out. In a long array,
    only each fourth step is taken by itself; those between are looked up for all."""
    end, path, jumps = len(after) - 1, [], [after]
    if end > 512:
        jumps.append(after.take(after))
        jumps.append(jumps[1].take(jumps[1]))
    each = memoryview(jumps[-1])
    while at < end:
        path.append(at)
        at = each[at]
    out = np.array(path, np.int64)
    for jump in reversed(jumps[:-1]):
        out = np.stack([out, jump.take(out)], 1).ravel()
    return out[: np.searchsorted(out, end)]


def _resolved(n: int, counts: np.ndarray, places: np.ndarray, values: np.ndarray, cache_bits: int) -> np.ndarray | None:
    """Pixels of tokens. places: 0 for literals, the distance for references, -1 for cache hits (values: the entry)."""
    begin = np.cumsum(counts) - counts
    if (places > begin).any():
        raise ValueError("a back-reference leaves the image")
    literal = places == 0
    out = np.zeros(n, np.uint32)
    out[begin[literal]] = values[literal]
    source = _followed(np.arange(n) - np.repeat(np.maximum(places, 0), counts))
    if len(hits := begin[places < 0]):
        entry = np.zeros(n, np.int64)
        entry[begin[literal]] = (values[literal] * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)
        entry[hits] = values[places < 0]
        entry = entry[source]
        order = np.argsort(entry, kind="stable")
        before = np.full(n, -1)
        before[order[1:]] = np.where(entry[order[1:]] == entry[order[:-1]], order[:-1], -1)
        if (before[hits] < 0).any():
            return None
        source[hits] = before[hits]
        source = _followed(source)
    return out[source]


def _followed(source: np.ndarray) -> np.ndarray:
    while True:
        further = source[source]
        if (further == source).all():
            return source
        source = further


def _split(x: np.ndarray) -> np.ndarray:
    """(..., 4) of alpha, red, green and blue."""
    return np.stack([(x >> s) & 0xFF for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _join(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint32) & 0xFF
    return x[..., 0] << 24 | x[..., 1] << 16 | x[..., 2] << 8 | x[..., 3]


def predict(mode: int, left: list[int], top: list[int], right: list[int], corner: list[int]) -> list[int]:
    """The predicted channels of a pixel from its neighbours: left, above, above right and above left."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: min(255, max(0, v))
    match mode:
        case 1: return left
        case 2: return top
        case 3: return right
        case 4: return corner
        case 5: return half(half(left, right), top)
        case 6: return half(left, corner)
        case 7: return half(left, top)
        case 8: return half(corner, top)
        case 9: return half(top, right)
        case 10: return half(half(left, corner), half(top, right))
        case 11:
            to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
            to_top = sum(abs(a - c) for a, c in zip(left, corner, strict=True))
            return left if to_left < to_top else top
        case 12: return [clamp(a + t - c) for a, t, c in zip(left, top, corner, strict=True)]
        case 13: return [clamp(m + int((m - c) / 2)) for m, c in zip(half(left, top), corner, strict=True)]
    return [255, 0, 0, 0]


def _predicted(pixels: list[list[int]], k: int, width: int, modes: np.ndarray, size: int) -> list[int]:
    y, x = divmod(k, width)
    if not k:
        return [255, 0, 0, 0]
    if not y:
        return pixels[k - 1]
    if not x:
        return pixels[k - width]
    mode = int(modes[y >> size, x >> size])
    return predict(mode, pixels[k - 1], pixels[k - width], pixels[k - width + 1], pixels[k - width - 1])


def undo_predictor(argb: np.ndarray, width: int, modes: np.ndarray, size: int) -> np.ndarray:
    if (modes == 1).all():  # sums down the first column, then along each row
        x = _split(argb.reshape(-1, width))
        x[0, 0] += [255, 0, 0, 0]
        x[:, 0] = np.cumsum(x[:, 0], 0)
        return _join(np.cumsum(x, 1)).ravel()
    out = _split(argb).tolist()
    for k, residual in enumerate(out):
        out[k] = [(r + p) & 255 for r, p in zip(residual, _predicted(out, k, width, modes, size), strict=True)]
    return _join(np.array(out))


def cross_colour(argb: np.ndarray, width: int, factors: np.ndarray, size: int, sign: int) -> np.ndarray:
    """Add (sign 1) to red and blue, or take from them (-1), what the block's factors tell of green and red."""
    x = _split(argb.reshape(-1, width))
    rows, columns = np.arange(x.shape[0]) >> size, np.arange(width) >> size
    f = _split(factors)[rows[:, None], columns[None, :]]
    byte = lambda v: (v & 255) - 2 * (v & 128)
    delta = lambda t, c: (byte(t) * byte(c)) >> 5
    red = x[..., 1] + sign * delta(f[..., 3], x[..., 2])
    true_red = red if sign > 0 else x[..., 1]
    blue = x[..., 3] + sign * (delta(f[..., 2], x[..., 2]) + delta(f[..., 1], true_red))
    return _join(np.stack([x[..., 0], red, x[..., 2], blue], -1)).ravel()


def add_green(argb: np.ndarray) -> np.ndarray:
    both = (argb & np.uint32(0xFF00FF)) + ((argb >> 8) & 0xFF) * np.uint32(0x10001)
    return (argb & np.uint32(0xFF00FF00)) | (both & np.uint32(0xFF00FF))


def bundle_bits(colours: int) -> int:
    """log2 of the palette indexes in one pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(argb: np.ndarray, width: int, table: np.ndarray) -> np.ndarray:
    bits = bundle_bits(len(table))
    index = ((argb >> 8) & 0xFF).reshape(-1, _blocks(width, bits))
    if bits:
        each = 8 >> bits
        x = np.arange(width)
        index = (index[:, x >> bits] >> (each * (x & ((1 << bits) - 1))).astype(np.uint32)) & ((1 << each) - 1)
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index].ravel()


def _transforms(bits: Bits, width: int, height: int) -> tuple[list[tuple], int]:
    """What to invert, in the order of the file, and the width of the image that follows."""
    undo, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            side = read_pixels(bits, _blocks(now, size), _blocks(height, size), False).reshape(_blocks(height, size), -1)
            undo.append((kind, now, side, size))
        elif kind == PALETTE:
            colours = bits.read(8) + 1
            table = _join(np.cumsum(_split(read_pixels(bits, colours, 1, False)), 0))
            undo.append((kind, now, table, 0))
            now = _blocks(now, bundle_bits(colours))
        else:
            undo.append((kind, now, None, 0))
    return undo, now


def _opened(data: bytes) -> tuple[Bits, list[tuple], int, int, tuple]:
    """(where its pixels begin, transforms, width in the file, height, ``_head_of``) of a RIFF file or bare bitstream."""
    if data[:4] == b"RIFF":
        at = 12
        while data[at : at + 4] != b"VP8L":
            at += 8 + struct.unpack("<I", data[at + 4 : at + 8])[0] + 1 & ~1
            if at + 8 > len(data):
                raise ValueError("no lossless image")
        data = data[at + 8 : at + 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]]
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, now = _transforms(bits, width, height)
    return bits, undo, now, height, _head_of(bits, now, height, True)


def decode(data: bytes) -> np.ndarray:
    """The pixels, as ARGB numbers in rows, of one RIFF file or bare VP8L bitstream."""
    return decode_all([data])[0]


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """``decode`` of each. Small images that differ in green only before their transforms are inverted are read together."""
    images = [_opened(data) for data in files]
    small = [k for k, (bits, _, _, _, head) in enumerate(images) if bits.end < 8 * WINDOW and _only_green(*head)]
    out: list = [None] * len(files)
    if len(small) > 1:
        for k, pixels in zip(small, _small_by_tables([images[k] for k in small]), strict=True):
            out[k] = pixels
    for k, (bits, undo, now, height, head) in enumerate(images):
        pixels = _pixels(bits, now, height, *head) if out[k] is None else out[k]
        for kind, across, side, size in reversed(undo):
            if kind == PREDICTOR:
                pixels = undo_predictor(pixels, across, (side >> 8) & 15, size)
            elif kind == CROSS_COLOUR:
                pixels = cross_colour(pixels, across, side, size, 1)
            elif kind == PALETTE:
                pixels = undo_palette(pixels, across, side)
            else:
                pixels = add_green(pixels)
        out[k] = pixels.reshape(height, -1)
    return out


def _only_green(cache_bits: int, choose: np.ndarray | None, size: int, codes: list[list[Code]]) -> bool:
    green, *colours, _ = codes[0]
    return not cache_bits and len(codes) == 1 and green.only is None and all(c.only is not None for c in colours)


#: Bytes between the data of images that are read together: more than those of any token.
_GAP = 12


def _small_by_tables(images: list[tuple]) -> list[np.ndarray]:
    """``_by_tables`` of several images at once, each ``_only_green`` and read in one window. In the walk from token to token,
    the gap after each one's data leads to the first token of the next."""
    parts = [bits.data[bits.at >> 3 :] for bits, *_ in images]
    data = (b"\0" * _GAP).join([*parts, b"", b"", b""])
    lengths = np.array([len(part) + _GAP for part in parts])
    size, stops = int(lengths.sum()), 8 * (np.cumsum(lengths) - _GAP)
    starts = stops - 8 * (lengths - _GAP) + [bits.at & 7 for bits, *_ in images]
    pixels = np.array([now * height for _, _, now, height, _ in images])
    greens, fars = [head[3][0][0] for *_, head in images], [head[3][0][4] for *_, head in images]
    plain = np.array([red.only << 16 | blue.only | alpha.only << 24 for _, red, blue, alpha, _ in (head[3][0] for *_, head in images)])
    words = np.ndarray((size,), "<u4", data, 0, (1,)).astype(np.int64)[:, None]
    wide = np.ndarray((size + 16,), "<u8", data, 0, (1,))
    of_byte = np.repeat(np.arange(len(images)), lengths)

    def ahead(p: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return (wide[p >> 3] >> (p & 7).astype(np.uint64)).astype(np.int64) & mask

    entry, after = np.empty((size, 8), np.int64), np.arange(8 * size + 1)
    for code, b, n in zip(greens, np.cumsum(lengths).tolist(), lengths.tolist(), strict=True):
        index = words[b - n : b] >> _EIGHT
        index &= (1 << code.most) - 1
        code.table.take(index, out=entry[b - n : b], mode="clip")
    entry = entry.ravel()
    copies = np.flatnonzero(entry >= 256 << 4)
    base = np.cumsum([0, *(len(c.table) for c in fars[:-1])])
    mask, table = np.array([(1 << c.most) - 1 for c in fars]), np.concatenate([c.table for c in fars])
    p, own = copies + _SPAN.take(entry[copies] - (256 << 4)), of_byte[copies >> 3]
    p += _SPAN.take(table.take(ahead(p, mask[own]) + base[own]))
    after[:-1] += entry & 15
    after[copies] = p
    after[stops[:, None] + np.arange(8 * _GAP)] = np.array([*starts[1:], 8 * size])[:, None]
    begun = _walk(after, int(starts[0]))
    image = of_byte[begun >> 3]
    real = np.flatnonzero(begun < stops[image])
    begun, image = begun[real], image[real]
    kind = entry[begun] >> 4
    counts, places = np.ones(len(begun), np.int64), np.zeros(len(begun), np.int64)
    if len(copies := np.flatnonzero(kind >= 256)):
        prefix, p, own = kind[copies] - 256, begun[copies], image[copies]
        extra, p = _EXTRA[prefix], p + (entry[p] & 15)
        counts[copies] = _LEAST[prefix] + ahead(p, (1 << extra) - 1)
        p += extra
        e = table[ahead(p, mask[own]) + base[own]]
        p, prefix = p + (e & 15), e >> 4
        d = _LEAST[prefix] + ahead(p, (1 << _EXTRA[prefix]) - 1)
        near = np.stack([_near(now) for _, _, now, _, _ in images])
        places[copies] = np.where(d > 120, d - 120, near[own, np.minimum(d, 120) - 1])
    ends = np.cumsum(counts)
    tokens = np.bincount(image, minlength=len(images))
    if not tokens.all():
        raise ValueError("the image ends within its data")
    first = np.cumsum(tokens) - tokens
    ends -= np.repeat(ends[first] - counts[first], tokens)
    needed = np.flatnonzero(ends - counts < pixels[image])
    last = np.cumsum(np.bincount(image[needed], minlength=len(images))) - 1
    begun, counts, places, ends, image, kind = (v[needed] for v in (begun, counts, places, ends, image, kind))
    if (ends[last] > pixels).any() or (places > ends - counts).any():
        raise ValueError("a back-reference leaves the image")
    if (ends[last] < pixels).any() or (after[begun[last]] > stops).any():
        raise ValueError("the image ends within its data")
    values = kind << 8 | plain[image]
    out = _resolved(int(pixels.sum()), counts, places, values, 0) if places.any() else values.astype(np.uint32)
    return np.split(out, np.cumsum(pixels)[:-1])


@functools.lru_cache(1 << 14)
def _digits(value: int, n: int) -> str:
    return f"{value:0{n}b}"[::-1] if n else ""


class Writer:
    """Writes bits, least significant first."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def put(self, value: int, n: int) -> None:
        self.parts.append(_digits(value, n))

    def code(self, value: int, n: int) -> None:
        self.parts.append(f"{value:0{n}b}" if n else "")

    def array(self) -> np.ndarray:
        return np.frombuffer("".join(self.parts).encode(), np.uint8) - 48


def code_lengths(counts: dict[int, int], most: int = 15) -> dict[int, int]:
    """Lengths of a Huffman code of at most ``most`` bits; small counts are raised until it fits."""
    m, floor = len(counts), 1
    if m < 2:
        return dict.fromkeys(counts or [0], 0)
    never = sum(counts.values()) + 1 << most + 1
    while True:
        order = sorted([(n if n > floor else floor) << 16 | s for s, n in counts.items()])
        leaves, inner, above, i, j = [x >> 16 for x in order], [never] * m, [0] * (2 * m - 1), 0, 0
        leaves.append(never)
        for k in range(m - 1):  # the two least weights, leaves first
            if leaves[i] <= inner[j]:
                total = leaves[i]
                above[i] = m + k
                i += 1
            else:
                total = inner[j]
                above[m + j] = m + k
                j += 1
            if leaves[i] <= inner[j]:
                inner[k] = total + leaves[i]
                above[i] = m + k
                i += 1
            else:
                inner[k] = total + inner[j]
                above[m + j] = m + k
                j += 1
        depth = [0] * (2 * m - 1)
        for k in range(2 * m - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth) <= most:
            return {x & 0xFFFF: n for x, n in zip(order, depth, strict=False)}
        floor *= 2


def write_code(out: Writer, lengths: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """Write a prefix code; (code, length) of each symbol."""
    return canonical_codes(write_lengths(out, lengths, size))


def write_lengths(out: Writer, lengths: dict[int, int], size: int) -> dict[int, int]:
    """Write a prefix code; the length of each symbol's code as it is read, which is 0 for a single symbol."""
    if len(lengths) == 1 and min(lengths) < 256:
        out.put(5 | min(lengths) << 3, 11)
        return dict.fromkeys(lengths, 0)
    if len(lengths) == 1:  # a code for one symbol beyond 255 needs a second symbol
        lengths = {0: 1, **dict.fromkeys(lengths, 1)}
    each = np.zeros(size, np.int64)
    each[list(lengths)] = list(lengths.values())
    tokens = _runs(each)
    of = code_lengths(Counter([v for v, _, _ in tokens]), 7)
    if len(of) == 1:
        of = {**dict.fromkeys(of, 1), (0 if min(of) else 1): 1}
    out.put(0, 1)
    order = [of.get(s, 0) for s in CODE_LENGTH_ORDER]
    n = len(order)
    while n > 4 and not order[n - 1]:
        n -= 1
    out.put(n - 4, 4)
    out.parts += [_digits(v, 3) for v in order[:n]]
    out.put(0, 1)
    codes = {v: f"{code:0{n}b}" for v, (code, n) in canonical_codes(of).items()}
    out.parts += [codes[v] + _digits(extra, bits) if bits else codes[v] for v, extra, bits in tokens]
    return lengths


#: A code length that is written as such.
_PLAIN = [(v, 0, 0) for v in range(16)]


def _runs(each: np.ndarray) -> list[tuple[int, int, int]]:
    """Code lengths as (token, extra bits, their number): a length, or 16 to 18 for a run."""
    out = []
    edges = [0, *(np.flatnonzero(each[1:] != each[:-1]) + 1).tolist(), len(each)]
    for v, a, b in zip(each[edges[:-1]].tolist(), edges, edges[1:], strict=False):
        n = b - a
        if v:
            out.append(_PLAIN[v])
            n -= 1
        while n >= 3:
            m = min(n, 138 if not v else 6)
            out.append((16, m - 3, 2) if v else (18, m - 11, 7) if m >= 11 else (17, m - 3, 3))
            n -= m
        if n:
            out += [_PLAIN[v]] * n
    return out


def canonical_codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    out, code, last = {}, 0, 0
    for length, symbol in sorted((n, s) for s, n in lengths.items()):
        code <<= length - last
        last = length
        out[symbol] = (code, length)
        code += 1
    return out


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits, their number) of a length or distance code."""
    value -= 1
    if value < 4:
        return value, 0, 0
    high = value.bit_length() - 1
    extra = high - 1
    return 2 * high + (value >> extra & 1), value & ((1 << extra) - 1), extra


def write_pixels(out: Writer, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool = False, groups: int = 0) -> None:
    """Entropy-code an image. groups: the size bits of blocks that take one of two groups of codes in turn; 0 for one group."""
    pixels, tokens, cache, seen, k = argb.tolist(), [], [None] * (1 << cache_bits), {}, 0
    while k < len(pixels):
        length = distance = 0
        if references and (j := seen.get(tuple(pixels[k : k + 3]))) is not None:
            while k + length < len(pixels) and length < 4096 and pixels[j + length] == pixels[k + length]:
                length += 1
            distance = k - j
        place = (pixels[k] * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if length >= 3:
            near = next((i + 1 for i, (dx, dy) in enumerate(NEAR) if max(1, dx + dy * width) == distance), distance + 120)
            tokens.append((k, 256 + prefix_of(length)[0], length, near))
        elif cache_bits and cache[place] == pixels[k]:
            tokens.append((k, 280 + place, 0, 0))
            length = 1
        else:
            tokens.append((k, (pixels[k] >> 8) & 255, 0, 0))
            length = 1
        for i in range(k, k + length):
            if cache_bits:
                cache[(pixels[i] * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[i]
            seen[tuple(pixels[i : i + 3])] = i
        k += length
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    of, several = lambda k: 0, 1
    if main:
        out.put(1 if groups else 0, 1)
        if groups:
            out.put(groups - 2, 3)
            across, down = _blocks(width, groups), _blocks(len(pixels) // width, groups)
            of = lambda k: ((k // width >> groups) + (k % width >> groups)) & 1
            choice = np.array([(y + x) & 1 for y in range(down) for x in range(across)], np.uint32)
            write_pixels(out, choice << 8, across, False)
            several = int(choice.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[Counter() for _ in sizes] for _ in range(several)]
    channel = lambda k: (pixels[k] >> 16 & 255, pixels[k] & 255, pixels[k] >> 24)
    for k, s, _, near in tokens:
        c = counts[of(k)]
        c[0][s] += 1
        if s < 256:
            for i, v in enumerate(channel(k)):
                c[1 + i][v] += 1
        elif s < 280:
            c[4][prefix_of(near)[0]] += 1
    codes = [[write_code(out, code_lengths(c or Counter([0])), n) for c, n in zip(group, sizes, strict=True)] for group in counts]
    for k, s, length, near in tokens:
        c = codes[of(k)]
        out.code(*c[0][s])
        if s < 256:
            for i, v in enumerate(channel(k)):
                out.code(*c[1 + i][v])
        elif s < 280:
            out.put(*prefix_of(length)[1:])
            prefix, extra, n = prefix_of(near)
            out.code(*c[4][prefix])
            out.put(extra, n)


def _head(width: int, height: int) -> Writer:
    out = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    return out


def _riff(data: bytes) -> bytes:
    padded = data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + padded


def encode(argb: np.ndarray, transforms: list[tuple] = (), cache_bits: int = 0, references: bool = False, groups: int = 0) -> bytes:
    """A RIFF file of the pixels (ARGB numbers in rows). transforms, in the order in which they are applied: (PREDICTOR,
    modes, size bits), (CROSS_COLOUR, factors, size bits), (SUBTRACT_GREEN,), (PALETTE,)."""
    height, width = argb.shape
    out, now, x = _head(width, height), width, argb.ravel().astype(np.uint32)
    for kind, *rest in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind == PREDICTOR:
            modes, size = rest
            own = _split(x).tolist()
            residual = [[(a - b) & 255 for a, b in zip(own[k], _predicted(own, k, now, modes, size), strict=True)] for k in range(len(own))]
            x = _join(np.array(residual))
            out.put(size - 2, 3)
            write_pixels(out, modes.astype(np.uint32).ravel() << 8 | np.uint32(BLACK), modes.shape[1], False)
        elif kind == CROSS_COLOUR:
            factors, size = rest
            x = cross_colour(x, now, factors, size, -1)
            out.put(size - 2, 3)
            write_pixels(out, factors.ravel(), factors.shape[1], False)
        elif kind == SUBTRACT_GREEN:
            green = (x >> 8) & 0xFF
            x = (x & np.uint32(0xFF00FF00)) | ((((x >> 16) - green) & 0xFF) << 16) | ((x - green) & 0xFF)
        else:
            table, index = np.unique(x, return_inverse=True)
            out.put(len(table) - 1, 8)
            write_pixels(out, _join(np.diff(_split(table), axis=0, prepend=0)), len(table), False)
            bits = bundle_bits(len(table))
            wide = np.zeros((height, _blocks(now, bits) << bits), np.uint32)
            wide[:, :now] = index.reshape(height, now)
            now = _blocks(now, bits)
            shifts = (np.arange(1 << bits) * (8 >> bits)).astype(np.uint32)
            x = ((wide.reshape(height, now, 1 << bits) << shifts).sum(2).astype(np.uint32) << 8 | np.uint32(BLACK)).ravel()
    out.put(0, 1)
    write_pixels(out, x, now, True, cache_bits, references, groups)
    return _riff(np.packbits(out.array(), bitorder="little").tobytes())


#: Most bits of a prefix code in a stored image, which keeps the decoder's tables small.
CODE_BITS = 12
#: References shorter than this cost more than the literals that they replace.
LEAST_RUN = 5


@functools.cache
def _near_codes() -> np.ndarray:
    """The distance code of each distance that the map of near pixels has, by log2 of the width (at most 64) and distance;
    0 for others."""
    out = np.zeros((7, 7 * 64 + 9), np.int64)
    for bits in range(7):
        for code in range(len(NEAR), 0, -1):
            x, y = NEAR[code - 1]
            out[bits, max(1, x + (y << bits))] = code
    return out


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``prefix_of`` of an array."""
    prefix = np.searchsorted(_LEAST, values, side="right") - 1
    return prefix, values - _LEAST[prefix], _EXTRA[prefix]


def _references(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A greedy parse of streams of these sizes (4 at least), which ``x`` holds one after the other: the first byte of each
    token, which tokens are references, and their lengths and distances. A byte's candidate is the last place in its stream
    where its four bytes came before; it goes on while the bytes that follow have a candidate at the same distance."""
    n, ends = len(x), np.cumsum(sizes)
    words = np.ndarray((n - 3,), "<u4", np.ascontiguousarray(x), 0, (1,))
    keys = words.astype(np.int64) << 32 | np.arange(n - 3)
    keys.sort()
    high = keys >> 32
    same = np.flatnonzero(high[1:] == high[:-1])
    later, earlier = keys[same + 1] & 0xFFFFFFFF, keys[same] & 0xFFFFFFFF
    if len(sizes) > 1:  # both in one stream, and so their bytes
        own = np.flatnonzero((earlier >= np.repeat(ends - sizes, sizes)[later]) & (later < np.repeat(ends - 3, sizes)[later]))
        later, earlier = later[own], earlier[own]
    back = np.zeros(n, np.int64)
    back[later] = later - earlier
    begin = np.flatnonzero(back)
    distance = back[begin]
    edges = np.flatnonzero((begin[1:] != begin[:-1] + 1) | (distance[1:] != distance[:-1])) + 1
    edges = np.concatenate([[0], edges, [len(begin)]]) if len(begin) else np.zeros(1, np.int64)
    run = np.minimum(np.repeat(begin[edges[1:] - 1] + 4, edges[1:] - edges[:-1]) - begin, 4096)
    some = np.flatnonzero(run >= LEAST_RUN)
    begin = begin[some]
    taken = _walk(np.append(np.searchsorted(begin, begin + run[some]), len(begin)), 0)
    begin, run, distance = begin[taken], run[some[taken]], distance[some[taken]]
    inner = np.zeros(n + 1, np.int8)  # bytes of references but their first
    inner[begin + 1] = 1
    inner[begin + run] = -1
    return np.flatnonzero(np.cumsum(inner[:n], dtype=np.int8) == 0), begin - np.cumsum(run - 1) + run - 1, run, distance


def _code_arrays(lengths: list[dict[int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Canonical codes, first bit lowest, and their lengths, by symbol, ``size`` of them for each code of the list."""
    order = np.array([x for each in lengths for x in sorted([n << 16 | s for s, n in each.items()])])
    symbols = (order & 0xFFFF) + np.repeat(np.arange(0, size * len(lengths), size), [len(each) for each in lengths])
    value, length = np.zeros(size * len(lengths), np.int64), np.zeros(size * len(lengths), np.int64)
    length[symbols] = n = order >> 16
    spans = 1 << 15 - n  # those of each code fill 15 bits
    value[symbols] = _reversed(15)[np.cumsum(spans) - spans & 0x7FFF]
    return value, length


def _counted(counts: np.ndarray) -> dict[int, int]:
    some = np.flatnonzero(counts)
    return dict(zip(some.tolist(), counts[some].tolist(), strict=True))


def _entropy(counts: np.ndarray) -> float:
    counts = counts[counts > 0]
    return float((counts * np.log2(counts.sum() / counts)).sum())


def _images(pixels: list[np.ndarray]) -> list[bytes]:
    """RIFF files of grey pixels in rows of 64. What is done by arrays is done for all images at once, so that many small
    ones cost less; each file is as if it were alone."""
    x, sizes = np.concatenate(pixels), np.array([len(p) for p in pixels])
    rows, ends = x.reshape(-1, 64), np.cumsum(sizes)
    steps, first = rows.copy(), (ends - sizes) >> 6
    steps[:, 1:] -= rows[:, :-1]
    steps[1:, 0] -= rows[:-1, 0]
    steps[first, 0] = rows[first, 0]
    steps, of = steps.ravel(), np.repeat(np.arange(len(pixels)) << 8, sizes)
    counts, of_steps = (np.bincount(of + v, minlength=len(pixels) << 8).reshape(-1, 256) for v in (x, steps))
    heads, alphas, streams, widths = [], [], [], []
    for k, (own, end) in enumerate(zip(pixels, ends.tolist(), strict=True)):
        out, bits, alpha = _head(64, len(own) >> 6), 0, 255
        colours = np.flatnonzero(counts[k])
        if len(colours) <= 16:
            out.put(1 | PALETTE << 1, 3)
            out.put(len(colours) - 1, 8)
            table = colours.astype(np.uint32) * np.uint32(0x10101) | np.uint32(BLACK)
            write_pixels(out, _join(np.diff(_split(table), axis=0, prepend=0)), len(table), False)
            bits = bundle_bits(len(colours))
            index = np.searchsorted(colours, own).reshape(-1, 1 << bits)
            own = (index << np.arange(1 << bits) * (8 >> bits)).sum(1).astype(np.uint8)
        else:
            if _entropy(of_steps[k]) < _entropy(counts[k]):
                out.put(1 | PREDICTOR << 1, 3)
                out.put(7, 3)
                write_pixels(out, np.full(_blocks(len(own) >> 6, 9), 1 << 8 | BLACK, np.uint32), 1, False)
                own, alpha = steps[end - len(own) : end], 0
            out.put(1 | SUBTRACT_GREEN << 1, 3)
        out.put(0, 1)
        out.put(0, 2)  # no cache, one group of codes
        heads.append(out)
        alphas.append(alpha)
        streams.append(own)
        widths.append(6 - bits)
    return [_riff(data) for data in _coded(heads, alphas, streams, np.array(widths))]


def _coded(heads: list[Writer], alphas: list[int], streams: list[np.ndarray], widths: np.ndarray) -> list[bytes]:
    """Each head, then prefix codes and tokens of its stream of green values. widths: the images' log2 of it."""
    x, sizes, n = np.concatenate(streams), np.array([len(v) for v in streams]), len(streams)
    at, copies, run, d = _references(x, sizes)
    tokens = np.diff(np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes)])))
    image = np.repeat(np.arange(n), tokens)
    of, symbol = image[copies], x[at].astype(np.int64)
    run_prefix, run_rest, run_bits = _prefixes(run)
    symbol[copies] = 256 + run_prefix
    near = _near_codes()
    known = near[widths[of], np.minimum(d, near.shape[1] - 1)] * (d < near.shape[1])
    prefix, rest, rest_bits = _prefixes(np.where(known > 0, known, d + 120))
    symbol += 280 * image
    prefix += 40 * of
    greens, fars = [], []
    counts, of_far = np.bincount(symbol, minlength=280 * n).reshape(n, 280), np.bincount(prefix, minlength=40 * n).reshape(n, 40)
    for k, (out, alpha) in enumerate(zip(heads, alphas, strict=True)):
        greens.append(write_lengths(out, code_lengths(_counted(counts[k]), CODE_BITS), 280))
        for one in (0, 0, alpha):
            write_lengths(out, {one: 0}, 256)
        fars.append(write_lengths(out, code_lengths(_counted(of_far[k]), CODE_BITS), 40))
    code, length = _code_arrays(greens, 280)
    far, far_bits = _code_arrays(fars, 40)
    value, size = code[symbol], length[symbol]
    ends, values = size[copies], value[copies]
    for more, bits in ((run_rest, run_bits), (far[prefix], far_bits[prefix]), (rest, rest_bits)):
        values |= more << ends
        ends += bits
    value[copies], size[copies] = values, ends
    return _packed([out.array() for out in heads], value.astype(np.uint64), size, tokens)


def _packed(heads: list[np.ndarray], value: np.ndarray, size: np.ndarray, tokens: np.ndarray) -> list[bytes]:
    """The bits of each head, then of its share of the values (at most 56 bits each), least significant first. tokens: the
    number of values of each, 1 at least."""
    head, ends = np.array([len(v) for v in heads]), np.cumsum(size)
    last = ends[np.cumsum(tokens) - 1]
    before = np.concatenate([[0], last[:-1]])
    bits = head + last - before
    words = bits + 63 >> 6  # each begins with a word of its own
    start = np.cumsum(words) - words
    ends += np.repeat(64 * start + head - before, tokens)
    begin = ends - size
    out = np.zeros(int(words.sum()) + 1, "<u8")
    whole = out.view(np.uint8)
    for v, a in zip(heads, (8 * start).tolist(), strict=True):
        v = np.packbits(v, bitorder="little")
        whole[a : a + len(v)] = v
    word, shift = begin >> 6, (begin & 63).astype(np.uint64)
    firsts = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
    out[word[firsts]] |= np.bitwise_or.reduceat(value << shift, firsts)
    over = np.flatnonzero((ends >> 6 > word) & (shift > 0))  # the last value of a word may end in the next one
    out[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
    return [whole[a : a + b].tobytes() for a, b in zip((8 * start).tolist(), (bits + 7 >> 3).tolist(), strict=True)]


def padded(n: int) -> int:
    """The bytes of the payload of a text of n bytes: a positive multiple of 64."""
    return max(64, -(-n // 64) * 64)


#: Bytes of files that are read together, and of payloads whose images are made together.
READ_TOGETHER, TOGETHER = 1 << 13, 1 << 15


def store(payload: np.ndarray) -> bytes:
    """A payload (bytes, a positive multiple of 64) as grey images."""
    return store_all([payload])[0]


def store_all(payloads: list[np.ndarray]) -> list[bytes]:
    """``store`` of each payload."""
    parts = [(k, p[a : a + 64 * SIDE]) for k, p in enumerate(payloads) for a in range(0, len(p), 64 * SIDE)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for i, j in flat.pieces_of(np.cumsum([0, *(len(p) for _, p in parts)]), TOGETHER):
        for (k, _), file in zip(parts[i:j], _images([p for _, p in parts[i:j]]), strict=True):
            out[k].append(file)
    return [b"".join(files) for files in out]


def load(media: bytes, n: int) -> np.ndarray:
    """The payload of n bytes that ``store`` has kept."""
    return load_all([media], [n])[0]


def load_all(media: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """``load`` of each."""
    files: list[tuple[int, bytes]] = []
    for k, data in enumerate(media):
        at = 0
        while at < len(data):
            end = at + 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]
            files.append((k, data[at:end]))
            at = end
    out: list[list[np.ndarray]] = [[] for _ in media]
    for i, j in flat.pieces_of(np.cumsum([0, *(len(data) for _, data in files)]), WINDOW):
        for (k, _), pixels in zip(files[i:j], decode_all([data for _, data in files[i:j]]), strict=True):
            out[k].append(((pixels >> 8) & 0xFF).astype(np.uint8).ravel())
    return [(parts[0] if len(parts) == 1 else np.concatenate(parts))[:n] for parts, n in zip(out, sizes, strict=True)]


def feature(payload: np.ndarray) -> str:
    """Which of the 64 equal stretches of the payload are brighter than its mean, and the mean, in thousandths."""
    sums = payload.reshape(64, -1).sum(1, dtype=np.int64)
    bits = np.packbits(sums * 64 > sums.sum()).tobytes().hex()
    return f"{bits}-{int(sums.sum()) * 1000 // len(payload)}"


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text of ``docs`` (doc_id, text) as images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat.texts_of(batch.column("text"))
            for i, j in flat.pieces_of(offsets, 8 * flat.CHUNK):
                payloads = []
                for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True):
                    payload = np.zeros(padded(b - a), np.uint8)
                    payload[: b - a] = data[a:b]
                    payloads.append(payload)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(store_all(payloads), pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def measured(media: DataFrame) -> DataFrame:
    """What the stored images of ``media`` (doc_id, n_bytes, media), read from where they were written, hold: sizes,
    digests and a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            sizes = [padded(n) for n in batch.column("n_bytes").to_pylist()]
            for i, j in flat.pieces_of(np.cumsum([0, *sizes]), 8 * flat.CHUNK):
                part, rows = batch.slice(i, j - i), []
                media = part.column("media").to_pylist()
                for own, payload in zip(media, load_all(media, sizes[i:j]), strict=True):
                    raw = payload.tobytes()
                    rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(own), hashlib.sha256(own).hexdigest(), feature(payload)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
