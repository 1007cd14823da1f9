"""LZX, as help archives use it: frames of 32 KiB, state reset every two frames, a window of 64 KiB to 2 MiB.

Intervals of two frames are independent, so ``compress`` works on one, and ``decompress`` on one or, where an archive has no
usable reset table, on a whole section. The encoder writes a verbatim block for each frame; the decoder reads
verbatim, aligned and raw blocks.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import numpy as np

FRAME, INTERVAL = 0x8000, 0x10000
VERBATIM, ALIGNED, RAW = 1, 2, 3
SHORTEST, LONGEST = 2, 257
#: Offset slots by log2 of the window.
SLOTS = {15: 30, 16: 32, 17: 34, 18: 36, 19: 38, 20: 42, 21: 50}
EXTRA = [0 if s < 4 else min(17, (s >> 1) - 1) for s in range(51)]
BASE = [sum(1 << e for e in EXTRA[:s]) for s in range(51)]


class Out:
    """Bits, most significant first, in little-endian words of 16."""

    def __init__(self) -> None:
        self.words, self.value, self.n = bytearray(), 0, 0

    def put(self, value: int, n: int) -> None:
        self.value, self.n = self.value << n | value, self.n + n
        while self.n >= 16:
            self.n -= 16
            self.words += (self.value >> self.n & 0xFFFF).to_bytes(2, "little")
        self.value &= (1 << self.n) - 1

    def align(self) -> None:
        if self.n:
            self.put(0, 16 - self.n)


class In:
    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.n = data, 0, 0, 0

    def fill(self, n: int) -> None:
        while self.n < n:
            self.value = self.value << 16 | int.from_bytes(self.data[self.at : self.at + 2], "little")
            self.at, self.n = self.at + 2, self.n + 16
            if self.at > len(self.data) + 64:
                raise ValueError("the stream ends within its data")

    def read(self, n: int) -> int:
        self.fill(n)
        self.n -= n
        out = self.value >> self.n
        self.value &= (1 << self.n) - 1
        return out

    def align(self) -> None:
        drop = self.n % 16
        self.n -= drop
        self.value &= (1 << self.n) - 1

    def raw(self, n: int) -> bytes:
        self.at -= 2 * (self.n // 16)
        self.value = self.n = 0
        self.at += n
        return self.data[self.at - n : self.at]


def lengths_for(counts: list[int], most: int = 16) -> list[int]:
    """Code lengths of at most ``most`` bits for symbols with these counts."""
    used = [(n, s) for s, n in enumerate(counts) if n]
    out = [0] * len(counts)
    if len(used) == 1:
        used.append((1, 0 if used[0][1] else 1))
    floor = 1
    while used:
        heap = [(max(n, floor), s, [s]) for n, s in used]
        depth = dict.fromkeys((s for _, s in used), 0)
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        if max(depth.values()) <= most:
            for s, d in depth.items():
                out[s] = d
            return out
        floor *= 2
    return out


def codes_for(lengths: list[int]) -> list[int]:
    out, code, last = [0] * len(lengths), 0, 0
    for length, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= length - last
        last = length
        out[symbol] = code
        code += 1
    return out


class Tree:
    def __init__(self, lengths: list[int]):
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        self.most = used[-1][0] if used else 0
        spans = np.array([1 << (self.most - n) for n, _ in used], np.int64)
        self.table = np.repeat(np.array([s << 5 | n for n, s in used], np.int64), spans).tolist() if used else []
        if used and len(self.table) > 1 << self.most:
            raise ValueError("the code is over-full")

    def read(self, bits: In) -> int:
        if not self.table:
            raise ValueError("a symbol of an empty code")
        bits.fill(self.most)
        peek = bits.value >> (bits.n - self.most)
        if peek >= len(self.table):
            raise ValueError("no such code")
        entry = self.table[peek]
        bits.n -= entry & 31
        bits.value &= (1 << bits.n) - 1
        return entry >> 5


def write_lengths(out: Out, before: list[int], now: list[int]) -> None:
    tokens, k = [], 0
    while k < len(now):
        n = 0
        while k + n < len(now) and now[k + n] == 0 and n < 51:
            n += 1
        if n >= 20:
            tokens.append((18, n - 20, 5))
            k += n
        elif n >= 4:
            tokens.append((17, n - 4, 4))
            k += n
        else:
            tokens.append(((before[k] - now[k]) % 17, 0, 0))
            k += 1
    counts = Counter(t for t, _, _ in tokens)
    lengths = lengths_for([counts.get(s, 0) for s in range(20)], 15)
    for n in lengths:
        out.put(n, 4)
    codes = codes_for(lengths)
    for t, extra, n in tokens:
        out.put(codes[t], lengths[t])
        out.put(extra, n)


def read_lengths(bits: In, lengths: list[int], a: int, b: int) -> None:
    tree = Tree([bits.read(4) for _ in range(20)])
    k = a
    while k < b:
        t = tree.read(bits)
        if t == 17:
            n, value = 4 + bits.read(4), 0
        elif t == 18:
            n, value = 20 + bits.read(5), 0
        elif t == 19:
            n = 4 + bits.read(1)
            value = (lengths[k] - tree.read(bits)) % 17
        else:
            n, value = 1, (lengths[k] - t) % 17
        if k + n > b:
            raise ValueError("code lengths run over their tree")
        lengths[k : k + n] = [value] * n
        k += n


def _parse(data: bytes, a: int, b: int, seen: dict[bytes, list[int]], recent: list[int]) -> list[tuple[int, int, int]]:
    """(literal or -1, offset, length) steps for data[a:b], with the matches of the interval before."""
    steps, k = [], a
    while k < b:
        best, where = 0, 0
        limit = min(LONGEST, b - k)
        near = [k - r for r in recent if r <= k]
        for j in [*near, *reversed(seen[data[k : k + 3]][-16:])]:
            if best and (best >= limit or data[j + best] != data[k + best]):
                continue
            n = 0
            while n < limit and data[j + n] == data[k + n]:
                n += 1
            if n > best and (n >= 3 or n == 2 and j in near):
                best, where = n, k - j
        if best:
            steps.append((-1, where, best))
            if where in recent:
                recent.remove(where)
            else:
                recent.pop()
            recent.insert(0, where)
        else:
            steps.append((data[k], 0, 1))
            best = 1
        for i in range(k, min(k + best, len(data) - 2)):
            seen[data[i : i + 3]].append(i)
        k += best
    return steps


def compress(data: bytes, window_bits: int = 16) -> tuple[bytes, list[int]]:
    """One interval (at most 64 KiB): its stream, and where each frame ends in it. Short data are padded to whole frames."""
    data = data + b"\0" * (-len(data) % FRAME or (FRAME if not data else 0))
    slots = SLOTS[window_bits]
    out, ends = Out(), []
    out.put(0, 1)
    main, long = [0] * (256 + 8 * slots), [0] * 249
    seen: dict[bytes, list[int]] = defaultdict(list)
    r = [1, 1, 1]
    for a in range(0, len(data), FRAME):
        steps = _parse(data, a, a + FRAME, seen, [*r])
        symbols = []
        for literal, offset, n in steps:
            if literal >= 0:
                symbols.append((literal, 0, 0, -1))
                continue
            if offset == r[0]:
                slot, extra, bits = 0, 0, 0
            elif offset == r[1]:
                slot, extra, bits = 1, 0, 0
                r[0], r[1] = r[1], r[0]
            elif offset == r[2]:
                slot, extra, bits = 2, 0, 0
                r[0], r[2] = r[2], r[0]
            else:
                slot = next(s for s in range(3, slots + 1) if s == slots or BASE[s + 1] > offset + 2)
                extra, bits = offset + 2 - BASE[slot], EXTRA[slot]
                r[:] = [offset, r[0], r[1]]
            head = min(n - SHORTEST, 7)
            symbols.append((256 + 8 * slot + head, extra, bits, n - SHORTEST - 7 if head == 7 else -1))
        main_counts, long_counts = Counter(s for s, *_ in symbols), Counter(x for *_, x in symbols if x >= 0)
        new_main = lengths_for([main_counts.get(s, 0) for s in range(len(main))])
        new_long = lengths_for([long_counts.get(s, 0) for s in range(249)])
        out.put(VERBATIM, 3)
        out.put(FRAME, 24)
        write_lengths(out, main[:256], new_main[:256])
        write_lengths(out, main[256:], new_main[256:])
        write_lengths(out, long, new_long)
        main, long = new_main, new_long
        mc, lc = codes_for(main), codes_for(long)
        for s, extra, bits, x in symbols:
            out.put(mc[s], main[s])
            if x >= 0:
                out.put(lc[x], long[x])
            out.put(extra, bits)
        out.align()
        ends.append(len(out.words))
    return bytes(out.words), ends


def decompress(stream: bytes, size: int, window_bits: int = 16, reset: int = INTERVAL) -> bytes:
    """The ``size`` bytes of a stream whose state is reset every ``reset`` bytes."""
    bits, out, slots = In(stream), bytearray(), SLOTS[window_bits]
    left = kind = 0
    while len(out) < size:
        if len(out) % reset == 0:
            if bits.read(1):
                bits.read(32)
            main, long, r, left = [0] * (256 + 8 * slots), [0] * 249, [1, 1, 1], 0
        frame_end = min(len(out) + FRAME, size)
        while len(out) < frame_end:
            if not left:
                kind, left = bits.read(3), bits.read(24)
                if kind == RAW:
                    bits.align() if bits.n % 16 else bits.read(16)
                    head = bits.raw(12)
                    r = [int.from_bytes(head[i : i + 4], "little") for i in (0, 4, 8)]
                    raw_odd = left & 1
                elif kind in (VERBATIM, ALIGNED):
                    aligned = Tree([bits.read(3) for _ in range(8)]) if kind == ALIGNED else None
                    read_lengths(bits, main, 0, 256)
                    read_lengths(bits, main, 256, len(main))
                    read_lengths(bits, long, 0, 249)
                    main_tree, long_tree = Tree(main), Tree(long)
                else:
                    raise ValueError("unknown block type")
            stop = min(len(out) + left, frame_end)
            begin = len(out)
            if kind == RAW:
                part = bits.raw(stop - begin)
                if len(part) < stop - begin:
                    raise ValueError("the stream ends within a raw block")
                out += part
            while len(out) < stop:
                s = main_tree.read(bits)
                if s < 256:
                    out.append(s)
                    continue
                slot, n = (s - 256) >> 3, (s - 256) & 7
                n = SHORTEST + (7 + long_tree.read(bits) if n == 7 else n)
                if slot < 3:
                    r[0], r[slot] = r[slot], r[0]
                else:
                    extra = EXTRA[slot]
                    if aligned is not None and extra >= 3:
                        offset = BASE[slot] + (bits.read(extra - 3) << 3)
                        offset += aligned.read(bits)
                    else:
                        offset = BASE[slot] + bits.read(extra)
                    r = [offset - 2, r[0], r[1]]
                if r[0] > len(out):
                    raise ValueError("a match begins before the data")
                for _ in range(n):
                    out.append(out[-r[0]])
            left -= len(out) - begin
            if kind == RAW and not left and raw_odd:
                bits.raw(1)
        bits.align()
    return bytes(out[:size])
