"""Byte forms of the index files of an archive: word codes, the full-text tree and the keyword tree, written and read.

Both trees are written level by level: all lowest nodes in order, then the nodes above them, the root last. A file's pointers have
32 bits, so one of 4 GiB or more is an error.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterable, Iterator

# Fixed values of the formats.
ROOT_DOC, ROOT_COUNT, ROOT_PLACE = 2, 1, 5
NODE, HEADER = 4096, 0x400
BLOCK = 2048
KEYWORD_DATA = bytes([0, 0, 0, 0, 5, 0, 0, 0, 0x80, 0, 0, 0, 0])


def code(value: int, root: int) -> str:
    """A number in scale/root code, as binary digits."""
    n = value.bit_length()
    return f"0{value:0{root}b}" if n <= root else "1" * (n - root) + "0" + f"{value:b}"[1:]


def page_code(step: int, places: list[int]) -> bytes:
    """One page's entry: the step from the page before, the number of places and the steps between them, in whole bytes."""
    steps = [b - a for a, b in zip([0, *places[:-1]], places, strict=True)]
    digits = code(step, ROOT_DOC) + code(len(places), ROOT_COUNT) + "".join(code(s, ROOT_PLACE) for s in steps)
    size = -(-len(digits) // 8)
    return int(digits.ljust(8 * size, "0"), 2).to_bytes(size, "big")


def page_codes(pages: Iterable[tuple[int, list[int]]]) -> bytes:
    """A word's data: the entries of its pages, which come in ascending order."""
    out, last = bytearray(), 0
    for page, places in pages:
        out += page_code(page - last, places)
        last = page
    return bytes(out)


def read_pages(data: bytes, count: int) -> Iterator[tuple[int, list[int]]]:
    """(page, places) of a word's data."""
    digits = f"{int.from_bytes(data, 'big'):0{8 * len(data)}b}"
    at = page = 0

    def value(root: int) -> int:
        nonlocal at
        ones = digits.index("0", at) - at
        begin = at + ones + 1
        at = begin + (root + ones - 1 if ones else root)
        return int(("1" if ones else "0") + digits[begin:at], 2)

    for _ in range(count):
        page += value(ROOT_DOC)
        places, place = [], 0
        for _ in range(value(ROOT_COUNT)):
            place += value(ROOT_PLACE)
            places.append(place)
        yield page, places
        at = -(-at // 8) * 8


def varint(value: int) -> bytes:
    """Groups of seven bits, the least first; all but the last have the top bit set."""
    out = []
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while data[at] & 128:
        value |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
    return value | data[at] << shift, at + 1


def filled(items: Iterable, cost: Callable, room: int) -> Iterator[list]:
    """The items in order, as nodes: each takes items while their costs, which may depend on the item before, fit in."""
    node, used = [], 0
    for item in items:
        size = cost(item, node[-1] if node else None)
        if node and used + size > room:
            yield node
            node, used, size = [], 0, cost(item, None)
        node.append(item)
        used += size
    if node:
        yield node


def _part(word: str, before: str) -> bytes:
    """A word as it stands in a node after another: length of the rest, length shared, the rest."""
    shared = len(os.path.commonprefix([word, before]))
    return bytes([len(word) - shared + 1, shared]) + word[shared:].encode("ascii")


def _words(node: list) -> Iterator[tuple]:
    """Each item of a node, whose first field is its word, with the word's bytes there."""
    return ((*item, _part(item[0], before[0])) for before, item in zip([("",), *node[:-1]], node, strict=True))


def write_fts(words: Iterable[tuple[str, int, int, bytes]], pages: int, total: int, total_length: int, codepage: int, lcid: int) -> bytes:
    """The full-text index of (word, context, its pages, its data) in the order of word and context. pages, total and total_length:
    how many pages have words, how many words there are, and their characters. Without words there is no file."""
    head = lambda item, before: _part(item[0], before[0] if before else "")
    leaf_cost = lambda item, before: len(head(item, before)) + 1 + len(varint(item[2])) + 6 + len(varint(len(item[3])))
    index_cost = lambda item, before: len(head(item, before)) + 6
    out, level, free = bytearray(HEADER), [], 0
    longest = unique = unique_length = 0
    for leaf in filled(words, leaf_cost, NODE - 8):
        body = bytearray()
        for word, context, count, data, part in _words(leaf):
            body += part + bytes([context]) + varint(count) + struct.pack("<IH", len(out), 0) + varint(len(data))
            out += data
            longest, unique, unique_length = max(longest, len(word)), unique + 1, unique_length + len(word)
        here, free = len(out), NODE - 8 - len(body)
        if level:
            struct.pack_into("<I", out, level[-1][1], here)
        out += struct.pack("<IHH", 0, 0, free) + body + bytes(free)
        level.append((leaf[-1][0], here))
    if not level:
        return b""
    leaves, depth = len(level), 1
    while len(level) > 1:
        above = []
        for node in filled(level, index_cost, NODE - 2):
            body = b"".join(part + struct.pack("<IH", child, 0) for _, child, part in _words(node))
            above.append((node[-1][0], len(out)))
            out += struct.pack("<H", NODE - 2 - len(body)) + body + bytes(NODE - 2 - len(body))
        level, depth = above, depth + 1
    if len(out) >= 1 << 32:
        raise ValueError("a full-text index of 4 GiB or more")
    root = level[0][1]
    fields = struct.pack("<4B5IHI6B10x", 0, 0, 0x28, 0, pages, root, 0, leaves, root, depth, 7, 2, ROOT_DOC, 2, ROOT_COUNT, 2, ROOT_PLACE)
    fields += struct.pack("<13I24x2I", NODE, 0, 1, 5, longest, total, unique, total_length, 0, unique_length, free, 0, pages - 1, codepage, lcid)
    out[: len(fields)] = fields
    return bytes(out)


def _index_entries(data: bytes, at: int) -> Iterator[tuple[str, int]]:
    end, word = at + NODE - struct.unpack_from("<H", data, at)[0], ""
    at += 2
    while at < end:
        rest, shared = data[at] - 1, data[at + 1]
        word = word[:shared] + data[at + 2 : at + 2 + rest].decode("ascii")
        yield word, struct.unpack_from("<I", data, at + 2 + rest)[0]
        at += 8 + rest


def _leaf_entries(data: bytes, at: int) -> Iterator[tuple[str, int, int, bytes]]:
    end, word = at + NODE - struct.unpack_from("<H", data, at + 6)[0], ""
    at += 8
    while at < end:
        rest, shared = data[at] - 1, data[at + 1]
        word = word[:shared] + data[at + 2 : at + 2 + rest].decode("ascii")
        context = data[at + 2 + rest]
        count, at = read_varint(data, at + 3 + rest)
        begin = struct.unpack_from("<I", data, at)[0]
        size, at = read_varint(data, at + 6)
        yield word, context, count, data[begin : begin + size]


def read_fts(data: bytes) -> Iterator[tuple[str, int, int, bytes]]:
    """(word, context, its pages, its data) of an index, leaf after leaf."""
    if not data:
        return
    at, depth = struct.unpack_from("<I", data, 8)[0], struct.unpack_from("<H", data, 24)[0]
    for _ in range(depth - 1):
        at = next(_index_entries(data, at))[1]
    while at:
        yield from _leaf_entries(data, at)
        at = struct.unpack_from("<I", data, at)[0]


def find_word(data: bytes, word: str) -> list[tuple[str, int, int, bytes]]:
    """A word's entries, one for each context, found from the root down."""
    if not data:
        return []
    at, depth = struct.unpack_from("<I", data, 8)[0], struct.unpack_from("<H", data, 24)[0]
    for _ in range(depth - 1):
        at = next((child for key, child in _index_entries(data, at) if key >= word), 0)
        if not at:
            return []
    out = []
    while at:
        entries = list(_leaf_entries(data, at))
        out += [e for e in entries if e[0] == word]
        if entries[-1][0] > word:
            break
        at = struct.unpack_from("<I", data, at)[0]
    return out


def keyword_record(display: str, see_also: str | None, depth: int, char_index: int, topics: list[int], number: int) -> bytes:
    """A keyword of a listing block. One that refers to another has its text in place of topics."""
    text = (display + "\0").encode("utf-16-le", "surrogatepass")
    fixed = struct.pack("<HHII", 2 if see_also else 0, depth, char_index, 0)
    if see_also:
        target = struct.pack("<I", 1) + (see_also + "\0").encode("utf-16-le", "surrogatepass")
    else:
        target = struct.pack(f"<I{len(topics)}I", len(topics), *topics)
    return text + fixed + target + struct.pack("<II", 1, 13 * number)


def write_keywords(keywords: Iterable[tuple[str, str | None, int, int, list[int]]], codepage: int, lcid: int) -> dict[str, bytes]:
    """The four files of (display, see also, depth, char index, topics) in order. A keyword whose record is longer than a
    block counts and is numbered, but no block lists it."""
    records = [keyword_record(*k, i) for i, k in enumerate(keywords)]
    lists = list(filled((r for r in records if len(r) <= BLOCK - 12), lambda r, _: len(r), BLOCK - 13)) or [[]]
    blocks, places, before = [], b"", 0
    for i, block in enumerate(lists):
        body, later = b"".join(block), i + 1 if i + 1 < len(lists) else -1
        blocks.append(struct.pack("<HHii", BLOCK - 12 - len(body), len(block), i - 1, later) + body.ljust(BLOCK - 12, b"\0"))
        places += struct.pack("<II", before, i)
        before += len(block)
    # above: a child's first record without its last two numbers, and the child's number
    firsts, base, depth = [block[0][:-8] for block in lists if block], 0, 1
    while len(firsts) > 1:
        nodes = list(filled([(key, base + i) for i, key in enumerate(firsts)], lambda x, _: len(x[0]) + 4, BLOCK - 9))
        if len(nodes) == len(firsts):
            raise ValueError("keywords too long for an index: no two fit in a block")
        for node in nodes:
            body = b"".join(key + struct.pack("<I", child) for key, child in node)
            blocks.append(struct.pack("<HHI", BLOCK - 8 - len(body), len(node), node[0][1]) + body.ljust(BLOCK - 8, b"\0"))
        base, firsts, depth = base + len(firsts), [node[0][0] for node in nodes], depth + 1
    head = struct.pack("<BBHH16sIIIiIH", 0x3B, 0x29, 2, BLOCK, b"X44", 0, len(lists) - 1, len(blocks) - 1, -1, len(blocks), depth)
    head += struct.pack("<8I", len(records), codepage, lcid, 1, 10031, 0, 0, 0)
    facts = [0] + ([0, 0, 0xC, 1, 1, 0, 0] if records else [])
    return {"BTree": head + b"".join(blocks), "Data": KEYWORD_DATA * len(records), "Map": b"\0\0" + places, "Property": struct.pack(f"<{len(facts)}I", *facts)}


def _text(data: bytes, at: int) -> tuple[str, int]:
    end = at
    while data[end : end + 2] != b"\0\0":
        end += 2
    return data[at:end].decode("utf-16-le", "surrogatepass"), end + 2


def _keyword(data: bytes, at: int) -> tuple[str, str | None, int, int, list[int], int]:
    """A record without its last two numbers, and where these are."""
    display, at = _text(data, at)
    kind, depth, char_index, _, count = struct.unpack_from("<HHIII", data, at)
    if kind:
        see_also, at = _text(data, at + 16)
        return display, see_also, depth, char_index, [], at
    return display, None, depth, char_index, list(struct.unpack_from(f"<{count}I", data, at + 16)), at + 16 + 4 * count


def read_keywords(tree: bytes) -> Iterator[tuple[str, str | None, int, int, list[int], int]]:
    """(display, see also, depth, char index, topics, number) of a tree, found from the root down and then block after block."""
    head = len(tree) % BLOCK
    root, depth = struct.unpack_from("<I", tree, 30)[0], struct.unpack_from("<H", tree, 42)[0]
    block = root
    for _ in range(depth - 1):
        block = struct.unpack_from("<I", tree, head + BLOCK * block + 4)[0]
    while block >= 0:
        at = head + BLOCK * block
        _, count, _, later = struct.unpack_from("<HHii", tree, at)
        at += 12
        for _ in range(count):
            *row, at = _keyword(tree, at)
            yield (*row, struct.unpack_from("<II", tree, at)[1] // 13)
            at += 8
        block = later
