"""Index files: bytes by hand, trees of several levels, and round trips."""

import random
import struct

import pytest

from lexforge.functions import index_bytes as ib


def test_codes_by_hand():
    assert [ib.code(v, 2) for v in (0, 1, 3, 4, 9)] == ["000", "001", "011", "1000", "110001"]
    assert ib.varint(0) == b"\0" and ib.varint(127) == b"\x7f" and ib.varint(300) == b"\xac\x02"
    # page 0, one place, the first word: 000, 01, 000000, padded
    assert ib.page_codes([(0, [0])]) == bytes([0b00001000, 0])
    r = random.Random(1)
    for _ in range(200):
        pages = sorted(r.sample(range(1 << 20), r.randint(1, 30)))
        rows = [(p, sorted(r.sample(range(1 << r.randint(5, 24)), r.randint(1, 20)))) for p in pages]
        assert list(ib.read_pages(ib.page_codes(rows), len(rows))) == rows
        for v in range(0, 5000, 37):
            n = v.bit_length()
            assert len(ib.code(v, 5)) == (6 if n <= 5 else 2 * n - 5)


def test_full_text_tree_of_several_levels():
    r = random.Random(2)
    names = sorted({"".join(r.choice("abcdefgh0123456789") for _ in range(r.randint(1, 99))) for _ in range(30_000)})
    words = [(w, c, 1, ib.page_codes([(i, [c])])) for i, w in enumerate(names) for c in ((0, 1) if i % 7 == 0 else (0,))]
    data = ib.write_fts(iter(words), 5, len(words), 123, 1252, 0x409)
    assert list(ib.read_fts(data)) == words
    root, leaves, depth = struct.unpack_from("<I", data, 8)[0], struct.unpack_from("<I", data, 16)[0], struct.unpack_from("<H", data, 24)[0]
    assert depth == 3 and root == len(data) - 4096 and leaves > 100
    for w in r.sample(names, 200):
        assert ib.find_word(data, w) == [x for x in words if x[0] == w]
    assert ib.find_word(data, "zzz") == [] and ib.find_word(data, "aa!") == []
    one = ib.write_fts([("a", 0, 1, b"\x08\0")], 1, 1, 1, 1252, 0x409)
    # the data, then the only leaf, which is the root
    assert len(one) == 0x400 + 2 + 4096 and one[0x400:0x402] == b"\x08\0"
    assert one[0x402:0x402 + 8 + 12] == struct.pack("<IHH", 0, 0, 4096 - 8 - 12) + b"\x02\0a\0\x01" + struct.pack("<IH", 0x400, 0) + b"\x02"
    assert ib.write_fts([], 0, 0, 0, 1252, 0x409) == b"" and list(ib.read_fts(b"")) == []


def test_keyword_tree_of_several_levels():
    r = random.Random(3)
    rows = [(f"wort {i:05d} " + "é" * r.randint(0, 60), "elsewhere" if i % 11 == 0 else None, i % 3, i % 5, [] if i % 11 == 0 else [i, i + 1]) for i in range(6000)]
    files = ib.write_keywords(rows, 1252, 0x409)
    assert [x[:5] for x in ib.read_keywords(files["BTree"])] == rows
    assert [x[5] for x in ib.read_keywords(files["BTree"])] == list(range(6000))
    assert struct.unpack_from("<H", files["BTree"], 42)[0] >= 3 and len(files["Data"]) == 13 * 6000
    places = struct.unpack(f"<{(len(files['Map']) - 2) // 4}I", files["Map"][2:])
    assert list(places[1::2]) == list(range(len(places) // 2)) and places[0] == 0 and list(places[::2]) == sorted(places[::2])
    assert len(files["Property"]) == 32
    none = ib.write_keywords([], 1252, 0x409)
    assert list(ib.read_keywords(none["BTree"])) == [] and none["Property"] == bytes(4) and len(none["BTree"]) == 76 + 2048


def test_a_record_longer_than_a_block_is_counted_but_not_listed():
    rows = [("a", None, 0, 0, [1]), ("b" * 1100, None, 0, 0, [2]), ("c", None, 0, 0, [3])]
    files = ib.write_keywords(rows, 1252, 0x409)
    assert [(x[0], x[5]) for x in ib.read_keywords(files["BTree"])] == [("a", 0), ("c", 2)]
    assert len(files["Data"]) == 39
    with pytest.raises(ValueError):
        ib.write_keywords([(f"{i}" + "x" * 1000, None, 0, 0, [1]) for i in range(3)], 1252, 0x409)


def test_listed_and_marked_keywords_stay_apart(spark):
    from lexforge.operators import index_files

    listed = spark.createDataFrame([("p", "b", "B", None, 0, 0, [4], 0), ("p", "b, x", "B, x", "a", 1, 3, [], 1), ("q", "z", "z", None, 0, 0, [1], 0)], "archive string, sort_key string, display string, see_also string, depth int, char_index int, topics array<bigint>, ordinal int")
    marked = spark.createDataFrame([("p", "b", "b", [7]), ("p", "a", "a", [8, 9])], "archive string, sort_key string, display string, topics array<bigint>")
    files = index_files.keyword_files(index_files.all_keywords(listed, marked))
    got = [tuple(x) for x in index_files.keyword_entries(files).orderBy("archive", "number").collect()]
    assert got == [("p", 0, "a", None, 0, 0, [8, 9]), ("p", 1, "B", None, 0, 0, [4]), ("p", 2, "b", None, 0, 0, [7]), ("p", 3, "B, x", "a", 1, 3, []), ("q", 0, "z", None, 0, 0, [1])]
    assert index_files.keyword_files(index_files.all_keywords(listed, marked).limit(0)).count() == 0
