"""Record files of a project, read byte by byte."""

import struct

from lexforge.functions import records as rec

NODE = lambda i, parent, depth, *params: {"node_id": i, "parent_id": parent, "depth": depth, "params": [{"name": k, "value": v} for k, v in params]}


def text_at(data: bytes, at: int) -> bytes:
    return data[at : data.index(b"\0", at)]


def test_pools_keep_strings_within_blocks():
    s = rec.Strings(1252)
    assert (s.put(""), s.put("ab"), s.put("ab"), s.put("c")) == (0, 1, 1, 4)
    assert s.put("x" * 4085) == 6 and len(s.data) == 4092
    assert s.put("four") == 4096  # 5 bytes, but 4 left
    assert s.put("y" * 5000) == 4101  # longer than a block: where it is
    u = rec.Pool(rec.URL_BLOCK, 8, 1252)
    assert u.put("a.htm") == 1 and u.put("b.htm") == 15
    assert u.put("z" * 16360) == 0x4000 + 1 and text_at(u.data, 0x4001 + 8) == b"z" * 16360


def test_topics_and_tables():
    t = rec.Topics()
    for i in range(400):
        t.add(f"T{i % 3}" if i % 5 else "", f"/p{i}.htm" + ("#x" if i == 7 else ""))
    assert t.of("n", "P9.HTM") == 9 and t.of("new", "q.htm") == 400
    s = rec.Strings(1252)
    files = t.files(s, 1252)
    for i, (title, url, code, _) in enumerate(t.rows):
        _, at, row, found, _ = struct.unpack_from("<IIIHH", files["/#TOPICS"], 16 * i)
        assert row == 12 * i + 4 * (i // 341) and found == code == (0 if "#" in url else 6 if title else 2)
        assert (at == rec.NONE) if not title else text_at(s.data, at) == title.encode()
        _, number, place = struct.unpack_from("<III", files["/#URLTBL"], row)
        assert number == i and text_at(files["/#URLSTR"], place + 8) == url.encode()


def test_contents_tree_points_to_parents_siblings_and_children():
    nodes = [NODE(0, None, 0, ("name", "A"), ("local", "a.htm")), NODE(1, 0, 1, ("name", "B")), NODE(2, 0, 1, ("name", "C"), ("local", "x\\c.htm")), NODE(3, None, 0, ("name", "D"))]
    t, s = rec.Topics(), rec.Strings(1252)
    t.add("a", "a.htm")
    out = rec.contents(nodes, t, s)
    at = {0: 4096, 3: 4124, 1: 4144, 2: 4164}
    read = {i: struct.unpack_from("<HHIIII", out, p) for i, p in at.items()}
    assert read[0] == (0, 1, 12, 0, 0, 4124) and struct.unpack_from("<I", out, 4096 + 20)[0] == 4144
    assert read[3] == (0, 1, 0, s.at["D"], 0, 0)
    assert read[1] == (0, 1, 0, s.at["B"], 4096, 4164) and read[2] == (0, 2, 8, 1, 4096, 0)
    assert struct.unpack_from("<4I", out) == (4096, 4184 + 8, 2, 4184) and struct.unpack_from("<2I", out, 4184) == (0, 1)
    assert struct.unpack_from("<8I", out, 4192) == (4096, 0x29A, 4184, 0, 4164, 0x29B, 4188, 1)
    assert t.rows[1] == ["C", "x/c.htm", 2, 4164] and t.rows[0][3] == 4096


def test_listed_keywords():
    t = rec.Topics()
    nodes = [NODE(0, None, 0, ("name", "b"), ("local", "b.htm"), ("name", "other"), ("local", "o.htm")), NODE(1, 0, 1, ("name", "sub"), ("see also", "a")), NODE(2, None, 0, ("name", "A"), ("local", "B.htm"))]
    assert rec.listed_keywords(nodes, t) == [("a", "A", None, 0, 0, [0]), ("b", "b", None, 0, 0, [0, 1]), ("b, sub", "b, sub", "a", 1, 3, [])]
    assert [r[:2] for r in t.rows] == [["A", "B.htm"], ["other", "o.htm"]]


def test_windows_headers_and_settings():
    s = rec.Strings(1252)
    names = ["type", "caption", "toc", "idx", "default_file", "home", "jump1_file", "jump1_text", "jump2_file", "jump2_text"]
    w = dict.fromkeys(names, "") | {"type": "w", "caption": "Café", "home": "h.htm", "rect": [1, 2, -3, 4], "valid_flags": 18, "nav_style": 0x2520, "styles": 1, "ex_styles": 2, "show_state": 3, "nav_width": 180, "buttons": 7, "nav_closed": 0, "nav_default": 1, "nav_pos": 2, "notify_id": -1}
    out = rec.windows([w, w], s)
    assert len(out) == 8 + 2 * 196 and struct.unpack_from("<II", out) == (2, 196) and out[8:204] == out[204:]
    assert struct.unpack_from("<4i", out, 8 + 32) == (1, 2, -3, 4) and struct.unpack_from("<I", out, 8 + 0x4C)[0] == 180
    assert text_at(s.data, struct.unpack_from("<I", out, 8 + 0x14)[0]) == b"Caf\xe9"
    assert rec.windows([], s) == rec.subsets(0) == rec.context_map([], s) == b"" and rec.subsets(2) == struct.pack("<HH", 0, 24) + bytes(24)
    head = rec.index_header({"imagetype": "Folder", "background": "0x10"}, 5, ["m.chm"], s)
    assert len(head) == 4096 and struct.unpack_from("<I", head, 28)[0] == 1 and struct.unpack_from("<II", head, 32) == (16, rec.NONE)
    assert text_at(s.data, struct.unpack_from("<I", head, 80)[0]) == b"m.chm" and struct.unpack_from("<III", head, 68 + 0)[1:] == (1, 1)
    out = rec.system({"title": "T", "contents file": "a\\b.hhc"}, 932, 0x411, {"text": True, "keywords": False, "links": True, "contents": True}, 2, head)
    at, found = 12, []
    while at < len(out):
        kind, size = struct.unpack_from("<HH", out, at)
        found.append((kind, out[at + 4 : at + 4 + size]))
        at += 4 + size
    assert [k for k, _ in found] == [9, 4, 3, 0, 7, 11, 12, 13] and dict(found)[0] == b"a/b.hhc\0" and dict(found)[13] == head
    assert struct.unpack("<5I16x", dict(found)[4]) == (0x411, 1, 1, 0, 1)
