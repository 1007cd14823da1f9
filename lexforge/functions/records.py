"""The small record files of a project's archive: strings, URLs, topics, contents, windows, settings.

They refer to one another by offset, so all of one project are made together, from its relations as lists of dicts. They take
some bytes for each page, node and string of one archive, which a task holds.
"""

from __future__ import annotations

import struct

from lexforge.functions import charset, index_bytes, text

# Fixed values of the formats.
STRING_BLOCK, URL_BLOCK, TOC_START, HEADER_SIZE, MERGED_MOST, WINDOW_SIZE = 0x1000, 0x4000, 4096, 4096, 1004, 196
NONE = 0xFFFFFFFF
VERSION_NAME = "lexforge"
#: Codes of settings that are texts, and the project options that they hold.
TEXT_SETTINGS = [(2, "default topic"), (3, "title"), (16, "default font"), (0, "contents file"), (1, "index file"), (5, "default window")]


def _fold(s: str) -> str:
    return s.translate(str.maketrans(text.UPPER, text.LOWER))


def _number(s: str) -> int:
    """A number in hexadecimal (0x), octal (0) or decimal digits; 0 without one."""
    s = s.strip().lower()
    try:
        return int(s, 16) if s.startswith("0x") else int(s, 8) if s[:1] == "0" and s != "0" else int(s)
    except ValueError:
        return 0


class Pool:
    """Different strings, each with its offset; ``head`` bytes stand before a string, and one that fits in a block does not
    cross the end of one."""

    def __init__(self, block: int, head: int, codepage: int):
        self.block, self.head, self.codepage = block, head, codepage
        self.data, self.at = bytearray(), {}

    def put(self, value: str) -> int:
        if value not in self.at:
            raw = bytes(self.head) + charset.encode(value, self.codepage) + b"\0"
            left = self.block - len(self.data) % self.block
            if left < len(raw) <= self.block:
                self.data += bytes(left)
            if self.head and len(self.data) % self.block == 0:
                self.data += b"\0"  # no URL is at the start of a block
            self.at[value] = len(self.data)
            self.data += raw
        return self.at[value]


class Strings(Pool):
    """The archive's strings; the empty one is at 0."""

    def __init__(self, codepage: int):
        super().__init__(STRING_BLOCK, 0, codepage)
        self.data += b"\0"
        self.at[""] = 0

    def optional(self, value: str, none: int = NONE) -> int:
        return self.put(value) if value else none


class Topics:
    """Numbered pages and targets, with their title, URL, contents code and place in the contents."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.by_url: dict[str, int] = {}

    def add(self, title: str, url: str, code: int | None = None) -> int:
        url = url.removeprefix("/")
        if code is None:
            code = 0 if "#" in url else 6 if title else 2
        self.rows.append([title, url, code, 0])
        self.by_url.setdefault(_fold(url), len(self.rows) - 1)
        return len(self.rows) - 1

    def of(self, title: str, url: str, code: int | None = None) -> int:
        """The number of a URL, which is added if it is new."""
        found = self.by_url.get(_fold(url.removeprefix("/")))
        return self.add(title, url, code) if found is None else found

    def files(self, strings: Strings, codepage: int) -> dict[str, bytes]:
        urls, table, out = Pool(URL_BLOCK, 8, codepage), bytearray(), bytearray()
        for i, (title, url, code, place) in enumerate(self.rows):
            at = urls.put(url)
            if len(table) % 0x1000 == 0xFFC:
                table += bytes(4)
            out += struct.pack("<IIIHH", place, strings.optional(title), len(table), code, 0)
            table += struct.pack("<III", 0, i, at)
        return {"/#TOPICS": bytes(out), "/#URLSTR": bytes(urls.data), "/#URLTBL": bytes(table)} if self.rows else {}


def _params(node: dict, name: str) -> list[str]:
    return [p["value"] for p in node["params"] if p["name"] == name]


def _param(node: dict, name: str) -> str:
    return next(iter(_params(node, name)), "")


def contents(nodes: list[dict], topics: Topics, strings: Strings) -> bytes:
    """The contents tree in level order: a node takes 20 bytes, 28 with children."""
    order = sorted(nodes, key=lambda n: (n["depth"], n["node_id"]))
    kids: dict = {}
    for n in order:
        kids.setdefault(n["parent_id"], []).append(n["node_id"])
    place, at = {}, TOC_START
    for n in order:
        place[n["node_id"]] = at
        at += 28 if n["node_id"] in kids else 20
    following = {a: b for own in kids.values() for a, b in zip(own, own[1:], strict=False)}
    info, targets = bytearray(), []
    for n in order:
        own, later = kids.get(n["node_id"]), following.get(n["node_id"])
        local = _param(n, "local").replace("\\", "/")
        if local:
            refers = topics.of(_param(n, "name"), local, 2)
            topics.rows[refers][3] = place[n["node_id"]]
            targets.append((place[n["node_id"]], refers))
        else:
            refers = strings.put(_param(n, "name"))
        info += struct.pack("<HHIIII", 0, len(targets) & 0xFFFF, (4 if own else 0) | (8 if local else 0), refers, place.get(n["parent_id"], 0), 0 if later is None else place[later])
        info += struct.pack("<II", place[own[0]], 0) if own else b""
    numbers = b"".join(struct.pack("<I", t) for _, t in targets)
    entries = b"".join(struct.pack("<IIII", p, 0x29A + i, at + 4 * i, t) for i, (p, t) in enumerate(targets))
    return struct.pack("<IIII", TOC_START, at + len(numbers), len(targets), at).ljust(TOC_START, b"\0") + info + numbers + entries


def listed_keywords(nodes: list[dict], topics: Topics) -> list[tuple]:
    """(sort key, display, see also, depth, char index, topics) of an index file: top keywords by name, each followed by those
    below it, with names joined by a comma and a space."""
    kids: dict = {}
    for n in sorted(nodes, key=lambda n: n["node_id"]):
        kids.setdefault(n["parent_id"], []).append(n)
    out = []
    left = [(n, _param(n, "name"), 0, 0) for n in sorted(kids.get(None, []), key=lambda n: _fold(_param(n, "name")), reverse=True)]
    while left:
        n, path, depth, begin = left.pop()
        see, found = _param(n, "see also"), []
        if not see:
            name = _param(n, "name")
            for p in n["params"]:
                if p["name"] == "name":
                    name = p["value"]
                elif p["name"] == "local":
                    found.append(topics.of(name, p["value"].replace("\\", "/")))
        out.append((_fold(path), path, see or None, depth, begin, found))
        left += [(k, f"{path}, {_param(k, 'name')}", depth + 1, len(path.encode()) + 2) for k in reversed(kids.get(n["node_id"], []))]
    return out


def windows(rows: list[dict], strings: Strings) -> bytes:
    u = lambda v: (v or 0) & NONE
    out = struct.pack("<II", len(rows), WINDOW_SIZE) if rows else b""
    for w in rows:
        s = {k: strings.put(w[k] or "") for k in ("type", "caption", "toc", "idx", "default_file", "home", "jump1_text", "jump2_text", "jump1_file", "jump2_file")}
        out += struct.pack("<8I4iI24xI16x", WINDOW_SIZE, 0, s["type"], u(w["valid_flags"]), u(w["nav_style"]), s["caption"], u(w["styles"]), u(w["ex_styles"]), *w["rect"], u(w["show_state"]), u(w["nav_width"]))
        out += struct.pack("<9I20xI4I24x", s["toc"], s["idx"], s["default_file"], s["home"], u(w["buttons"]), u(w["nav_closed"]), u(w["nav_default"]), u(w["nav_pos"]), u(w["notify_id"]), 0, s["jump1_text"], s["jump2_text"], s["jump1_file"], s["jump2_file"])
    return out


def subsets(count: int) -> bytes:
    return struct.pack("<HH", 0, 12 * count) + bytes(12 * count) if count else b""


def context_map(rows: list[dict], strings: Strings) -> bytes:
    pairs = [struct.pack("<II", r["id"] & NONE, strings.put(r["file"])) for r in sorted(rows, key=lambda r: r["id"])]
    return struct.pack("<I", 8 * len(pairs)) + b"".join(pairs) if pairs else b""


def index_header(properties: dict[str, str], topics: int, merged: list[str], strings: Strings) -> bytes:
    """The 4096 bytes of the site's looks and of merged files. More merged files than it has room for are an error."""
    if len(merged) > MERGED_MOST:
        raise ValueError(f"more than {MERGED_MOST} merged files")
    get = lambda name: properties.get(name, "")
    colour = lambda name: _number(get(name)) & NONE if get(name) else NONE
    name = lambda key, none=NONE: strings.optional(get(key), none)
    numbers = [0, 1, topics, 0, name("imagelist"), 0, int(_fold(get("imagetype")) == "folder"), colour("background"), colour("foreground"), name("font"), NONE, 0, NONE]
    numbers += [name("framename", 0), name("windowname"), 0, 1, len(merged), 1 if merged else 0, *map(strings.put, merged)]
    return (b"T#SM" + struct.pack(f"<{len(numbers)}I", *numbers)).ljust(HEADER_SIZE, b"\0")


def setting(kind: int, value: bytes) -> bytes:
    return struct.pack("<HH", kind, len(value)) + value


def system(options: dict[str, str], codepage: int, lcid: int, has: dict[str, bool], info_types: int, header: bytes) -> bytes:
    """Settings in their order. has: which of text, keywords, links and contents the archive has as index files."""
    string = lambda kind, value: setting(kind, charset.encode(value, codepage) + b"\0")
    number = lambda kind, value: setting(kind, struct.pack("<I", value))
    out = struct.pack("<IHHI", 3, 10, 4, 0) + string(9, VERSION_NAME)
    out += setting(4, struct.pack("<5IQII", lcid, codepage in charset.DBCS, has["text"], has["keywords"], has["links"], 0, 0, 0))
    for kind, name in TEXT_SETTINGS:
        value = options.get(name, "")
        value = value.replace("\\", "/") if kind in (0, 1, 2) else value
        out += string(kind, value) if value else b""
    out += number(7, 0) if header else b""
    out += number(11, 0) if has["contents"] else b""
    out += number(12, info_types) if info_types else b""
    return out + (setting(13, header) if header else b"")


def _true(options: dict, *names: str) -> bool:
    return any(_fold(options.get(n, "").strip()) in ("yes", "true", "1") for n in names)


def project_files(facts: dict[str, list[dict]], codepage: int, lcid: int) -> tuple[dict[str, bytes], dict[str, bytes]]:
    """(files of the compressed section, raw files) of one project. facts: its rows by kind: option (key, value), topic (topic,
    title, url, in_contents), toc and index (site map nodes), property (name, value), keyword and link (sort_key, display,
    topics), window, context (id, file), merge, subset and type (value). An index file is made only where its option is set."""
    rows = lambda kind: facts.get(kind, [])
    options = {r["key"]: r["value"] for r in rows("option")}
    if rows("window"):
        options.setdefault("default window", rows("window")[0]["type"])
    strings, topics, files = Strings(codepage), Topics(), {}
    files["/#IVB"] = context_map(rows("context"), strings)
    for t in sorted(rows("topic"), key=lambda t: t["topic"]):
        topics.add(t["title"] or "", t["url"], t["in_contents"])
    for name in ("contents file", "index file"):
        if options.get(name):
            topics.add("", options[name].replace("\\", "/"), 2)
    binary_toc, binary_index = (_true(options, n) and bool(rows(k)) for n, k in (("binary toc", "toc"), ("binary index", "index")))
    toc = contents(rows("toc"), topics, strings) if binary_toc else b""
    listed = listed_keywords(rows("index"), topics) if binary_index else []
    marked = lambda kind: [(k["sort_key"], k["display"], None, 0, 0, k["topics"]) for k in sorted(rows(kind), key=lambda k: k["sort_key"].encode())]
    order = lambda found: [k[1:] for k in sorted(found, key=lambda k: k[0].encode())]
    keywords, links = order(listed + marked("keyword")), order(marked("link"))
    merged = [r["value"] for r in rows("merge")]
    header = index_header({p["name"]: p["value"] for p in reversed(rows("property"))}, len(topics.rows), merged, strings) if binary_index or merged else b""
    files |= topics.files(strings, codepage) | {"/#TOCIDX": toc}
    for folder, found in (("/$WWKeywordLinks/", keywords), ("/$WWAssociativeLinks/", links)):
        if found:
            files |= {folder + k: v for k, v in index_bytes.write_keywords(found, codepage, lcid).items()}
    if keywords and not links:
        files["/$WWAssociativeLinks/Property"] = bytes(4)
    files |= {"/#WINDOWS": windows(rows("window"), strings), "/#SUBSETS": subsets(len(rows("subset"))), "/#IDXHDR": header, "/#STRINGS": bytes(strings.data)}
    has = {"text": _true(options, "full-text search", "full text search") and bool(rows("text")), "keywords": bool(keywords), "links": bool(links), "contents": binary_toc}
    return {k: v for k, v in files.items() if v}, {"/#ITBITS": b"", "/#SYSTEM": system(options, codepage, lcid, has, len(rows("type")), header)}
