"""Encoders and decoders against libraries, other encoders and round trips."""

import base64
import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexforge.llm import arc, bpe, flat, tokens, webp
from lexforge.llm.queries import END_ID, tokenizer
from lexforge.llm.store import written

os.environ["TOKENIZERS_PARALLELISM"] = "false"

ODD = [
    "", "  ", "a", "It's 'S we'll o''s 'sx 'l 'll 're' \t\n x", " 'tis '", "don't  \n\n  stop\n", " <|endoftext|> hi<|startoftext|>", "a" * 70,
    "ÀÉÎ ß ñ × ÷ ÿ Àb", "日本語 テスト", "e\u0301 combining \u00a0 \u2003 nbsp", "ΑΣ ΣΑΣ", "x²³½ Ⅷ", "\x1c\x1d ctrl \x85 nel", "12345 6 78.9", "!!!'s ''s", "🎉🎉 emoji",
    "foo_bar __", "İstanbul", "a\x00b", "<|x|>", "' ", "'s", "x's'", "\r\n\r\n a", None,
]


def texts():
    r = random.Random(3)
    letters = "abstdmrevl' \n\t.,!éÀß12<|>日 "
    return ODD + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(800)]


def split(encoder, each):
    data, offsets = flat.texts_of(pa.array(each, pa.string()))
    for limit in (1 << 20, 200):
        for i, j in flat.pieces_of(offsets, limit):
            ids, counts = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ends = np.concatenate([[0], np.cumsum(counts)])
            for k in range(i, j):
                yield each[k] or "", ids[ends[k - i] : ends[k - i + 1]].tolist()


@pytest.mark.parametrize(("name", "load"), [("word_bpe_49k.json", bpe.load), ("byte_bpe_50k.json", tokens.load)])
def test_ids_are_the_librarys(name, load):
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(tokenizer(name)), load(tokenizer(name))
    for text, ids in split(encoder, texts()):
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        if load is bpe.load:
            assert encoder.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_a_full_table_starts_anew():
    encoder = bpe.Bpe(tokenizer("word_bpe_49k.json"))
    want = [ids for _, ids in split(encoder, texts()[:60])]
    encoder.table.limit = 5
    encoder.table.clear()
    assert [ids for _, ids in split(encoder, texts()[:60])] == want


def test_encoded_and_decoded_columns(spark):
    path = tokenizer("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "Hello world", "x"), (1, None, "y"), (None, "", "z")], "doc_id bigint, text string, n_tokens string")
    ids = bpe.encoded(docs, path)
    assert ids.columns == ["doc_id", "ids", "n_tokens"]
    assert sorted((r.text, r.n_tokens) for r in bpe.decoded(ids, path).collect()) == [("", 0), ("", 0), ("hello</w> world</w>", 2)]
    assert bpe.digests(docs.limit(0), path).count() == 0


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rows = [(i * 7 % 50, t) for i, t in enumerate(texts()[:49])] + [(None, "null id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    folder = f"file://{tmp_path}/store"
    tokens.write(docs, tokenizer("byte_bpe_50k.json"), folder, END_ID)
    found = sorted(tokens.read(spark, folder).collect(), key=lambda r: r.start)
    at = 0
    want = {}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [END_ID]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    for r in found:
        assert r.start == at
        at += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert tokens.manifest(folder)["width"] == 2
    assert tokens.write(docs.limit(0), tokenizer("byte_bpe_50k.json"), folder + "2", END_ID) >= 0 and tokens.read(spark, folder + "2").count() == 0
    # an end id beyond 16 bits: wide ids, known from the store; extra columns that clash with its own
    clash = docs.selectExpr("doc_id", "text", "1 as n_tokens", "'x' as h", "2 as start")
    tokens.write(clash, tokenizer("byte_bpe_50k.json"), folder + "4", 70_000)
    wide = {(r.start, r.n_tokens) for r in tokens.read(spark, folder + "4").collect()}
    assert tokens.manifest(folder + "4")["width"] == 4 and wide == {(r.start, r.n_tokens) for r in found}
    some = tokens.mapped(next((tmp_path / "store4").glob("*.bin")).as_uri(), "<u4")
    assert (some == 70_000).any()


def test_long_texts_are_encoded_in_slices(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(flat, "CHUNK", 64)
    monkeypatch.setattr(flat.portions, "__defaults__", (64,))
    monkeypatch.setattr(flat.in_slices, "__defaults__", (64,))
    r = random.Random(5)
    each = [" ".join(t or "" for t in texts()), "w" * 300, "a b  c\n" * 40, "\u00a0 x \u2003 y" * 30, *(("".join(r.choice("ab 's\n.É日") for _ in range(400))) for _ in range(40))]
    data, offsets = flat.texts_of(pa.array(each))
    for name, load in (("word_bpe_49k.json", bpe.load), ("byte_bpe_50k.json", tokens.load)):
        library, encoder = Tokenizer.from_file(tokenizer(name)), load(tokenizer(name))
        for i, _, parts in flat.portions(data, offsets):
            got = [encoder.encode(*x)[0] for x in parts]
            assert np.concatenate(got).tolist() == library.encode(each[i], add_special_tokens=False).ids


def test_digests_are_the_librarys(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "again"), (3, "again"), (None, "long word " * 90_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as ids_sha256", "'y' as n_tokens")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    path = tokenizer("word_bpe_49k.json")
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, path).collect()) == sorted(want)
    both = bpe.round_trip(docs.select("doc_id", "text"), path).collect()
    assert sorted((str(r.doc_id), len(r.ids), sha(" ".join(map(str, r.ids))), r.decoded_sha256) for r in both) == sorted(want)


def images():
    r = np.random.default_rng(1)
    for trial in range(36):
        h, w = int(r.integers(1, 24)), int(r.integers(1, 24))
        slope = np.add.outer(np.arange(h), np.arange(w))[..., None] * np.array([0, 3, 5, 7]) + r.integers(0, 3, (h, w, 4))
        yield trial, r, webp._join([r.integers(0, 256, (h, w, 4)), slope % 256, r.integers(0, 2 + trial, (h, w, 1)) * np.array([1, 2, 3, 4])][trial % 3])


def test_webp_transforms_caches_references_and_groups(monkeypatch):
    blocks = lambda n, size: (n + (1 << size) - 1) >> size
    for trial, r, x in images():
        h, w = x.shape
        modes = r.integers(0, 14, (blocks(h, 2), blocks(w, 2)))
        factors = r.integers(0, 2**32, (blocks(h, 3), blocks(w, 3)), dtype=np.uint64).astype(np.uint32)
        chains = [[], [(webp.PREDICTOR, modes, 2)], [(webp.CROSS_COLOUR, factors, 3)], [(webp.SUBTRACT_GREEN,)], [(webp.PREDICTOR, modes, 2), (webp.CROSS_COLOUR, factors, 3), (webp.SUBTRACT_GREEN,)]]
        if len(np.unique(x)) <= 256:
            chains.append([(webp.PALETTE,)])
        for chain in chains:
            for cache, references, groups in ((0, False, 0), (1, True, 2), (11, True, 0), (4, False, 3)):
                media = webp.encode(x, chain, cache, references, groups)
                assert (webp.decode(media) == x).all(), (trial, chain, cache, references, groups)
                with monkeypatch.context() as m:  # symbol by symbol
                    m.setattr(webp, "_by_tables", lambda *_: None)
                    assert (webp.decode(media) == x).all(), (trial, chain, cache, references, groups)


def test_webp_predictors_by_hand():
    left, top, right, corner = [10, 20, 30, 40], [50, 60, 70, 80], [5, 6, 7, 8], [12, 22, 32, 200]
    assert webp.predict(0, left, top, right, corner) == [255, 0, 0, 0]
    assert webp.predict(5, left, top, right, corner) == [28, 36, 44, 52]
    assert webp.predict(11, left, top, right, corner) == top
    assert webp.predict(12, left, top, right, corner) == [48, 58, 68, 0]
    assert webp.predict(13, left, top, right, corner) == [39, 49, 59, 0]


def payloads():
    r = np.random.default_rng(2)
    for n, top in ((64, 128), (128, 256), (64 * 16384, 256), (64 * 16385, 100), (64 * 700, 2), (64 * 700, 16), (64 * 3, 1)):
        yield r.integers(0, top, n).astype(np.uint8)
    yield np.cumsum(r.integers(0, 3, 64 * 5000)).astype(np.uint8)  # small steps
    prose = ("The quick brown fox, \u00e9 and so on. Of the fox the brown and quick. " * 64).encode()
    yield np.frombuffer(prose[: len(prose) // 64 * 64], np.uint8)
    yield np.frombuffer(np.array(r.choice(list("etaoin shrdlu,.ABCDEFG"), 64 * 3000).tolist(), "S1").tobytes(), np.uint8)


def test_webp_stores_payloads():
    for payload in payloads():
        media = webp.store(payload)
        assert media[:4] == b"RIFF" and media[8:16] == b"WEBPVP8L"
        assert (webp.load(media, len(payload)) == payload).all()
        for cut in (40, len(media) // 2):
            with pytest.raises((ValueError, struct.error, IndexError)):
                webp.load(media[:cut] if cut < len(media) else b"RIFF" * 3, len(payload))


def small_payloads():
    """Texts of a few KB, as most documents are, among payloads that take a palette, the predictor, or are large."""
    r = np.random.default_rng(4)
    words = ["".join(r.choice(list("etaoinshrdlu"), int(n))) for n in r.integers(1, 9, 400)]
    for k in range(120):
        text = " ".join(r.choice(words, int(r.integers(1, 700)))).encode()
        yield np.frombuffer(text + b"\0" * (-len(text) % 64), np.uint8)
        if k % 10 == 0:
            yield r.integers(0, (1, 2, 16, 17, 256)[k // 10 % 5], 64 * int(r.integers(1, 40))).astype(np.uint8)
            yield np.cumsum(r.integers(0, 3, 64 * int(r.integers(1, 400)))).astype(np.uint8)


def test_images_made_and_read_together_are_as_if_alone(monkeypatch):
    each = [*small_payloads(), *payloads()]
    alone = [webp.store(x) for x in each]
    for together in (1 << 13, 1 << 15, 1 << 22):
        monkeypatch.setattr(webp, "TOGETHER", together)
        monkeypatch.setattr(webp, "READ_TOGETHER", together)
        assert webp.store_all(each) == alone
        for x, got in zip(each, webp.load_all(alone, [len(x) for x in each]), strict=True):
            assert (x == got).all()
    with monkeypatch.context() as m:  # symbol by symbol
        m.setattr(webp, "_by_tables", lambda *_: None)
        assert all((webp.load(media, len(x)) == x).all() for x, media in zip(each[:12], alone, strict=False))
    assert webp.store_all([]) == [] and webp.load_all([], []) == []


def test_damage_among_images_read_together():
    each = list(small_payloads())[:9]
    sizes, media = [len(x) for x in each], [webp.store(x) for x in each]
    for k in (0, 4, 8):
        data = media[k][20 : 20 + struct.unpack("<I", media[k][16:20])[0]]
        for cut in (len(data) // 2, len(data) - 2):
            with pytest.raises((ValueError, IndexError)):
                webp.load_all([*media[:k], webp._riff(data[:cut]), *media[k + 1 :]], sizes)


def test_small_images_take_few_calls():
    """Calls, not seconds, so that the machine does not matter: one image at a time took 4,650, several together 1,950."""
    import cProfile
    import pstats

    each = [x for x in small_payloads() if len(x) < 4096]
    run = cProfile.Profile()
    run.runcall(lambda: webp.load_all(webp.store_all(each), [len(x) for x in each]))
    assert pstats.Stats(run).total_calls < 3000 * len(each)


def test_stored_images_use_the_format(monkeypatch):
    """Codes of several lengths, references, predictor, subtract-green and palettes occur in what ``store`` writes."""
    used = set()

    def spy(name):
        real = getattr(webp, name)

        def seen(*args):
            used.add(name)
            return real(*args)

        monkeypatch.setattr(webp, name, seen)

    for name in ("_resolved", "undo_predictor", "undo_palette", "add_green"):
        spy(name)
    read = webp.read_code

    def code(*args):
        out = read(*args)
        if len(set((out.table & 15).tolist())) > 1:
            used.add("codes of several lengths")
        return out

    monkeypatch.setattr(webp, "read_code", code)
    for payload in payloads():
        webp.load(webp.store(payload), len(payload))
    assert used == {"_resolved", "undo_predictor", "undo_palette", "add_green", "codes of several lengths"}


def test_a_foreign_stream():
    """The public one-pixel lossless image by which browsers are tested for the format."""
    media = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert webp.decode(media).shape == (1, 1)


def test_huffman_codes_are_optimal_and_bounded():
    r = random.Random(7)
    for trial in range(200):
        counts = {s: r.randint(1, 10 ** r.randint(0, 6)) for s in r.sample(range(280), r.randint(2, 90))}
        lengths = webp.code_lengths(counts, 30)
        heap, cost = sorted(counts.values()), 0
        while len(heap) > 1:
            a, b, *heap = heap
            heap = sorted([*heap, a + b])
            cost += a + b
        assert sum(counts[s] * n for s, n in lengths.items()) == cost
        short = webp.code_lengths(counts, 12)
        assert max(short.values()) <= 12 and sum(2.0**-n for n in short.values()) == 1, trial


def test_media_columns(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (3, "x" * 5000), (None, "y" * 64)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'a' as media")
    found = webp.measured(webp.stored(docs)).collect()
    for (i, t), r in zip(rows, found, strict=True):
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    assert found[1].feature == found[2].feature and found[1].media_sha256 == found[2].media_sha256
    assert webp.measured(webp.stored(docs.limit(0))).count() == 0
    long = spark.createDataFrame([(1, "long words of a very long text " * 100_000), (1, "long words of a very long text " * 100_000)], "doc_id bigint, text string")
    (a, b) = webp.measured(written(webp.stored(long))).collect()
    payload = ("long words of a very long text " * 100_000).encode()
    payload += b"\0" * (-len(payload) % 64)
    assert a == b and a.payload_sha256 == hashlib.sha256(payload).hexdigest() and a.media_bytes < len(payload) // 20


def test_arc_versions_and_damage():
    for version in (1, 2):
        data = arc.arc_head(version, "x.arc", "20240102030405")
        data += arc.arc_record(version, {"url": "http://a/b c", "ip": "1.2.3.4", "date": "199912", "content_type": "text/html"}, arc._response("7", b"<p>\n"))
        data += b"a broken line\n" + arc.arc_record(version, {"url": "dns:a", "date": "x", "ip": "0", "content_type": "text/dns"}, b"host")
        short = arc.arc_record(version, {"url": "http://s/", "ip": "0", "date": "2001", "content_type": "t"}, b"0123456789")[:-5]
        head, page, dns, cut = arc.parse_arc(data + short)
        assert head.fields["url"] == "filedesc://x.arc" and page.fields["url"] == "http://a/b c"
        assert arc.http_parts(page.block)[1] == b"<p>\n" and dns.block == b"host"
        assert cut.truncated and cut.block == b"012345"
        made = [arc.convert(x) for x in (head, page, dns, cut)]
        assert [m.headers["WARC-Type"] for m in made] == ["warcinfo", "response", "resource", "resource"]
        assert [m.headers["WARC-Date"] for m in made] == ["2024-01-02T03:04:05Z", "1999-12-01T00:00:00Z", "1970-01-01T00:00:00Z", "2001-01-01T00:00:00Z"]
        assert made[1].headers["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"<p>\n").hexdigest()
        assert made[3].headers["WARC-Truncated"] == "length"
        (again,) = arc.parse_warc(arc.opened(__import__("io").BytesIO(made[1].bytes())))
        assert again.block == page.block and again.http["X-Page"] == "7"
        assert len({m.headers["WARC-Record-ID"] for m in made}) == 4


def test_warc_round_trip_with_copies(spark, tmp_path):
    big, small = "é" * 60, "s" * 99
    rows = [(5, "http://a/", big), (2, None, big), (9, "x y\nz", big), (4, "filedesc:", small), (3, "u", small), (7, "v", None), (8, "w", ""), (2, "again", big), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/warc"
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in arc.read(spark, folder, arc.write(pages, folder)).collect()}
    assert got == {(5, 120, "revisit", 2), (2, 120, "response", None), (9, 120, "revisit", 2), (4, 99, "response", None), (3, 99, "response", None), (7, 0, "response", None), (8, 0, "response", None), (None, 120, "revisit", 2)}
    empty = f"file://{tmp_path}/none"
    assert arc.read(spark, empty, arc.write(pages.limit(0), empty)).count() == 0


def test_archives_are_read_in_linear_time():
    import io
    import time

    record = arc.arc_record(1, {"url": "http://a/", "ip": "0", "date": "2001", "content_type": "t"}, b"x" * 300)
    data = arc._packed(arc.arc_head(1, "a", "2001")) + b"".join(arc._packed(record) for _ in range(60_000))
    start = time.time()
    assert sum(1 for _ in arc.parse_arc(arc.opened(io.BytesIO(data)))) == 60_001
    assert time.time() - start < 20
    made = arc._packed(arc.WarcRecord({"WARC-Type": "resource"}, b"abc").bytes()) * 60_000
    start = time.time()
    assert sum(len(r.block) for r in arc.parse_warc(arc.opened(io.BytesIO(made)))) == 180_000
    assert time.time() - start < 20


def test_pages_of_every_kind_are_archived(spark, tmp_path):
    rows = [(1, "http://a/" + "u" * 5000, "long " * 400_000), (1, "http://a/", "long " * 400_000), (2, "http://b/", "HTTP/1.1 200 OK\r\n\r\n" + "z" * 200), (3, "c", "filedesc://x 1 2 3 4\n" * 20), (3, "c", "filedesc://x 1 2 3 4\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'q' as part", "'r' as digest", "1 as n")
    folder = f"file://{tmp_path}/kinds"
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for r in arc.read(spark, folder, arc.write(pages, folder)).collect())
    assert got == sorted((i, len(t), hashlib.sha256(t.encode()).hexdigest(), "response") for i, _, t in rows)
    heads = {p.name: p.read_bytes()[:2] for p in (tmp_path / "kinds").glob("*.arc")}
    assert b"\x1f\x8b" in heads.values()
