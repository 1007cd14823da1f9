"""The pipeline's language stage is fitted to every training document, whatever is broadcast."""

import zlib

import corpus_pipeline as pipeline
import numpy as np
import pytest
from lexforge.llm import langall, langid

held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0


def rows_of(df):
    return sorted(map(tuple, df.drop("code").distinct().collect()))


def test_words_of_every_training_document_are_known(spark):
    """More documents than a bounded sample takes, each of words of its own; held-out ones repeat these in another order."""
    r = np.random.default_rng(3)
    names = ["".join(map(chr, x)) for x in r.integers(97, 123, (3 * 6_000, 12))]
    ids = iter(range(10**6))
    trained = [(next(i for i in ids if not held(i)), " ".join(names[k : k + 3]), "en" if k % 2 else "de", "s", 38) for k in range(0, len(names), 3)]
    again = [(next(i for i in ids if held(i)), " ".join(reversed(names[k : k + 3])), None, "s", 38) for k in range(0, len(names), 3)]
    more = [(next(i for i in ids if not held(i)), f"{names[0]} {n}", "en", "s", 38) for n in "".join(names[:400])[:4_000]]
    odd = [(next(i for i in ids if held(i)), t, "en", "s", 9) for t in ("ж щ ъ", "123", "", None)]
    docs = spark.createDataFrame(trained + again + more + odd, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(8)
    kept = {x.doc_id for x in pipeline.unknown_language_out(spark, docs, "").select("doc_id").collect()}
    assert kept == {x[0] for x in trained + again + more}


@pytest.mark.parametrize("usual", [langall.USUAL, 20_000])
def test_what_is_broadcast_changes_nothing(spark, monkeypatch, usual):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(langall, "USUAL", usual)
    words = langall.train(docs)
    assert words.rest is None
    whole = rows_of(langall.judged(docs, words))
    for room in (200_000, 0):
        monkeypatch.setattr(langall, "WORD_BYTES", room)
        words = langall.train(docs)
        assert words.rest is not None and len(words.common[0]) <= room // 44
        assert rows_of(langall.judged(docs, words)) == whole


def test_small_tables_are_judged_as_by_langid(spark):
    """There its sample is all documents, and what occurs is usual."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    training = docs.where(~langid.held_out())
    model = langid.train(training)
    a, b = langall._keys()
    want = {(x.a, x.b): (x.lang_pred, x.familiarity) for x in langid.identify(docs, model, familiarity=True).where("lang_pred != 'und'").select(a, b, "lang_pred", "familiarity").collect()}
    judged = langall.judged(docs, langall.train(docs))
    got = {(x.a, x.b): (x.lang_pred, x.familiarity) for x in judged.collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-5) for k in want)
    whole = langid.cuts(training, model, max_docs=1 << 30)
    assert langall.cuts(judged, model.langs) == pytest.approx(whole, abs=1e-5)


def test_medians_are_exact(spark):
    r = np.random.default_rng(5)
    rows = [(k, float(x), float(y)) for k, n in ((0, 1), (1, 2), (2, 501), (3, 1000)) for x, y in zip(r.random(n), r.integers(0, 3, n) / 2, strict=True)]
    found = langall.medians(spark.createDataFrame(rows, "code int, own double, apart double"))
    for k in range(4):
        assert found[k, "own"] == np.median([x for c, x, _ in rows if c == k]) and found[k, "apart"] == np.median([y for c, _, y in rows if c == k])


def test_no_training(spark):
    docs = spark.createDataFrame([(1, "some text", None, "s", 9), (2, None, "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert langall.known(docs).count() == 0
    assert langall.known(docs.limit(0)).count() == 0
    lone = spark.createDataFrame([(2, "12 34", "en", "s", 5), (3, "one word", "en", "s", 8), (4, "one", "en", "s", 3)], docs.schema)
    assert {x.doc_id for x in langall.known(lone).collect()} == {3, 4}
    assert langall.known(lone.where("doc_id = 2")).count() == 0
