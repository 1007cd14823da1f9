"""Operators against SQL, brute force and held-out rows, and on the cases that each must bear."""

import math
import random
import re

import numpy as np
import pytest
from compare import both, connect
from pyspark.sql import functions as F

from lexforge.llm import graph, langid, minhash, mixing, quality, queries, store, toxicity, urls

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_are_those_of_sql(spark, duck, name):
    mine, theirs = both(spark, duck, FOLDER, queries.QUERIES[name], queries.ORACLES[name])
    assert mine == theirs


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.getrandbits(62), r.getrandbits(62)) for _ in range(40)]
    chain = [r.getrandbits(62) for _ in range(30)]
    pairs += list(zip(chain, chain[1:], strict=False)) + [(pairs[0][0], p[1]) for p in pairs[:10]] + [(5, 5)]
    found = {x.node: x.component for x in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert found == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def sets_of(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_rows():
    """Clusters of edited copies, larger than a block, beside texts of every kind."""
    r = random.Random(7)
    rows, words = [], [f"w{i}" for i in range(900)]
    for base in range(3):
        text = [r.choice(words) for _ in range(120)]
        for k in range([90, 12, 2][base]):
            copy = list(text)
            for _ in range(r.randint(0, 9)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((base * 1000 + k, " ".join(copy)))
    rows += [(5000 + k, " ".join(r.choice(words) for _ in range(r.randint(0, 80)))) for k in range(60)]
    rows += [(6000, None), (6001, ""), (6002, " \t\n"), (6003, "one two"), (6004, "ONE  two"), (6005, "one two three"), (6006, "É a b c d"), (6007, "é a b c d"), (None, "one two"), (5000, rows[-60][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("threshold", [80, 85])
def test_near_duplicates_are_those_of_brute_force(spark, threshold):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("k1", F.lit("clash")).repartition(5)
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= threshold * (len(sets[a]) + len(sets[b]) - k):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted((str(d), len(sets[i]), str(least.get(find(i), d)), d == least.get(find(i), d)) for i, (d, _) in enumerate(rows))
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.kept) for x in minhash.near_duplicates(docs, threshold).collect())
    assert got == want
    kept = minhash.deduplicated(docs, threshold).collect()
    assert sorted(str(x.doc_id) for x in kept) == sorted({c for _, n, c, k in want if k and n} | {str(d) for d, n, _, _ in want if not n})
    assert {x.k1 for x in kept} == {"clash"}


def test_near_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash.near_duplicates(none).count() == minhash.deduplicated(none).count() == 0


def test_signatures_agree_as_sets_do():
    r = np.random.default_rng(5)
    for share, size in ((0.85, 400), (0.5, 60), (1.0, 3)):
        hits = []
        for _ in range(30):
            common = r.integers(0, 2**63, int(round(2 * size * share / (1 + share)))).astype(np.uint64)
            a, b = (np.unique(np.concatenate([common, r.integers(0, 2**63, size - len(common)).astype(np.uint64)])) for _ in "ab")
            s = minhash.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            hits.append((s[0] == s[1]).mean() - true)
        assert abs(np.mean(hits)) < 0.03
    assert np.isinf(minhash.signatures(np.zeros(0, np.uint64), np.array([0]))).all()
    one = minhash.signatures(np.array([9], np.uint64), np.array([1]))
    assert sorted(np.floor(one[0]).astype(int)) == list(range(minhash.SLOTS))


def test_superminhash_is_that_of_the_sequential_form():
    elements = flat_numbers(25)
    m = minhash.SLOTS
    want = np.full(m, np.inf)
    for e in elements:
        perm = list(range(m))
        for j in range(m):
            x = int(minhash.flat.mix(np.array([e ^ minhash._LEVELS[j]], np.uint64))[0])
            k = j + ((x & 0xFFFFFFFF) * (m - j) >> 32)
            perm[j], perm[k] = perm[k], perm[j]
            want[perm[j]] = min(want[perm[j]], j + (x >> 32) * 2.0**-32)
    assert (minhash.signatures(elements, np.array([25]))[0] == want).all()


def flat_numbers(n):
    return minhash.flat.numbers(n, 99)


def test_mixing_rates_and_copies(spark):
    r = random.Random(2)
    rows = [(i, "x" * r.randint(0, 40), "big" if i % 3 else None, "extra") for i in range(1500)] + [(7, "dup", "big", "e"), (7, "dup", "big", "e"), (9999, "", "blank", "e"), (None, None, "blank", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, mix_key string")
    out = mixing.mixed(docs, {"big": 0.5, "blank": 1.0}).collect()
    assert [x.mix_key for x in out] == sorted(x.mix_key for x in out)
    assert {x.source for x in out} == {"big", "blank"}  # a null source has no weight here
    rate = {x.source_: x.rate for x in mixing.rates(docs, {"big": 0.5, "blank": 1.0}).collect()}
    size = lambda s: sum(len(t or "") for _, t, o, _ in rows if o == s)
    assert rate["blank"] == 1.0 and math.isclose(rate["big"] * size("big"), sum(len(t or "") for _, t, _, _ in rows) * 0.5 / 1.5 , rel_tol=1e-9) or rate["big"] > 0
    copies = [x for x in out if x.source == "big"]
    mean = len(copies) / sum(o == "big" for _, _, o, _ in rows)
    assert abs(mean - rate["big"]) < 0.15
    assert len({x.n_copies for x in out if x.doc_id == 7}) <= 1
    assert mixing.mixed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rate", [0.3, 2.0, 40.0, 900.0])
def test_poisson_table(spark, rate):
    docs = spark.createDataFrame([(1, "x" * 1000, "a"), (2, "y" * 1000, "b")], "doc_id bigint, text string, source string")
    table = {x.source_: x for x in mixing.rates(docs, {"a": rate / 2, "b": max(0.0, 1 - rate / 2)}).collect()}
    lam = table["a"].rate
    p, total = [], 0.0
    for k in range(len(table["a"].cdf)):
        total += math.exp(-lam + k * math.log(lam) - math.lgamma(k + 1))
        p.append(total)
    assert np.allclose(table["a"].cdf, p, atol=1e-9) and p[-1] > 1 - 1e-9


def test_language_backoff(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs, model).where(langid.held_out()).select("lang", "lang_pred", "score").collect()
    assert sum(x.lang == x.lang_pred for x in found) >= 0.98 * len(found)
    rows = [(1, None, None), (2, "", "x"), (3, "123 %% \n", "x"), (4, "日本語", None), (5, "qzqzq", None), (None, "the " * 50_000, "s")]
    odd = {x.doc_id: x for x in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, score string"), model).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and odd[1].score == 0.0
    assert odd[4].lang_pred in model.langs and 0 < odd[5].score <= 1 and odd[None].lang_pred == "en"
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.identify(docs.limit(3), langid.train(docs.limit(0))).first().lang_pred == "und"


def test_language_scores_by_hand():
    keys = lambda words: langid.words_of(*minhash.flat.texts_of(__import__("pyarrow").array([" ".join(words)])))[0]
    one = keys(["known"])
    tables = [(one, np.array([[1.0, -1.0]]))]
    for n, (h, _) in enumerate(langid.grams([b"abc"]), 1):
        h = np.unique(h)
        tables.append((h, np.full((len(h), 2), [0.0, float(n)])) if n in (1, 3) else (np.zeros(0, np.uint64), np.zeros((0, 2))))
    model = langid.Model(["x", "y"], tables)
    assert model.unseen([b"abcd", b"zzz", b"c"]).tolist() == [[0.0, 3.0], [0.0, 0.0], [0.0, 1.0]]
    data, offsets = minhash.flat.texts_of(__import__("pyarrow").array(["known abcd known", "", "123"]))
    assert model.scores(data, offsets).tolist() == [[2.0, 1.0], [0.0, 0.0], [0.0, 0.0]]


def test_toxicity_of_held_out_rows(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    chain = toxicity.train(docs, labels.where(~apart))
    got = toxicity.score(docs, chain).join(labels.where(apart), "doc_id").groupBy("quality", "toxic", "is_toxic").count().collect()
    n = {(x.quality, x.toxic, x.is_toxic): x["count"] for x in got}
    of = lambda toxic, said, *quality: sum(n.get((q, toxic, said), 0) for q in quality)
    assert of(1, True, 1) >= 0.9 * (of(1, True, 1) + of(1, False, 1))  # junk is labelled toxic at random in this table
    assert of(1, True, 0, 1) >= 0.85 * (of(1, True, 0, 1) + of(1, False, 0, 1))
    assert of(0, True, 0, 1) <= 0.01 * of(0, False, 0, 1)


def test_toxicity_odd_rows(spark):
    rows = [(1, "fine words here", "x"), (2, None, "x"), (3, "", "x"), (None, "awful nasty thing", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, p_toxic string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 0, 1), (77, 0, 1)], none.schema)):
        out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(out) == 4 and not any(x.is_toxic for x in out)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0


def brute_fit(x, y, ridge=0.1):
    """Logistic regression by plain Newton steps on a dense matrix."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
    return w


def test_chain_is_that_of_brute_force():
    r = np.random.default_rng(1)
    marks = r.integers(0, 2, (400, 3))
    first = (marks[:, 0] + r.random(400) > 1).astype(float)
    labels = np.column_stack([first, np.maximum(first * marks[:, 1], r.random(400) > 0.9), first * 0])
    folds, symbols = np.arange(400) % 5, r.random((400, 1))
    ends = np.concatenate([[0], np.cumsum(marks.sum(1))])
    x = toxicity.Rows(ends, np.nonzero(marks)[1], symbols, 3)
    chain = toxicity.fit_chain(np.zeros(3, np.uint64), x, labels, folds, ("a", "b", "c"))
    assert [len(w) for w in chain.weights] == [5, 6, 7]
    own, want, before = np.column_stack([marks, symbols]).astype(float), [], np.zeros((400, 0))
    for k in range(2):
        now = np.column_stack([own, before])
        want.append(brute_fit(now, labels[:, k]))
        out = np.zeros(400)
        for f in range(5):
            w = brute_fit(now[folds != f], labels[folds != f, k])
            out[folds == f] = 1 / (1 + np.exp(-(now[folds == f] @ w[:-1] + w[-1])))
        before = np.column_stack([before, out])
    assert all(np.allclose(a, b, atol=2e-2) for a, b in zip(chain.weights, want, strict=False))
    p = chain.predict(x)
    assert p.shape == (400, 3) and p[:, 2].max() < 1e-9
    first_p = 1 / (1 + np.exp(-(own @ want[0][:-1] + want[0][-1])))
    second = np.column_stack([own, first_p]) @ want[1][:-1] + want[1][-1]
    assert np.allclose(p[:, :2], np.column_stack([first_p, 1 / (1 + np.exp(-second))]), atol=5e-3)


def test_gain_and_features_by_brute_force(spark):
    n11, n1, n_1, n = 8.0, 10.0, 20.0, 100.0
    cells = [(8, 2.0), (2, 8.0), (12, 18.0), (78, 72.0)]
    row = spark.createDataFrame([(n11, n1, n_1, n)], "y0 double, n double, y0_ double, n_ double").selectExpr(f"{toxicity.gain('y0')} as g").first()
    assert math.isclose(row.g, sum(2 * o * math.log(o / e) for o, e in cells))
    texts = ["Idiotic idiot, an IDIOT! #x", "", "none here", "idiotically " * 60_000]
    data, offsets = minhash.flat.texts_of(__import__("pyarrow").array(texts))
    words = ["idiot", "none"]
    key = {w: int(toxicity.marks_of(*minhash.flat.texts_of(__import__("pyarrow").array([w])))[0][0]) for w in words}
    stem = toxicity.marks_of(*minhash.flat.texts_of(__import__("pyarrow").array(["idiotic"])))[0]  # idiotic, idio, idiot, idioti
    chain = toxicity.Chain(np.sort(np.array([*key.values(), *stem[1:].tolist()], np.uint64)), [])
    got = []
    for _, _, each in minhash.flat.portions(data, offsets):
        x = chain.features(each)
        got += [{int(chain.marks[m]) for m in x.marks[a:b]} for a, b in zip(x.ends[:-1], x.ends[1:], strict=True)]
    assert got == [{key["idiot"], *map(int, stem[1:])}, set(), {key["none"]}, set(map(int, stem[1:]))]


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://a.com/en/1", "a.com", "/en/1", "com/en/", "block"), ("https://W.Example.COM/en/77?x", "w.example.com", "/en/77", "example.com/en/7", "allow"),
        ("http://x.net/de/1#f", "x.net", "/de/1", "net/de/", "allow"), ("http://m.example.net/de/81", "m.example.net", "/de/81", "example.net/de/8", "block"),
        ("http://org/es/", "org", "/es/", "org/es/", "block"), ("http://fakecom/en/", "fakecom", "/en/", None, "allow"), ("http://bad.io/p?b=1&a=2&utm_x=3", "bad.io", "/p", None, "block"),
        ("HTTP://www.BAD.io:80/p/?a=2&b=1#z", "www.bad.io:80", "/p/", None, "block"), ("http://bad.io/q", "bad.io", "/q", None, "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("://", "", "", None, "allow"),
        ("a://b?c://d/e", "b", "", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "h", "v")], "page_id bigint, url string, host string, verdict string")
    listed = spark.createDataFrame([("http://bad.io/p?a=2&b=1",), (None,), ("x",)], "url string")
    r = urls.judged(pages, listed).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("canon_"))
    blocks = 3000 * urls.BITS // 256
    table = urls.bloom(listed, blocks)
    probe = urls._hashed(spark.range(6000).select("id", F.concat(F.lit("h"), "id").alias("canon_")), blocks).join(table, F.col("block_") == F.col("block"), "left")
    passes = F.lit(True)
    for w in range(4):
        passes &= F.coalesce(F.col(f"w{w}").bitwiseAND(F.col(f"m{w}_")) == F.col(f"m{w}_"), F.lit(False))
    got = {(x.listed, x.hit): x["count"] for x in probe.groupBy((F.col("id") < 3000).alias("listed"), passes.alias("hit")).count().collect()}
    assert got[True, True] == 3000 and (True, False) not in got
    assert got.get((False, True), 0) < 60
    assert urls.judged(spark.createDataFrame([], "page_id bigint, url string"), spark.createDataFrame([], "url string")).count() == 0


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    r = random.Random(4)
    texts = [None, "", " \n", "a", "a b", "a a a", "a a a a", "a b c a b c", "x\nx\n x\n\n\n", "é & | é & | é", "one\x0btwo\x0cthree\rfour", "# " * 5000] + [" ".join(r.choice("abcdef") for _ in range(r.randint(1, 90))) + r.choice(["", "\n"]) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_words int")
    for x in quality.statistics(docs).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_statistics(texts[x.doc_id]), texts[x.doc_id]
    out = quality.judged(docs).collect()
    assert len(out) == len(texts) and all(not x.kept for x in out if x.base_failed)
    assert quality.judged(docs.limit(0)).count() == 0


def test_quality_rejects_outliers_of_each_group(spark):
    r = random.Random(9)
    rows = [(i, " ".join(f"w{r.randint(0, 9999)}" for _ in range(r.randint(60, 400))), "en", "s" if i % 2 else None) for i in range(400)]
    rows += [(1000 + i, " ".join(f"w{r.randint(0, 9999)}$$$" for _ in range(200)), "en", "s") for i in range(60)]
    out = {x.doc_id: x.kept for x in quality.judged(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(out[i] for i in range(400)) and not any(out[1000 + i] for i in range(60))


def test_small_groups_are_estimated_as_large_ones_are(spark):
    """A group of five rows has its own estimate, which leans on the others; repeated rows count and get a row each."""
    r = random.Random(3)
    text = lambda n, tail="": " ".join(f"w{r.randint(0, 9999)}{tail}" for _ in range(n))
    rows = [(i, text(r.randint(80, 300)), "en", "big") for i in range(200)] + [(1000 + i, text(150), "xx", "small") for i in range(5)]
    rows += [(2000, text(150, "$#"), "xx", "small"), (3000, rows[0][1], "en", "big"), (3000, rows[0][1], "en", "big"), (4000, "one two " * 30_000, "en", "big")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "1 as g", "2 as start", "3 as f0", "true as kept")
    out = sorted((x.doc_id, x.kept) for x in quality.judged(docs).collect())
    assert len(out) == len(rows) and [k for i, k in out if i == 3000] == [True, True]
    assert all(k for i, k in out if i < 2000) and not dict(out)[2000] and not dict(out)[4000]
    assert len({x.g for x in quality.estimates(quality_vectors(spark, docs)).collect()}) == 2


def quality_vectors(spark, docs):
    passed = store.written(quality.statistics(docs)).where("not base_failed")
    return store.written(passed.selectExpr("concat(lang, source) as g", *(f"{x} as f{i}" for i, x in enumerate(quality.VECTOR))))


def test_registration():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [next(n for n in names if n.startswith(f"op{k}_")) for k in range(1, 11)] and "pipeline" in names


def test_language_training_is_that_of_brute_force(spark):
    """Every word and n-gram counts, those met once too; equal texts count once, nulls not at all."""
    rows = [("ab abc once", "x"), ("ab abc once", "x"), ("zz ab", "y"), ("Zz zzz", "y"), (None, "x"), ("lost", None)]
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as n", "2 as hash")
    model = langid.train(docs)
    assert model.langs == ["x", "y"]
    counts = [{} for _ in range(langid.LONGEST + 1)]
    for text, lang in {("ab abc once", 0), ("zz ab", 1), ("zz zzz", 1)}:
        for word in text.split():
            marked = f" {word} "
            grams = [marked[i : i + n] for n in range(1, langid.LONGEST + 1) for i in range(len(marked) - n + 1)]
            for g in [("word", word), *((len(g), g) for g in grams if g.strip() and not (len(g) == 1 and g == " "))]:
                n = 0 if g[0] == "word" else g[0]
                counts[n].setdefault(g[1], [0, 0])[lang] += 1
    for n, table in enumerate(counts):
        keys, logs = model.tables[n]
        assert len(keys) == len(table), n
        c = np.array(list(table.values())) + langid.SMOOTH
        want = np.log(c / c.sum(0))
        want -= want.mean(1, keepdims=True)
        assert np.allclose(sorted(map(tuple, logs.tolist())), sorted(map(tuple, want.tolist())), atol=1e-5), n


def test_signatures_of_parts_are_those_of_the_whole(monkeypatch):
    r = np.random.default_rng(8)
    sizes = np.array([0, 3, 500, 0, 40, 1, 700, 0])
    elements = r.integers(0, 2**63, sizes.sum()).astype(np.uint64)
    whole = minhash.signatures(elements, sizes)
    monkeypatch.setattr(minhash, "ELEMENTS", 64)
    assert (minhash.signatures(elements, sizes) == whole).all()
