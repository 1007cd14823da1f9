"""Languages as ``langid`` names them, with tables counted over every training document, and cuts set from all of them.

Words and n-grams, and the sums of log frequencies, are those of ``langid``; nothing is sampled. What grows with the corpus
stays in tables of the shared folder: a row for each different word of all documents, with its evidence (its log
frequencies or, if training lacks it, those of its n-grams; its familiarity; its familiarity to the other languages). The
words met most often, WORD_BYTES of them, go to the executors as a broadcast; occurrences of all others are joined by shuffle.
N-grams, which are few (4 % of the words' bytes on the check tool's tables), are one broadcast, with ``langid.MAX_TABLE`` as
the bound beyond which there is an error. Evidence is in whole numbers of 1 / UNIT, so sums depend neither on the order
of rows nor on what is broadcast.

Familiarity counts what is usual, not what was ever met: with all of a growing corpus nearly every n-gram has been met, those
of other languages too. A word or n-gram is usual in a language if it makes up one in USUAL of the letters' places there,
by the counts of all documents; in a language of fewer letters, if it occurs. ``langid`` has the same measure by its sample's bound.

Documents of one text are judged once, by two 64-bit hashes of the text. A document counts once for each language that
names it; held-out ones, and those without a language, are not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm import flat, langid
from lexforge.llm.store import bounded, written

#: Bytes of words' evidence that are broadcast; the words beyond are joined by shuffle.
WORD_BYTES = 32 << 20
#: Letters of a language in which a word or n-gram that counts for familiarity occurs once.
USUAL = langid.MAX_CHARS
#: Evidence is rounded to parts of one.
UNIT = 1 << 20
#: Letters of words whose n-grams are counted at once; classes in which a median is looked for first.
LETTERS, BINS = 400_000, 4_096


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches of ``data`` as strings."""
    lengths = ends - starts
    places = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[flat.ragged(starts, lengths)])))


def _count(n_langs: int):
    """(word, code, times) of lower-cased texts, summed over a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat.texts_of(batch.column("text"))
            codes = batch.column("code").to_numpy()
            for i, j, each in flat.portions(data, offsets):
                for own, places in each:
                    hashes, starts, ends, counts = langid.words_of(own, places)
                    if not len(hashes):
                        continue
                    number, unique = pd.factorize(hashes)
                    first = np.empty(len(unique), np.int64)
                    first[number[::-1]] = np.arange(len(number))[::-1]
                    both, times = np.unique(number * (n_langs + 1) + np.repeat(codes[i:j], counts), return_counts=True)
                    word = first[both // (n_langs + 1)]
                    yield pa.RecordBatch.from_arrays([_texts(own, starts[word], ends[word]), pa.array((both % (n_langs + 1)).astype(np.int32)), pa.array(times)], ["word", "code", "times"])

    return flat.released(run)


def _matrix(batch: pa.RecordBatch | pa.Table, prefix: str, n: int) -> np.ndarray:
    return np.column_stack([batch.column(f"{prefix}{k}").to_numpy() for k in range(n)])


def _grams(n_langs: int):
    """(n, hash, times in each language) of the words' n-grams, summed over many words."""

    def counted(words: list[bytes], times: np.ndarray) -> Iterator[pa.RecordBatch]:
        for n, (hashes, word) in enumerate(langid.grams(words), 1):
            number, unique = pd.factorize(hashes)
            sums = [np.bincount(number, times[word, k], len(unique)).astype(np.int64) for k in range(n_langs)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unique), n, np.int8)), pa.array(unique.view(np.int64)), *map(pa.array, sums)], ["n", "hash", *(f"t{k}" for k in range(n_langs))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, times, letters = [], [], 0
        for batch in batches:
            words += [x.encode() for x in batch.column("word").to_pylist()]
            times.append(_matrix(batch, "c", n_langs))
            letters += batch.column("word").nbytes
            if letters > LETTERS:
                yield from counted(words, np.concatenate(times))
                words, times, letters = [], [], 0
        if words:
            yield from counted(words, np.concatenate(times))

    return flat.released(run)


def _logs(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Log frequencies against their mean over the languages."""
    logs = np.log((counts + langid.SMOOTH) / sums)
    return logs - logs.mean(1, keepdims=True)


def _shares(usual: np.ndarray, model: langid.Model, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Familiarity of words, then that to the languages other than each: 1 if the word is usual there (a row of
    ``usual``), otherwise the share of its n-grams (of ``langid.grams``) that are."""
    n_langs = usual.shape[1]
    anywhere = lambda u: np.column_stack([u.any(1), *(np.delete(u, k, 1).any(1) for k in range(n_langs))])
    total, lengths = np.zeros((len(usual), n_langs + 1)), np.zeros((len(usual), 1))
    for n in langid.FAMILIAR:
        hashes, word = found[n - 1]
        times = np.bincount(word, minlength=len(usual))[:, None]
        lengths += times > 0
        if len(model.seen[n]) and len(hashes):
            at, known = model.find(n, hashes)
            of = anywhere(model.seen[n])[at] & known[:, None]
            total += np.column_stack([np.bincount(word, x, len(usual)) for x in of.T]) / np.maximum(times, 1)
    return np.where(anywhere(usual), 1.0, total / np.maximum(lengths, 1))


def _evidence(shared, sums: np.ndarray, letters: np.ndarray):
    """(hash, total, evidence): for each word its scores, familiarity and familiarity to the languages other than each."""
    n_langs = len(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: langid.Model = shared.value
        for batch in batches:
            words = [x.encode() for x in batch.column("word").to_pylist()]
            counts = _matrix(batch, "c", n_langs + 1)
            data, offsets = flat.texts_of(batch.column("word"))
            hashes = flat.run_hashes(data, offsets)
            out = np.zeros((len(words), 2 * n_langs + 1))
            for a, b in flat.pieces_of(offsets, LETTERS):
                own, found = counts[a:b, :n_langs], langid.grams(words[a:b])
                trained = own.any(1)
                scores = _logs(own, sums)
                if not trained.all():
                    scores[~trained] = model.unseen(words[a:b], found)[~trained]
                out[a:b, :n_langs] = scores
                out[a:b, n_langs:] = _shares((own > 0) & (own * float(USUAL) >= letters), model, found)
            whole = np.rint(out * UNIT).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts.sum(1)), *map(pa.array, np.ascontiguousarray(whole.T))], ["hash", "total", *(f"x{k}" for k in range(whole.shape[1]))])

    return flat.released(run)


class Words:
    """Languages and the evidence of every word: ``common`` (sorted hashes, evidence) to broadcast, ``rest`` a table of the
    other words, or None without any."""

    def __init__(self, langs: list[str], common: tuple[np.ndarray, np.ndarray], rest: DataFrame | None):
        self.langs, self.common, self.rest = langs, common, rest


def _coded(docs: DataFrame, langs: list[str]) -> DataFrame:
    """(text, code) of documents with a text; code is the number of the language of a training document, else that after the last."""
    numbers = F.create_map(*(x for k, name in enumerate(langs) for x in (F.lit(name), F.lit(k))))
    code = F.when(~langid.held_out(), numbers[F.col("lang").cast("string")])
    return docs.where("text is not null").select("text", F.coalesce(code, F.lit(len(langs))).alias("code"))


def train(docs: DataFrame) -> Words:
    """The evidence of every word of ``docs`` (doc_id, text, lang), by all documents that are not held out."""
    training = docs.where(~langid.held_out() & F.expr("text is not null and lang is not null"))
    langs = sorted(r.lang for r in training.select(F.col("lang").cast("string").alias("lang")).distinct().limit(langid.MAX_LANGS + 1).collect())
    if len(langs) > langid.MAX_LANGS:
        raise ValueError(f"lang has more than {langid.MAX_LANGS} values")
    size = 2 * len(langs) + 1
    if not langs:
        return Words([], (np.zeros(0, np.uint64), np.zeros((0, size), np.int32)), None)
    names = range(len(langs))
    coded = _coded(docs, langs)
    counted = coded.where(F.col("code") < len(langs)).dropDuplicates(["text", "code"]).unionByName(coded.where(F.col("code") == len(langs)))
    counted = counted.select(F.lower("text").alias("text"), "code").mapInArrow(_count(len(langs)), "word string, code int, times bigint")
    words = written(counted.groupBy("word").agg(*(F.sum(F.when(F.col("code") == k, F.col("times")).otherwise(0)).alias(f"c{k}") for k in range(len(langs) + 1))))
    trained = words.where(" or ".join(f"c{k} > 0" for k in names))
    sums = trained.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(x), F.lit(0)) for x in (*(F.col(f"c{k}") for k in names), *(F.col(f"c{k}") * F.length("word") for k in names)))).first()
    letters = np.array(sums[1 + len(langs) :], float)

    kinds = ", ".join(f"t{k} bigint" for k in names)
    found = written(trained.mapInArrow(_grams(len(langs)), f"n tinyint, hash bigint, {kinds}").groupBy("n", "hash").agg(*(F.sum(f"t{k}").alias(f"t{k}") for k in names)))
    if found.count() * (8 + 5 * len(langs)) > langid.MAX_TABLE:
        raise ValueError(f"the n-grams would take more than {langid.MAX_TABLE} bytes")
    got = found.toArrow()  # at most MAX_TABLE bytes
    length, hashes, times = got.column("n").to_numpy(), got.column("hash").to_numpy().view(np.uint64), _matrix(got, "t", len(langs))
    tables, seen = [(np.zeros(0, np.uint64), np.zeros((0, len(langs))))], [np.zeros((0, len(langs)), bool)]
    for n in range(1, langid.LONGEST + 1):
        of = np.flatnonzero(length == n)
        of = of[np.argsort(hashes[of])]
        own = times[of]
        tables.append((hashes[of], _logs(own, (own + langid.SMOOTH).sum(0)).astype(np.float32)))
        seen.append((own > 0) & (own * float(USUAL) >= letters))
    table = _table(words, langid.Model(langs, tables, seen), np.array(sums[1 : 1 + len(langs)]) + langid.SMOOTH * max(sums[0], 1), letters)

    # The words met most often: whole classes of powers of two, as many as there is room for.
    room, least = WORD_BYTES // (8 + 4 * size), 63
    classes = {r.c: r["count"] for r in table.groupBy(F.floor(F.log2("total")).cast("int").alias("c")).count().collect()}  # 63 at most
    for c in sorted(classes, reverse=True):
        room -= classes[c]
        if room < 0:
            break
        least = c
    common = table.where(F.floor(F.log2("total")) >= least).drop("total").toArrow()  # at most WORD_BYTES
    order = np.argsort(keys := common.column("hash").to_numpy().view(np.uint64))
    rest = table.where(F.floor(F.log2("total")) < least) if classes and min(classes) < least else None
    return Words(langs, (keys[order], _matrix(common, "x", size)[order]), rest)


def _table(words: DataFrame, model: langid.Model, sums: np.ndarray, letters: np.ndarray) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"x{k} int" for k in range(2 * len(letters) + 1))
    table = written(words.mapInArrow(_evidence(shared, sums, letters), f"hash bigint, total bigint, {kinds}"))
    shared.destroy()
    return table


def _sums(shared, n_langs: int):
    """For each text its key, code and, over the words that are broadcast, the sums of scores, of familiarity (of all
    words, of those not beside a digit), of familiarity to other languages (likewise); the numbers of all its words
    (likewise); and its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = shared.value
        for batch in batches:
            data, offsets = flat.texts_of(batch.column("text"))
            codes = batch.column("code").to_numpy()
            for i, j, each in flat.portions(data, offsets):
                out, others = np.zeros((j - i, n_langs + 6), np.int64), []
                apart = np.where(codes[i:j] < n_langs, n_langs + 1 + codes[i:j], n_langs)
                for own, places in each:
                    hashes, starts, ends, counts = langid.words_of(own, places)
                    if not len(hashes):
                        continue
                    of = np.repeat(np.arange(j - i), counts)
                    before = (starts > places[of]) & langid._DIGIT[own[starts - 1]]
                    after = (ends < places[of + 1]) & langid._DIGIT[own[np.minimum(ends, len(own) - 1)]]
                    word = ~(before | after)
                    number, unique = pd.factorize(hashes)
                    at = np.minimum(np.searchsorted(keys, unique), max(len(keys) - 1, 0))
                    known = keys[at] == unique if len(keys) else np.zeros(len(unique), bool)
                    rows = np.zeros((len(unique), values.shape[1]), np.int32)
                    rows[known] = values[at[known]]
                    like, less = rows[number, n_langs], rows[number, apart[of]]
                    for k, x in enumerate((*(rows[number, k] for k in range(n_langs)), like, like * word, less, less * word, None, word)):
                        out[:, k] += np.bincount(of, x, j - i).astype(np.int64)
                    new = np.flatnonzero(~known[number])
                    if len(new):
                        both, pair = np.unique(of[new] * len(unique) + number[new], return_inverse=True)
                        others.append((both // len(unique), unique[both % len(unique)], np.bincount(pair), np.bincount(pair, word[new]).astype(np.int64)))
                doc, hashes, times, plain = (np.concatenate(x) for x in zip(*others, strict=True)) if others else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=j - i))]).astype(np.int32)  # doc ascends
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array(times), pa.array(plain)], ["hash", "times", "plain"]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("a", "b", "code")), *map(pa.array, np.ascontiguousarray(out.T)), listed], ["a", "b", "code", *_columns(n_langs), "others"])

    return flat.released(run)


def _columns(n_langs: int) -> list[str]:
    return [*(f"s{k}" for k in range(n_langs)), "own", "own_plain", "apart", "apart_plain", "n", "n_plain"]


def _keys(text: str = "text") -> list[Column]:
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit("b"), text).alias("b")]


def judged(docs: DataFrame, words: Words) -> DataFrame:
    """(a, b, code, lang_pred, score, familiarity, apart) of every different text with a letter, by its key; a row for each code."""
    n_langs = len(words.langs)
    columns = _columns(n_langs)
    shared = docs.sparkSession.sparkContext.broadcast(words.common)
    rows = _coded(docs, words.langs).where(F.col("text").rlike(r"\p{L}")).select(F.lower("text").alias("text"), "code", *_keys())
    kinds = ", ".join(f"{c} bigint" for c in columns)
    found = written(rows.mapInArrow(_sums(shared, n_langs), f"a bigint, b bigint, code int, {kinds}, others array<struct<hash: bigint, times: bigint, plain: bigint>>"))
    shared.destroy()
    parts = found.select("a", "b", "code", *columns)
    if words.rest is not None:
        each = found.select("a", "b", "code", F.explode("others").alias("o")).select("a", "b", "code", "o.*").join(words.rest.drop("total"), "hash")
        like = F.col(f"x{n_langs}").cast("bigint")
        less = F.element_at(F.array(*(F.col(f"x{n_langs + 1 + k}") for k in range(n_langs)), F.col(f"x{n_langs}")), F.col("code") + 1).cast("bigint")
        sums = [*(F.col(f"x{k}").cast("bigint") * F.col("times") for k in range(n_langs)), *(x * F.col(c) for x in (like, less) for c in ("times", "plain")), F.lit(0), F.lit(0)]
        parts = parts.unionByName(each.select("a", "b", "code", *(x.cast("bigint").alias(c) for x, c in zip(sums, columns, strict=True))))
    whole = parts.groupBy("a", "b", "code").agg(*(F.sum(c).alias(c) for c in columns))  # copies multiply sums alike
    scores = [F.col(f"s{k}") for k in range(n_langs)]
    best = F.greatest(*scores, scores[0])
    pick = F.coalesce(*(F.when(x == best, F.lit(name)) for x, name in zip(scores, words.langs, strict=True)))
    mean = lambda c: F.when(F.col("n_plain") > 0, F.col(f"{c}_plain") / F.col("n_plain")).otherwise(F.coalesce(F.try_divide(c, "n"), F.lit(0.0))) / UNIT
    return written(whole.select("a", "b", "code", pick.alias("lang_pred"), mean("own").alias("familiarity"), mean("apart").alias("apart")))


def medians(rows: DataFrame) -> dict[tuple[int, str], float]:
    """The exact medians of each code's ``own`` and ``apart`` (0 to 1): the classes that hold them are found first, then
    the values within these."""
    each = rows.selectExpr("code", "stack(2, 'own', own, 'apart', apart) as (kind, value)").withColumn("bin", F.floor(F.col("value") * BINS).cast("int"))
    counts: dict[tuple[int, str], dict[int, int]] = {}
    for r in each.groupBy("code", "kind", "bin").count().collect():  # at most BINS + 1 for each code and kind
        counts.setdefault((r.code, r.kind), {})[r.bin] = r["count"]
    at, wanted = {}, []
    for of, bins in counts.items():
        n = sum(bins.values())
        for rank in {(n - 1) // 2, n // 2}:
            for b in sorted(bins):
                if rank < bins[b]:
                    at.setdefault(of, []).append((b, rank))
                    wanted.append(f"{of[0]} {of[1]} {b}")
                    break
                rank -= bins[b]
    if not wanted:
        return {}
    values: dict[tuple[int, str, int], list[tuple[float, int]]] = {}
    for r in each.where(F.concat_ws(" ", "code", "kind", "bin").isin(wanted)).groupBy("code", "kind", "bin", "value").count().collect():
        values.setdefault((r.code, r.kind, r.bin), []).append((r.value, r["count"]))
    out = {}
    for of, places in at.items():
        middle = []
        for b, rank in places:
            for value, n in sorted(values[*of, b]):
                if rank < n:
                    middle.append(value)
                    break
                rank -= n
        out[of] = sum(middle) / len(middle)
    return out


def cuts(rows: DataFrame, langs: list[str]) -> dict[str, float]:
    """The least familiarity of a text of each language, as ``langid.cuts`` sets it, from all training documents of ``judged``."""
    found = medians(rows.where(F.col("code") < len(langs)).selectExpr("code", "familiarity as own", "apart"))
    least = min((x for (_, kind), x in found.items() if kind == "apart"), default=0.0)
    return {langs[code]: min((x + least) / 2, langid.MOST * x) for (code, kind), x in found.items() if kind == "own"}


def known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and more) with a letter that are at least as familiar as their language's cut."""
    words = train(docs)
    if not words.langs:
        return docs.where(F.lit(False))
    rows = judged(docs, words)
    least = F.lit(0.0)
    for lang, cut in cuts(rows, words.langs).items():
        least = F.when(F.col("lang_pred") == lang, cut).otherwise(least)
    gone = bounded(written(rows.where(F.col("familiarity") < least).select(F.col("a").alias("a_"), F.col("b").alias("b_")).distinct()))
    a, b = _keys()
    return docs.where(F.col("text").rlike(r"\p{L}")).join(gone, (a == F.col("a_")) & (b == F.col("b_")), "left_anti")
