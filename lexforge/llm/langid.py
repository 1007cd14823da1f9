"""Language of texts by word-first backoff.

A word that training has seen adds its log frequency in each language; for an unseen word the longest character n-grams
that training has seen are taken, first those of 5 characters (with marks for the word's ends), then of 4, and so on to
single characters. All log frequencies count against their mean over the languages, so a word that no table knows adds
nothing. The language with the largest sum wins (the first by name, if equal), and its score is its share after softmax.

Training takes about ``max_docs`` different documents, with about ``max_chars`` characters in all, of each language, chosen
by a hash of the text alone (equal texts count once); both bounds are parameters. Of these documents every word and n-gram
is kept. As the sample is bounded, so are the tables, which go to the executors as a Spark broadcast: 8 bytes and 5 for each
language for each entry, 20 MB for the 700,000 of the check tool's tables. Tables beyond MAX_TABLE bytes, or more than
MAX_LANGS labels, raise an error that names the bound; nothing is left out silently.

The score grows with a text's length whatever its language, so it does not tell that a language is unknown; nor do mean log
odds a word, which are as large for Polish as for texts of the training languages. Familiarity does: the mean over words
of 1 for a word that training has seen, otherwise the share of its n-grams of FAMILIAR characters that training has seen. Runs of letters beside a digit are parts
of codes and keys, not words, and don't count unless there is nothing else.
``cuts`` sets, from training documents, how familiar a text of each language must be.

A null text, or one without a letter, is ``und`` with score 0. So is every text if training had no rows. lang, source
and doc_id are no inputs of a prediction. Repeated rows get a row each; other columns are not read. Long texts are scored
in slices that end before white space, whose sums are added.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import flat
from lexforge.llm.store import written

#: Longest n-gram.
LONGEST = 5
#: Different documents, and characters, that training takes of each language.
MAX_DOCS, MAX_CHARS = 4_000, 32_000_000
#: Labels, and bytes of all tables, that a model may have.
MAX_LANGS, MAX_TABLE = 512, 512 << 20
#: Lengths of the n-grams that count for familiarity; shorter ones are known in any language of the same script.
FAMILIAR = (3, 4, 5)
#: Documents of each language from which cuts are set, and the most that a cut may be of the language's own familiarity.
CUT_DOCS, MOST = 200, 2 / 3
#: Added to each count.
SMOOTH = 0.5
UNKNOWN = "und"

_DIGIT = flat.byte_table(b"0123456789")
_GRAM = flat.numbers(LONGEST, 11) | np.uint64(1)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters in lower-cased texts."""
    return flat.word_hashes(data, offsets, flat.ALPHA)


def grams(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to LONGEST: hashes of the words' character n-grams, and the number of the word of each."""
    text = b" ".join(words).decode("utf-8", "replace")
    points = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    gap = points == 32  # stands for the marks at both ends
    word = np.cumsum(gap) - 1
    out = []
    with np.errstate(over="ignore"):
        total = np.zeros(len(points), np.uint64)
        mixed = flat.mix(points + np.uint64(1))
        for n in range(1, LONGEST + 1):
            size = len(points) - n + 1
            if size <= 0:
                out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                continue
            total = total[:size] + mixed[n - 1 :] * _GRAM[n - 1]
            inner = np.zeros(size, np.int64)
            for k in range(1, n - 1):
                inner += gap[k : k + size]
            ok = (inner == 0) & ~(gap[:size] & (gap[n - 1 :] if n > 1 else True)) if n < 3 else inner == 0
            out.append((flat.mix(total[ok] + np.uint64(n)), word[:size][ok]))
    return out


class Model:
    """Languages and, for words (0) and n-grams of 1 to LONGEST characters, sorted hashes and their log frequencies; also
    in which languages each was seen (in all, if not given)."""

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]], seen: list[np.ndarray] | None = None):
        self.langs, self.tables = langs, tables
        self.seen = [np.ones(logs.shape, bool) for _, logs in tables] if seen is None else seen

    def find(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, _ = self.tables[n]
        if not len(keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return at, keys[at] == hashes

    def known(self, n: int, hashes: np.ndarray, apart: int | None = None) -> np.ndarray:
        """Whether training has seen them, in a language other than number ``apart`` if given."""
        at, known = self.find(n, hashes)
        if apart is not None and len(self.seen[n]):
            known = known & np.delete(self.seen[n], apart, 1).any(1)[at]
        return known

    def likeness(self, found: list[tuple[np.ndarray, np.ndarray]], n_words: int, apart: int | None = None) -> np.ndarray:
        """The shares of words' n-grams (of ``grams``) that are known, as means over the lengths of FAMILIAR that a word has."""
        total, lengths = np.zeros(n_words), np.zeros(n_words)
        for n in FAMILIAR:
            hashes, word = found[n - 1]
            times = np.bincount(word, minlength=n_words)
            total += np.bincount(word, self.known(n, hashes, apart), n_words) / np.maximum(times, 1)
            lengths += times > 0
        return total / np.maximum(lengths, 1)

    def familiarity(self, data: np.ndarray, offsets: np.ndarray, apart: int | None = None) -> np.ndarray:
        """The means of the words' familiarity, one for each document; 0 without words."""
        out = [self.evidence(each, True, apart)[1] for _, _, each in flat.portions(data, offsets, flat.CHUNK)]
        return np.concatenate([np.zeros(0), *out])

    def unseen(self, words: list[bytes], found: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """The scores of words that the word table lacks: means over their longest known n-grams."""
        out = np.zeros((len(words), len(self.langs)))
        left = np.ones(len(words), bool)
        for n, (hashes, word) in reversed(list(enumerate(found or grams(words), 1))):
            need = left[word]
            hashes, word = hashes[need], word[need]
            at, known = self.find(n, hashes)
            at, word = at[known], word[known]
            times = np.bincount(word, minlength=len(words))
            some = times > 0
            for k in range(len(self.langs)):
                out[some, k] = np.bincount(word, self.tables[n][1][at, k], len(words))[some] / times[some]
            left &= ~some
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The sums of the words' scores, a row for each document."""
        return self.evidence([(data, offsets)], False)[0]

    def evidence(self, each: Iterable[tuple[np.ndarray, np.ndarray]], familiarity: bool, apart: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The sums of the words' scores (without ``apart`` only) and, if asked for, the means of their familiarity, for
        documents that come in one slice or several (of ``flat.portions``)."""
        out = like = None
        for data, offsets in each:
            a, b = self._evidence(data, offsets, familiarity, apart)
            out, like = (a, b) if out is None else (out + a, like + b)
        total, of = np.where(like[:, 1:2] > 0, like[:, :2], like[:, 2:]).T
        return out, total / np.maximum(of, 1)

    def _evidence(self, data: np.ndarray, offsets: np.ndarray, familiarity: bool, apart: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Sums of scores; and sums of familiarity and numbers of words, first without those beside a digit, then of all."""
        hashes, starts, ends, counts = words_of(data, offsets)
        out, like = np.zeros((len(counts), len(self.langs))), np.zeros((len(counts), 4))
        if not len(hashes) or not self.langs:
            return out, like
        codes, unique = pd.factorize(hashes)
        at, known = self.find(0, unique)
        each = np.zeros((len(unique), len(self.langs)))
        each[known] = self.tables[0][1][at[known]]
        seen = known if apart is None else self.known(0, unique, apart)
        share = seen.astype(float)
        if not seen.all():
            first = np.empty(len(unique), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            new = first[~seen]
            words = [data[a:b].tobytes() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            found = grams(words)
            if apart is None:
                each[~known] = self.unseen(words, found)
            if familiarity:
                share[~seen] = self.likeness(found, len(words), apart)
        of = np.repeat(np.arange(len(counts)), counts)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(of, each[codes, k], len(counts))
        if familiarity:
            before = (starts > offsets[of]) & _DIGIT[data[starts - 1]]
            after = (ends < offsets[of + 1]) & _DIGIT[data[np.minimum(ends, len(data) - 1)]]
            word = ~(before | after)
            for k, weights in enumerate((share[codes] * word, word, share[codes], None)):
                like[:, k] = np.bincount(of, weights, len(counts))
        return out, like


def _count(langs: list[str]):
    """(n, hash, lang, times) of the words (n = 0) and n-grams of lower-cased texts, summed over a chunk; lang is a number."""
    number_of = {x: k for k, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat.texts_of(batch.column("text"))
            codes = np.array([number_of[x] for x in batch.column("lang").to_pylist()], np.int16)
            for i, j, each in flat.portions(data, offsets):
                for own, places in each:
                    hashes, starts, ends, counts = words_of(own, places)
                    of = np.repeat(codes[i:j], counts)
                    for code in np.unique(of):
                        number, unique = pd.factorize(hashes[of == code])
                        times = np.bincount(number)
                        first = np.empty(len(unique), np.int64)
                        first[number[::-1]] = np.flatnonzero(of == code)[::-1]
                        kinds = [(unique, times)]
                        for h, w in grams([own[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]):
                            number, hs = pd.factorize(h)
                            kinds.append((hs, np.bincount(number, times[w], len(hs)).astype(np.int64)))
                        for n, (h, t) in enumerate(kinds):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, np.int8)), pa.array(h.view(np.int64)), pa.array(np.full(len(h), code, np.int16)), pa.array(t)], ["n", "hash", "lang", "times"])

    return flat.released(run)


def _sample(docs: DataFrame, max_docs: int, max_chars: int = MAX_CHARS) -> tuple[DataFrame, list[str]]:
    """About ``max_docs`` different rows of each language (text, lang) with neither null, of about ``max_chars`` characters,
    lower-cased; and the languages."""
    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")))
    each = sizes.limit(MAX_LANGS + 1).collect()
    if len(each) > MAX_LANGS:
        raise ValueError(f"lang has more than {MAX_LANGS} values")
    if not each:
        return rows, []
    share = F.create_map(*(x for r in each for x in (F.lit(r.lang), F.lit(min(1.0, max_docs / r.n, max_chars / max(r.chars, 1)) * (1 << 20)))))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 20))  # every copy of a text is in or out
    chosen = rows.where(place < share[F.col("lang")]).dropDuplicates(["lang", "text"])
    return chosen.select(F.lower("text").alias("text"), "lang"), sorted(r.lang for r in each)


def train(docs: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Model:
    """Fit a model to the rows of ``docs`` (text, lang) with neither null."""
    sample, langs = _sample(docs, max_docs, max_chars)
    if not langs:
        return Model([], [(np.zeros(0, np.uint64), np.zeros((0, 0)))] * (LONGEST + 1))
    counted = sample.mapInArrow(_count(langs), "n tinyint, hash bigint, lang smallint, times bigint")
    times = written(counted.groupBy("n", "hash", "lang").agg(F.sum("times").alias("times")))
    rows = times.count()
    if rows * (8 + 5 * len(langs)) > MAX_TABLE:
        raise ValueError(f"the tables would take more than {MAX_TABLE} bytes; lower max_docs or max_chars")
    found = times.toArrow()  # at most MAX_TABLE bytes
    n, hashes, lang, times = (found.column(c).to_numpy() for c in ("n", "hash", "lang", "times"))
    tables, seen = [], []
    for k in range(LONGEST + 1):
        of = n == k
        keys, row = np.unique(hashes[of].view(np.uint64), return_inverse=True)
        counts = np.full((len(keys), len(langs)), SMOOTH)
        counts[row, lang[of]] += times[of]
        logs = np.log(counts / counts.sum(0)) if len(counts) else counts
        tables.append((keys, (logs - logs.mean(1, keepdims=True)).astype(np.float32)))
        seen.append(counts > SMOOTH)
    return Model(langs, tables, seen)


def cuts(docs: DataFrame, model: Model, max_docs: int = CUT_DOCS) -> dict[str, float]:
    """The least familiarity of a text of each language, from about ``max_docs`` training documents (text, lang) of each.

    It lies midway between the median of the language's own documents and the median of documents to tables without their
    language, that of the language least like the others; but is MOST of the former at most, so that labels that part one
    language in several do not reject their own texts."""
    sample, langs = _sample(docs, max_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Model = shared.value
        for batch in batches:
            column, names = batch.column("text"), np.array(batch.column("lang").to_pylist(), dtype=object)
            for k, lang in enumerate(fitted.langs):
                text = flat.texts_of(column.filter(pa.array(names == lang, pa.bool_())))
                values = [fitted.familiarity(*text), fitted.familiarity(*text, k)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values[0]), pa.string()), *map(pa.array, values)], ["lang", "own", "apart"])

    if not langs or not model.langs:
        return {}
    found = written(sample.where(F.col("text").rlike(r"\p{L}")).mapInArrow(flat.released(run), "lang string, own double, apart double"))
    rows = found.groupBy("lang").agg(F.median("own").alias("own"), F.median("apart").alias("apart")).collect()
    least = min((r.apart for r in rows), default=0.0)
    shared.destroy()
    return {r.lang: min((r.own + least) / 2, MOST * r.own) for r in rows}


def identify(docs: DataFrame, model: Model, familiarity: bool = False) -> DataFrame:
    """The columns of ``docs`` (those named as new ones are replaced), then lang_pred and score, and familiarity if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    more = ["familiarity"] if familiarity else []
    others = [c for c in docs.columns if c not in ("lang_pred", "score", *more, "lowered_text_", "has_letter_")]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Model = shared.value
        names = np.array([*fitted.langs, UNKNOWN], dtype=object)
        for batch in batches:
            data, offsets = flat.texts_of(batch.column("lowered_text_"))
            letter = np.asarray(batch.column("has_letter_").fill_null(False).to_numpy(zero_copy_only=False), bool)
            for i, j, each in flat.portions(data, offsets):
                sums, like = fitted.evidence(each, familiarity)
                pick, score = np.full(j - i, len(fitted.langs)), np.zeros(j - i)
                if fitted.langs:
                    best = sums.argmax(1)
                    some = letter[i:j]
                    pick[some] = best[some]
                    score[some] = (1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1))[some]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in others), pa.array(names[pick], pa.string()), pa.array(score), *([pa.array(like)] if familiarity else [])], [*others, "lang_pred", "score", *more])

    ready = docs.select(*others, F.lower("text").alias("lowered_text_"), F.col("text").rlike(r"\p{L}").alias("has_letter_"))
    return ready.mapInArrow(flat.released(run), f"{kinds}{', ' if kinds else ''}lang_pred string, score double{', familiarity double' if familiarity else ''}")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
