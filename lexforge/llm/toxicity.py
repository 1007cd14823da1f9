"""Toxicity by a classifier chain.

Categories are predicted one after the other, each by a linear (logistic) model of the marks that occur in a text and of
the probabilities of the categories before it. For training those earlier probabilities are out-of-fold: each labelled
document gets them from models that were fitted without its fold. The verdict is the last link's, which is fed by all
others. The links are

* ``low_quality``: labelled quality 0;
* ``toxic``: labelled toxic 1.

The labels name one class of toxicity only, so there is no third link; ``train`` takes any list of categories, each a name
and an expression on the columns of the labels.

Marks are words (runs of ASCII letters, digits and other alphabets' characters, A-Z lower-cased) and the stems that a word's
first 4, 5 and 6 bytes make, as insults come in families with many endings. Every mark of the training documents is
tested, and all whose likelihood-ratio statistic for a category is above SIGNIFICANT and that multiply its odds by LIFT are
features, however many these are; the rate of symbols is one more. Training takes about ``max_rows`` labelled documents (a parameter, MAX_ROWS), chosen by a
hash of the id. Only the features found in them, not their texts, go to the driver. All else is for all rows.
Predicted toxic are texts with a probability of at least CUT.

Null and empty texts have no marks and get the model's base rates, but are never called toxic. Without any labels, or
with labels of one kind only, a category's probability is 0 or 1 for all. A document with several labels counts once, as of
a category if any label says so; a label that is null says nothing. Repeated rows get a row each, and count once in
training. Ties: a probability of CUT is toxic. Long texts are worked on in slices that end before white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import flat
from lexforge.llm.store import bounded, written

#: Names of the links, in order, and what of a label makes each.
LABELS = [("low_quality", "quality = 0"), ("toxic", "toxic = 1")]
CATEGORIES = tuple(name for name, _ in LABELS)
MAX_ROWS, SIGNIFICANT, LIFT, FOLDS = 12_000, 15.0, 4, 5  # 15: one mark in 10,000 by chance
STEMS = [4, 5, 6]
CUT = 0.5
_SYMBOL = flat.byte_table(b"#*$%&|<>")


def marks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the words and of the stems of longer words."""
    data = flat.LOWER[data]
    inside = flat.ALNUM[data]
    bounds = flat.runs(inside, offsets)
    if len(bounds) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = inside[bounds[:-1]]
    doc = np.repeat(np.arange(len(offsets) - 1), flat.counts_of(bounds[:-1][keep], offsets))
    lengths = np.diff(bounds)[keep]
    hashes = [h[keep] for h in flat.start_hashes(data, bounds, [0, *STEMS])]
    longer = [np.ones(len(doc), bool), *(lengths > n for n in STEMS)]
    return np.concatenate([h[m] for h, m in zip(hashes, longer, strict=True)]), np.concatenate([doc[m] for m in longer])


@dataclass
class Rows:
    """Feature rows: the numbers of the marks that occur in row k are marks[ends[k] : ends[k + 1]]; ``dense`` holds further
    columns."""

    ends: np.ndarray
    marks: np.ndarray
    dense: np.ndarray
    n_marks: int
    row: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.row = np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))

    def with_column(self, x: np.ndarray) -> Rows:
        return Rows(self.ends, self.marks, np.column_stack([self.dense, x]), self.n_marks)

    def take(self, keep: np.ndarray) -> Rows:
        lengths = np.diff(self.ends)[keep]
        return Rows(np.concatenate([[0], np.cumsum(lengths)]), self.marks[np.repeat(keep, np.diff(self.ends))], self.dense[keep], self.n_marks)

    def times(self, w: np.ndarray) -> np.ndarray:
        """The product with weights of marks, then of the dense columns."""
        return np.bincount(self.row, w[self.marks], len(self.dense)) + self.dense @ w[self.n_marks :]

    def squares(self, r: np.ndarray) -> np.ndarray:
        """For each column the sum of its squares, weighted by a number for each row; marks are 0 or 1."""
        return np.concatenate([np.bincount(self.marks, r[self.row], self.n_marks), (self.dense**2).T @ r])

    def turned(self, r: np.ndarray) -> np.ndarray:
        """The product of the transpose with one number for each row."""
        return np.concatenate([np.bincount(self.marks, r[self.row], self.n_marks), self.dense.T @ r])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: Rows, y: np.ndarray, ridge: float = 0.1, rounds: int = 25, start: np.ndarray | None = None) -> np.ndarray:
    """Weights and, last, the bias of logistic regression with a ridge, by Newton's method with conjugate gradients. The
    loss is convex, so ``start`` changes the rounds only."""
    x = x.with_column(np.ones(len(y)))
    w = np.zeros(x.n_marks + x.dense.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = 40.0 if len(y) and y[0] else -40.0
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    w = w if start is None else start.copy()
    for _ in range(rounds):
        p = _logistic(x.times(w))
        curve = p * (1 - p)
        bend = lambda v, c=curve: x.turned(c * x.times(v)) + (penalty + 1e-9) * v
        scale = 1 / (x.squares(curve) + penalty + 1e-9)  # conjugate gradients, with the diagonal as a preconditioner
        rest = x.turned(y - p) - penalty * w
        step, towards = np.zeros(len(w)), scale * rest
        size = rest @ towards
        enough = max(1e-12, 1e-4 * size)  # a Newton step need only be good to a hundredth
        for _ in range(200):
            if size <= enough:
                break
            bent = bend(towards)
            rate = size / (towards @ bent)
            step += rate * towards
            rest -= rate * bent
            eased = scale * rest
            size, before = rest @ eased, size
            towards = eased + size / before * towards
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass
class Chain:
    """Sorted hashes of marks, and for each category the weights of marks, symbol rate, earlier categories and bias."""

    marks: np.ndarray
    weights: list[np.ndarray]
    names: tuple[str, ...] = CATEGORIES

    def features(self, each: Iterator[tuple[np.ndarray, np.ndarray]]) -> Rows:
        """Which marks occur, and the root of the share of symbols among the bytes, of documents in one slice or several."""
        found, symbols, sizes = [], 0, 0
        for data, offsets in each:
            hashes, doc = marks_of(data, offsets)
            if len(self.marks) and len(hashes):
                at = np.minimum(np.searchsorted(self.marks, hashes), len(self.marks) - 1)
                hit = self.marks[at] == hashes
                found.append(doc[hit] * len(self.marks) + at[hit])
            symbols = symbols + flat.counts_of(np.flatnonzero(_SYMBOL[data]), offsets)
            sizes = sizes + np.diff(offsets)
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        n = max(len(self.marks), 1)
        ends = np.searchsorted(both // n, np.arange(len(sizes) + 1))
        return Rows(ends, both % n, np.sqrt(symbols / np.maximum(sizes, 1))[:, None], len(self.marks))

    def predict(self, x: Rows) -> np.ndarray:
        """Probabilities, a column for each category, each model fed with those before it."""
        out = []
        for w in self.weights:
            out.append(_logistic(x.times(w[:-1]) + w[-1]))
            x = x.with_column(out[-1])
        return np.column_stack(out) if out else np.zeros((len(x.dense), 0))


def fit_chain(marks: np.ndarray, x: Rows, labels: np.ndarray, folds: np.ndarray, names: tuple[str, ...] = CATEGORIES) -> Chain:
    """Fit the categories (columns of ``labels``) in order, feeding out-of-fold probabilities to the later ones."""
    weights = []
    for k in range(labels.shape[1]):
        y = labels[:, k]
        weights.append(fit(x, y))
        if k + 1 < labels.shape[1]:
            out = np.zeros(len(y))
            for fold in np.unique(folds):
                rest = folds != fold
                w = fit(x.take(rest), y[rest], start=weights[-1]) if rest.any() else weights[-1]
                out[~rest] = _logistic(x.take(~rest).times(w[:-1]) + w[-1])
            x = x.with_column(out)
    return Chain(marks, weights, names)


def _marked(carried: list[str]):
    """The distinct hashes of each text's marks, and what the row carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat.texts_of(batch.column("text"))
            for i, j, each in flat.portions(data, offsets):
                got = [marks_of(*x) for x in each]
                hashes, doc = (np.concatenate(x) for x in zip(*got, strict=True))
                order = np.argsort(doc, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=j - i))]).tolist()
                lists = [np.unique(hashes[order][a:b]).view(np.int64) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in carried), column], [*carried, "marks"])

    return flat.released(run)


def _features(marks: np.ndarray, carried: list[str]):
    """The numbers of the marks that occur in each text, its rate of symbols, and what the row carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(marks, [])
        for batch in batches:
            data, offsets = flat.texts_of(batch.column("text"))
            for i, j, each in flat.portions(data, offsets):
                x = chain.features(each)
                lists = pa.ListArray.from_arrays(pa.array(x.ends.astype(np.int32)), pa.array(x.marks))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in carried), lists, pa.array(x.dense[:, 0])], [*carried, "found", "symbols"])

    return flat.released(run)


def gain(of: str) -> str:
    """SQL of the likelihood-ratio statistic of a mark in n of n_ documents, ``of`` of them among the ``of``_ of a class."""
    cells = [(of, f"n * {of}_ / n_"), (f"n - {of}", f"n * (n_ - {of}_) / n_"), (f"{of}_ - {of}", f"(n_ - n) * {of}_ / n_"), (f"n_ - n - {of}_ + {of}", f"(n_ - n) * (n_ - {of}_) / n_")]
    return " + ".join(f"if({o} > 0, 2D * ({o}) * ln(({o}) / ({e})), 0D)" for o, e in cells)


def lifts(of: str) -> str:
    """SQL: whether the odds of the class ``of`` are LIFT times as large with the mark as without."""
    return f"{of} * (n_ - {of}_ - n + {of}) >= {LIFT} * (n - {of}) * ({of}_ - {of})"


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, categories: list[tuple[str, str]] = LABELS) -> Chain:
    """Fit a chain to the rows of ``labels`` (doc_id and the columns that ``categories`` name) and the texts of ``docs``
    (doc_id, text)."""
    names = [f"y{k}" for k in range(len(categories))]
    marked = labels.select(F.col("doc_id").alias("id_"), *(F.coalesce(F.expr(x).cast("int"), F.lit(0)).alias(c) for c, (_, x) in zip(names, categories, strict=True)))
    kinds = written(marked.where("id_ is not null").groupBy("id_").agg(*(F.max(c).alias(c) for c in names)))
    n = kinds.count()
    place = F.pmod(F.xxhash64("id_"), F.lit(1 << 20))
    chosen = kinds.where(place < int(min(1.0, max_rows / max(n, 1)) * (1 << 20))).withColumn("fold", (F.crc32(F.col("id_").cast("string").cast("binary")) % FOLDS).cast("int"))
    chosen = bounded(written(chosen), 2 * MAX_ROWS)
    carried = [*names, "fold", "key"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, F.col("doc_id") == F.col("id_"))
    rows = written(rows.dropDuplicates(["id_", "text"]).withColumn("key", F.xxhash64("text", "id_")).select("text", *carried))
    kind = ", ".join(f"{c} {'bigint' if c == 'key' else 'int'}" for c in carried)
    total = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in names)).first()
    if not total.n:
        return Chain(np.zeros(0, np.uint64), [np.array([0.0] * (k + 1) + [-40.0]) for k in range(len(categories))], tuple(c for c, _ in categories))
    sample = rows.mapInArrow(_marked(carried), f"{kind}, marks array<bigint>")
    each = sample.select(F.explode("marks").alias("mark"), *names).groupBy("mark").agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(c).cast("double").alias(c) for c in names))
    each = each.select("*", F.lit(float(total.n)).alias("n_"), *(F.lit(float(total[c] or 0)).alias(f"{c}_") for c in names))
    strong = written(each.where(" or ".join(f"({gain(c)}) > {SIGNIFICANT} and {lifts(c)}" for c in names)).select("mark")).toArrow()
    marks = np.sort(strong.column("mark").to_numpy().view(np.uint64))
    found = written(rows.mapInArrow(_features(marks, carried), f"{kind}, found array<bigint>, symbols double")).toArrow().sort_by("key").combine_chunks()  # in one order, for equal sums
    lists = found.column("found").combine_chunks()
    x = Rows(np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]), np.asarray(lists.flatten()), found.column("symbols").to_numpy()[:, None], len(marks))
    return fit_chain(marks, x, np.column_stack([found.column(c).to_numpy() for c in names]).astype(float), found.column("fold").to_numpy(), tuple(c for c, _ in categories))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """The columns of ``docs`` (those of the names given are replaced), then p_ of each category, and is_toxic by the last."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    new = [*(f"p_{c}" for c in chain.names), "is_toxic"]
    others = [c for c in docs.columns if c not in (*new, "text_")]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Chain = shared.value
        for batch in batches:
            data, offsets = flat.texts_of(batch.column("text_"))
            for i, j, each in flat.portions(data, offsets):
                p = fitted.predict(fitted.features(each))
                toxic = (p[:, -1] >= CUT) & (np.diff(offsets[i : j + 1]) > 0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in others), *(pa.array(np.ascontiguousarray(c)) for c in p.T), pa.array(toxic)], [*others, *new])

    return docs.select(*others, F.col("text").alias("text_")).mapInArrow(flat.released(run), f"{kinds}{', '.join(f'{c} double' for c in new[:-1])}, is_toxic boolean")
