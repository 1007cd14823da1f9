"""Near-duplicate documents by SuperMinHash.

Texts are lower-cased (A-Z only) and split at ASCII white space; a document's set is that of its 5-word shingles. Each
shingle has, as SuperMinHash has it, one random permutation of the slots and draws ``j + r`` for the slot at rank j: the
ranks of one element are tied together, which lowers the variance below that of independent minima. The draws of rank j
are at least j, so a document is done as soon as all its slots are below the next rank.

1. One pass makes for each document the size of its set, a 128-bit key of its words (equal texts are one class) and
   the band keys of its signature.
2. Classes that share a band key are linked to the least class there; the components of these links are the candidate
   clusters. No pair of a bucket is written out.
3. Documents of clusters go, with their whole sets, into groups of about 64, a large cluster into all pairs of such
   blocks; each group computes exact intersections and returns a spanning forest of the links that hold.
4. The components of the confirmed links are the answer.

Sets are of 64-bit hashes. A pair at the threshold of 0.85 has no common band with a chance of about (1 - 0.85 ** 5) **
30 = 2e-8 at most.

Null and empty texts and those of white space only have an empty set, stand alone and are kept. Null doc_ids are
answered too; they count as larger than any other id. Repeated rows get a row each. Columns other than doc_id and text
are neither read nor returned, so that their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import flat
from lexforge.llm.graph import components
from lexforge.llm.store import bounded, written

WORDS, ROWS, BANDS = 5, 5, 30
SLOTS = ROWS * BANDS
#: Documents, and shingles, that one block is to hold.
BLOCK_DOCS, BLOCK_SHINGLES = 64, 200_000
#: Ids of candidate documents up to which they are broadcast to the scan of the texts (8 bytes each); beyond, a shuffle.
BROADCAST_IDS = 500_000

#: Shingles that are sketched at once: an element may need a permutation of the slots, of SLOTS bytes.
ELEMENTS = 1 << 16

_MULTIPLIERS = flat.numbers(WORDS + 1, 3) | np.uint64(1)
_LEVELS = flat.numbers(SLOTS, 4)
_ROWS = flat.numbers(ROWS, 5) | np.uint64(1)
_BANDS = flat.numbers(BANDS, 6)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the documents in ``data``: sorted distinct shingle hashes, one document after the other; the sets' sizes; and
    two columns of the 128-bit key of each one's words (0 without words)."""
    with np.errstate(over="ignore"):
        words, _, _, counts = flat.word_hashes(flat.LOWER[data], offsets, ~flat.SPACE)
        begins = np.cumsum(counts) - counts
        sizes = np.where(counts > 0, np.maximum(counts - WORDS + 1, 1), 0)
        at = flat.ragged(begins, sizes)
        wide = np.repeat(counts >= WORDS, sizes)
        out = np.zeros(len(at), np.uint64)
        long_at = at[wide]
        total = np.zeros(len(long_at), np.uint64)
        for k in range(WORDS):
            total += words[long_at + k] * _MULTIPLIERS[k]
        out[wide] = total
        for n in range(1, WORDS):
            of = ~wide & np.repeat(counts == n, sizes)
            total = np.full(int(of.sum()), np.uint64(n) * _MULTIPLIERS[WORDS])
            for k in range(n):
                total += words[at[of] + k] * _MULTIPLIERS[k]
            out[of] = total
        out = flat.mix(out)
        keys = np.zeros((len(counts), 2), np.uint64)
        some = np.flatnonzero(counts)
        if len(some):
            place = np.arange(len(words)) - np.repeat(begins[some], counts[some])
            for c in (0, 1):
                keys[some, c] = flat.mix(np.add.reduceat(words * (flat.numbers(int(counts.max()), 7 + c) | np.uint64(1))[place], begins[some]) + counts[some].astype(np.uint64))
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[(ends - sizes)[sizes > 0]] = True
    distinct = np.diff(np.concatenate([[0], np.cumsum(new)])[np.concatenate([[0], ends])])
    return out[new], distinct, keys


def signatures(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SuperMinHash signatures, a row of SLOTS doubles for each document (infinite for an empty set). Of more than ELEMENTS
    shingles the signatures of parts are joined, as a signature holds minima."""
    ends = np.cumsum(sizes)
    if len(elements) <= ELEMENTS:
        return _signatures(elements, sizes)
    out = np.full((len(sizes), SLOTS), np.inf)
    for a in range(0, len(elements), ELEMENTS):
        b = min(a + ELEMENTS, len(elements))
        i, j = np.searchsorted(ends, [a, b - 1], "right")
        inside = np.minimum(ends[i : j + 1], b) - np.maximum((ends - sizes)[i : j + 1], a)
        out[i : j + 1] = np.minimum(out[i : j + 1], _signatures(elements[a:b], np.maximum(inside, 0)))
    return out


def _signatures(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    docs = len(sizes)
    table = np.full(docs * SLOTS, np.inf)
    doc = np.repeat(np.arange(docs), sizes)
    first = second = perm = None
    for j in range(SLOTS):
        r = flat.mix(elements ^ _LEVELS[j])
        k = (((r & np.uint64(0xFFFFFFFF)) * np.uint64(SLOTS - j)) >> np.uint64(32)).astype(np.int64) + j
        if j == 0:
            slot = first = k
        elif j == 1:  # the first swap has put slot 0 at place ``first``
            second, slot = k, np.where(k == first, 0, k)
        else:
            if perm is None:
                perm = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(elements), 1))
                row = np.arange(len(elements))
                perm[row, first] = 0
                perm[row, second] = perm[row, 1]
            row = np.arange(len(elements))
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
        np.minimum.at(table, doc * SLOTS + slot, j + (r >> np.uint64(32)).astype(np.float64) * 2.0**-32)
        more = table.reshape(docs, SLOTS).max(1) >= j + 1 if docs else np.zeros(0, bool)
        keep = more[doc]
        if not keep.any():
            break
        if not keep.all():
            elements, doc, first = elements[keep], doc[keep], first[keep]
            second = second[keep] if second is not None else None
            perm = perm[keep] if perm is not None else None
    return table.reshape(docs, SLOTS)


def band_keys(table: np.ndarray) -> np.ndarray:
    """A 64-bit key for each document and band; equal keys: equal slots of the same band."""
    with np.errstate(over="ignore"):
        return flat.mix((table.view(np.uint64).reshape(len(table), BANDS, ROWS) * _ROWS).sum(2, dtype=np.uint64) + _BANDS)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat.texts_of(batch.column("text"))
        for i, j in flat.pieces_of(offsets):
            elements, sizes, keys = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            bands = band_keys(signatures(elements, sizes)).view(np.int64)[sizes > 0]
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
            columns = [batch.column("doc_id").slice(i, j - i), batch.column("text_key").slice(i, j - i), sizes, *keys.view(np.int64).T, pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()))]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x)) for x in columns], ["doc_id", "text_key", "n_shingles", "k1", "k2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat.texts_of(batch.column("text"))
        for i, j in flat.pieces_of(offsets):
            elements, sizes, keys = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sets = pa.array([elements[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(k)) for k in keys.view(np.int64).T), sets], ["k1", "k2", "elements"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of sorted distinct arrays, by products of slices of the incidence matrix."""
    n = len(sets)
    out = np.zeros((n, n), np.int64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # the others are in no intersection of two
    column_no = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], column_no[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        x = np.zeros((n, 4096), np.float32)
        x[owner[a:b], column[a:b] - low] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def forest(links: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph of n nodes with the given pairs, by union-find."""
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _confirm(threshold: int):
    def confirm(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in rows.elements]
        size = np.array([len(s) for s in sets])
        both = intersections(sets)
        link = 100 * both >= threshold * (size[:, None] + size[None, :] - both)
        side = rows.block.to_numpy()
        if rows.i.iat[0] != rows.j.iat[0]:
            link &= side[:, None] != side[None, :]
        links = np.argwhere(np.triu(link, 1))
        found = np.array(forest(links, len(sets)), np.int64).reshape(-1, 2)
        k1, k2 = rows.k1.to_numpy(), rows.k2.to_numpy()
        return pd.DataFrame({"a1": k1[found[:, 0]], "a2": k2[found[:, 0]], "b1": k1[found[:, 1]], "b2": k2[found[:, 1]]})

    return confirm


def near_duplicates(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Documents are linked if 100 * intersection >= threshold * union; component_id is the least doc_id that links reach.
    text_key is xxhash64 of the text, by which a row can be found again if doc_ids repeat.
    """
    docs = docs.select("doc_id", "text")
    plain = docs.withColumn("text_key", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketched = written(plain.mapInArrow(flat.released(_sketch), f"doc_id {kind}, text_key bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>"))
    some = sketched.where("n_shingles > 0")
    classes = written(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands")))

    bands = classes.select("k1", F.explode("bands").alias("band"))
    buckets = written(bands.groupBy("band").agg(F.min("k1").alias("b"), F.max("k1").alias("most")).where("b < most").select("band", "b"))
    stars = written(bands.join(buckets, "band").select(F.col("k1").alias("a"), "b").distinct())
    clusters = written(components(stars).select(F.col("node").alias("k1"), F.col("component").alias("cluster")))

    links = _confirmed(docs, classes.drop("bands"), clusters, threshold)
    groups = components(links).select("node.k1", "node.k2", "component")
    grouped = written(classes.select("k1", "k2", "doc", "n").join(groups, ["k1", "k2"]))
    least = written(grouped.groupBy("component").agg(F.min("doc").alias("component_id")))
    linked = grouped.join(least, "component").select("k1", "k2", "component_id")
    copies = classes.where("n > 1").join(groups, ["k1", "k2"], "left_anti").select("k1", "k2", F.col("doc").alias("component_id"))
    several = written(linked.unionByName(copies))

    names = ["doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")]
    out = some.join(several, ["k1", "k2"], "left").select(names)
    alone = sketched.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).select(names)
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _confirmed(docs: DataFrame, classes: DataFrame, clusters: DataFrame, threshold: int) -> DataFrame:
    """(a, b) links, confirmed on full sets, that span the components of the candidate clusters."""
    members = written(classes.join(clusters, "k1"))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("shingles"))
    sizes = written(sizes.select("cluster", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    ids = bounded(written(members.select(F.col("doc").alias("rep")).distinct()), BROADCAST_IDS)
    texts = docs.join(ids, docs.doc_id.eqNullSafe(ids.rep), "left_semi").select("text")
    sets = written(texts.mapInArrow(flat.released(_sets), "k1 bigint, k2 bigint, elements binary").dropDuplicates(["k1", "k2"]))
    where = members.join(bounded(sizes), "cluster").select("k1", "k2", "cluster", "blocks", F.pmod(F.col("k2"), F.col("blocks")).cast("int").alias("block"))
    dealt = sets.join(where, ["k1", "k2"]).select("k1", "k2", "elements", "cluster", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    dealt = dealt.select("k1", "k2", "elements", "cluster", "block", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"))
    links = dealt.groupBy("cluster", "i", "j").applyInPandas(_confirm(threshold), "a1 bigint, a2 bigint, b1 bigint, b2 bigint")
    node = lambda x: F.struct(F.col(f"{x}1").alias("k1"), F.col(f"{x}2").alias("k2")).alias(x)
    return written(links.select(node("a"), node("b")).distinct())


def deduplicated(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one document of each group; of rows that repeat one doc_id and
    text, one stays."""
    marked = written(near_duplicates(docs, threshold).select("doc_id", "text_key", "kept"))
    same = lambda d, x: d.doc_id.eqNullSafe(x.id_) & F.xxhash64(d.text).eqNullSafe(x.key_)
    keys = lambda x: x.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_")).distinct()
    gone = bounded(written(keys(marked.where("not kept"))), BROADCAST_IDS)
    left = docs.join(gone, same(docs, gone), "left_anti")
    repeated = written(keys(marked.where("kept").groupBy("doc_id", "text_key").count().where("count > 1")))
    if repeated.isEmpty():
        return left
    repeated = bounded(repeated, BROADCAST_IDS)
    one = left.join(repeated, same(left, repeated), "left_semi").withColumn("key_", F.xxhash64("text")).dropDuplicates(["doc_id", "key_"]).drop("key_")
    return left.join(repeated, same(left, repeated), "left_anti").unionByName(one)
