"""Hard negatives of anchors by Four-Russians scoring of whole-number vectors.

A vector's components are scaled and rounded down to whole numbers and packed as
bit planes: bit b of eight neighbouring components (a group) is one byte. For an
anchor, a table of each group holds the sums of all 256 subsets of its eight
components. So a byte of a candidate, used as an index, gives the group's whole
share of that plane, and the score is the planes' sums, shifted and added from
the highest plane (the sign, which counts negative) to the lowest: the exact
inner product without a multiplication of components.

Anchors are a written table that is sent to the tasks in blocks of bounded size;
a task makes the tables of a few hundred anchors at a time, so that they stay in
the processor's cache, and holds the best rows of each anchor. Nothing is
shuffled by label, and what meets for an anchor is ranked in groups of tasks
first. A first pass over all rows finds each anchor's positives; a second one, as
the positives' scores bound them, its negatives.

Cases: a row without id, label or vector, or with a null or non-finite component,
takes no part. Of rows that share an id the one with the least label, then the
least packed vector, counts. Vectors of fewer components than the longest end in
zeros; an empty vector has score 0 with all. Equal scores rank by id. An anchor
without another row of its label has no positives; a positive without negatives
in its bounds, as one of a negative score, has no rows. An empty table gives an
empty result. Further columns are ignored. Vectors so large that a hundred times a
score may not fit in a long raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskloom import kernels
from deskloom.operators import blocks

from . import common

SCALE = 256  # a component x becomes floor(SCALE * x)
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score between which a negative's lies
BLOCK = 16_384  # anchors sent to the tasks at once
TILE_ANCHORS, TILE_ROWS = 256, 2_048  # scored at once

PACKED = "id long, label long, planes binary"
SCORED = "query_id long, doc_id long, score long"
MINED = "query_id long, positive_id long, positive_score long, doc_id long, score long"


class Packing:
    """How vectors of a table are packed: their groups of eight components, and planes."""

    def __init__(self, size: int, low: float, high: float, scale: int):
        least, most = (int(np.floor(scale * x)) for x in (low, high))
        self.groups = max(1, -(-size // 8))
        self.planes = max(most.bit_length(), (~least).bit_length() if least < 0 else 0) + 1
        self.scale = scale
        if size * max(abs(least), abs(most)) ** 2 >= 2**56:
            raise ValueError("vectors are too large: percents of their inner products don't fit in a long")
        # Every sum on the way is a subset's, shifted: at most twice the largest of the planes' sums.
        self.kind = np.int32 if 8 * self.groups * 4**self.planes < 2**31 else np.int64

    def pack(self, vectors: pa.Array) -> np.ndarray:
        """(row, plane, group) bytes of float lists."""
        values, row, n = kernels.flat_lists(vectors)
        numbers = np.zeros((n, 8 * self.groups), np.int64)
        values = values.to_numpy(zero_copy_only=False).astype(np.float64)
        first = np.searchsorted(row, np.arange(n))
        numbers[row, np.arange(len(row)) - first[row]] = np.floor(self.scale * values).astype(np.int64)
        out = np.empty((n, self.planes, self.groups), np.uint8)
        for plane in range(self.planes):
            out[:, plane] = np.packbits((numbers >> plane & 1).astype(np.uint8), axis=1, bitorder="little")
        return out

    def bytes(self, planes: pa.Array) -> np.ndarray:
        data = np.frombuffer(b"".join(planes.to_pylist()), np.uint8)
        return data.reshape(len(planes), self.planes, self.groups)

    def tables(self, packed: np.ndarray) -> np.ndarray:
        """(group, byte, anchor): sums of the anchors' components of a group that a byte's bits select."""
        bits = np.unpackbits(packed, axis=2, bitorder="little").astype(self.kind)
        weight = 1 << np.arange(self.planes)
        weight[-1] *= -1
        numbers = np.einsum("apd,p->da", bits, weight.astype(self.kind)).reshape(self.groups, 8, -1)
        out = np.zeros((self.groups, 256, len(packed)), self.kind)
        for bit in range(8):
            half = 1 << bit
            out[:, half : 2 * half] = out[:, :half] + numbers[:, bit, None]
        return out

    def scores(self, tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """(anchor, row) exact inner products."""
        total = np.zeros((len(packed), tables.shape[2]), self.kind)
        part = np.empty_like(total)
        for plane in reversed(range(self.planes)):
            total <<= 1
            for group in range(self.groups):
                np.take(tables[group], packed[:, plane, group], axis=0, out=part, mode="clip")
                if plane == self.planes - 1:
                    total -= part
                else:
                    total += part
        return np.ascontiguousarray(total.T)


class Best:
    """The n best rows of each of some keys: score down, id up."""

    def __init__(self, keys: int, n: int, kind: type):
        self.n = n
        self.least = np.full(keys, np.iinfo(kind).min, kind)  # the n-th score of a key, once it has n rows
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, first_key: int, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """Scores (key, row) where fits; keys are numbered from first_key, step by step."""
        own = slice(first_key, first_key + len(scores))
        fits &= scores >= self.least[own, None]
        count = fits.sum(axis=1)
        if scores.shape[1] > self.n and (full := np.flatnonzero(count > 4 * self.n)).size:
            # Rows below a key's n-th score of this tile can't be among its n best.
            kept = np.where(fits[full], scores[full], np.iinfo(scores.dtype).min)
            cut = np.partition(kept, scores.shape[1] - self.n, axis=1)[:, scores.shape[1] - self.n]
            fits[full] &= scores[full] >= cut[:, None]
        key, row = np.nonzero(fits)
        if len(key):
            self._merge(key + first_key, scores[key, row].astype(np.int64), ids[row])

    def _merge(self, *rows: np.ndarray) -> None:
        key, score, doc = (np.concatenate(pair) for pair in zip((self.key, self.score, self.id), rows, strict=True))
        order = np.lexsort((doc, -score, key))
        key, score, doc = key[order], score[order], doc[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        keep = place < self.n
        self.key, self.score, self.id = key[keep], score[keep], doc[keep]
        last = place == self.n - 1
        self.least[key[last]] = score[last]


def _tiles(packing: Packing, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and packed vectors of some rows at a time, by label."""
    for batch in batches:
        order = np.argsort(kernels.as_numpy(batch.column("label")), kind="stable")
        batch = batch.take(pa.array(order))
        for at in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(at, TILE_ROWS)
            yield *(kernels.as_numpy(part.column(name)) for name in ("id", "label")), packing.bytes(part.column("planes"))


def _like(packing: Packing, n: int, batches: Iterator[pa.RecordBatch], block: tuple) -> Iterator[pa.RecordBatch]:
    """The n best other rows of each anchor's label. Anchors of the block are in order of their labels."""
    keys, labels, packed = block
    best = Best(len(keys), n, packing.kind)
    for ids, own, rows in _tiles(packing, batches):
        for label in np.unique(own).tolist():
            first, end = np.searchsorted(labels, [label, label + 1])
            low, high = np.searchsorted(own, [label, label + 1])
            for at in range(first, end, TILE_ANCHORS):
                some = slice(at, min(at + TILE_ANCHORS, end))
                scores = packing.scores(packing.tables(packed[some]), rows[low:high])
                best.offer(at, scores, keys[some, None] != ids[None, low:high], ids[low:high])
    yield pa.RecordBatch.from_arrays(
        [pa.array(column) for column in (keys[best.key], best.id, best.score)], ["query_id", "doc_id", "score"]
    )


def _unlike(
    packing: Packing, n: int, low: int, high: int, batches: Iterator[pa.RecordBatch], block: tuple
) -> Iterator[pa.RecordBatch]:
    """The n best rows of another label between the bounds that each (anchor, positive) sets."""
    keys, labels, packed, positives, reached, count = block
    most = positives.shape[1]
    least_fit, most_fit = -(-low * reached // 100), high * reached // 100
    none = np.arange(most) >= count[:, None]
    least_fit[none], most_fit[none] = 1, 0
    least_fit, most_fit = least_fit.astype(packing.kind), most_fit.astype(packing.kind)
    best = [Best(len(keys), n, packing.kind) for _ in range(most)]
    for ids, own, rows in _tiles(packing, batches):
        for at in range(0, len(keys), TILE_ANCHORS):
            some = slice(at, at + TILE_ANCHORS)
            scores = packing.scores(packing.tables(packed[some]), rows)
            other = labels[some, None] != own[None, :]
            for k in range(most):
                fits = (scores <= most_fit[some, k, None]) & (scores >= least_fit[some, k, None])
                best[k].offer(at, scores, fits & other, ids)
    for k in range(most):
        key = best[k].key
        columns = (keys[key], positives[key, k], reached[key, k], best[k].id, best[k].score)
        names = ["query_id", "positive_id", "positive_score", "doc_id", "score"]
        yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names)


def _ranked(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n best rows of each key, with their rank; ranked within groups of tasks first."""
    order = [F.desc("score"), F.asc("doc_id")]
    first = F.row_number().over(Window.partitionBy(*keys, "_group").orderBy(*order))
    few = found.withColumn("rank", first).where(F.col("rank") <= n).drop("_group")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return few.withColumn("rank", last).where(F.col("rank") <= n)


def packed(rows: DataFrame, scale: int = SCALE) -> tuple[DataFrame, Packing]:
    """Table (id, label, planes) of the rows (id, label, vector) that take part, and its packing."""
    vector = F.col("vector").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
    usable = usable.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    seen = usable.agg(F.max(F.size("vector")), F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    packing = Packing(seen[0] or 0, seen[1] or 0.0, seen[2] or 0.0, scale)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = packing.pack(batch.column("vector"))
            data = pa.array([row.tobytes() for row in planes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), data], ["id", "label", "planes"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = usable.mapInArrow(pack, PACKED).repartition(parts, "id")
    once = made.groupBy("id").agg(F.min(F.struct("label", "planes")).alias("row"))
    return common.stage(once.select("id", "row.*"), "vectors"), packing


def mine(
    rows: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """Hard negatives of the anchors among rows (id, label, vector): (anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score).

    anchor is a predicate on id. An anchor's positives are its best other rows of
    its label; the negatives of a positive are the best rows of other labels with
    low to high percent of the positive's score.
    """
    table, packing = packed(rows, scale)
    anchors = table.where(anchor).withColumnRenamed("id", "query_id")

    def by_label(block: pa.Table) -> tuple:
        block = block.sort_by([("label", "ascending"), ("query_id", "ascending")]).combine_chunks()
        keys, labels = (block.column(name).to_numpy() for name in ("query_id", "label"))
        return keys, labels, packing.bytes(block.column("planes"))

    def like(batches, block):
        return _like(packing, positives, batches, block)

    near = _ranked(blocks.search(anchors, table, by_label, like, SCORED, BLOCK), ["query_id"], positives)
    best = F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("positives")
    asked = anchors.join(near.groupBy("query_id").agg(best), "query_id")

    def with_positives(block: pa.Table) -> tuple:
        keys, labels, planes = by_label(block)
        block = block.sort_by([("label", "ascending"), ("query_id", "ascending")])
        ids = np.zeros((len(keys), positives), np.int64)
        reached, count = ids.copy(), np.zeros(len(keys), np.int64)
        for i, own in enumerate(block.column("positives").to_pylist()):
            count[i] = len(own)
            for k, row in enumerate(own):
                ids[i, k], reached[i, k] = row["doc_id"], row["score"]
        return keys, labels, planes, ids, reached, count

    def unlike(batches, block):
        return _unlike(packing, negatives, low, high, batches, block)

    found = blocks.search(asked, table, with_positives, unlike, MINED, BLOCK)
    ranked = _ranked(found, ["query_id", "positive_id", "positive_score"], negatives)
    return ranked.select(
        F.col("query_id").alias("anchor_id"),
        "positive_id",
        "rank",
        F.col("doc_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
