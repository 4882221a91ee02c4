"""Benchmark items that a document contains, by MinHash over size partitions.

Items are put into partitions by their number of shingles, doubling in size. For
a partition of up to u shingles every document is read as windows of 2u
shingles, u apart, so a passage of an item lies whole in some window, whose
Jaccard similarity with the item is then high however long the document is: at
least 0.17 for the smallest items of a partition at containment 0.75, 0.33 for
the largest. A window's MinHash values are the minima of two blocks, and blocks
of the larger partitions are minima of smaller blocks, so all partitions cost
one pass over the shingles. Any equal value makes a candidate. That alone can miss:
short items, whose share of a window is small, and items whose shingles lie
scattered over a document, in no window together. So candidates also come from an
exact lookup: a document with 75% of an item's n shingles has one of any n/4 + 1 of
them (rounded down), and those are looked up that the fewest items of the block have.
Every candidate is verified by the exact share of the item's shingles that the
document has, so no item is missed.

Items travel to the tasks in blocks of bounded size, one scan per block; a
benchmark of any size works.

Cases: null and empty texts have no shingles, contain nothing and are contained
in nothing. An item of fewer than five words is its whole word sequence, so it
is found only in a text of the same words. Repeated items count once, equal
items of different ids each. Repeated documents give one row each. Empty tables
give no rows. Further columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingles

PERCENT = 75
KEYS = shingles.odd(43, 64)
SMALLEST = 16  # shingles of the smallest size partition
BLOCK = 16_000_000  # bytes of items sent to the tasks at once
SEEN = 24  # bits of a shingle that tell first whether it can be a rare one

FOUND = "item_id long, id long, n_shared long, n_item long"


class Items:
    """Index of one block of items: per size partition and key, sorted values and their items."""

    def __init__(self, ids: list[int], texts: list[bytes], percent: int = PERCENT):
        hashes, counts = shingles.sets(texts)
        self.ids = np.array(ids, np.int64)[counts > 0]
        parts = np.split(hashes, np.cumsum(counts)[:-1]) if len(counts) else []
        self.sets = [part for part in parts if len(part)]
        sizes = counts[counts > 0]
        values = shingles.least(hashes, counts, KEYS)
        scale = np.maximum(np.ceil(np.log2(np.maximum(sizes, 1) / SMALLEST)), 0).astype(int) if len(sizes) else sizes
        self.scales = {}
        for level in np.unique(scale).tolist():
            own = np.flatnonzero(scale == level)
            order = np.argsort(values[own], axis=0, kind="stable")
            self.scales[level] = (np.take_along_axis(values[own], order, 0), own[order])
        self.rare, self.rare_items = rarest(hashes, sizes, percent)
        self.seen = np.zeros(1 << SEEN, bool)
        self.seen[self.rare >> np.uint64(64 - SEEN)] = True

    def looked_up(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(document, item) numbers where the document has one of the item's rarest shingles."""
        at = np.flatnonzero(self.seen[hashes >> np.uint64(64 - SEEN)])
        low = np.searchsorted(self.rare, hashes[at])
        width = np.searchsorted(self.rare, hashes[at], side="right") - low
        docs = np.searchsorted(np.cumsum(counts), at, side="right")
        return np.stack([np.repeat(docs, width), self.rare_items[np.repeat(low, width) + offsets(width)]], 1)

    def candidates(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Distinct (document, item) numbers that share a value in some window or a rare shingle."""
        found = [self.looked_up(hashes, counts)]
        docs = np.flatnonzero(counts)
        if not len(docs) or not self.scales:
            return np.zeros((0, 2), np.int64)
        counts = counts[docs]
        starts = np.cumsum(counts) - counts
        blocks = -(-counts // SMALLEST)
        firsts = np.repeat(starts, blocks) + SMALLEST * offsets(blocks)
        minima = np.empty((len(firsts), len(KEYS)), np.uint32)
        for k, key in enumerate(KEYS):
            minima[:, k] = np.minimum.reduceat((hashes ^ (key >> np.uint64(7))) * key, firsts) >> np.uint64(32)
        for level in range(max(self.scales) + 1):
            if level:
                begins = np.cumsum(blocks) - blocks
                halves = -(-blocks // 2)
                minima = np.minimum.reduceat(minima, np.repeat(begins, halves) + 2 * offsets(halves), axis=0)
                blocks = halves
            if level not in self.scales:
                continue
            owner = np.repeat(np.arange(len(docs)), blocks)
            window = minima.copy()
            joined = np.flatnonzero(owner[1:] == owner[:-1])
            window[joined] = np.minimum(minima[joined], minima[joined + 1])
            values, items = self.scales[level]
            for k in range(len(KEYS)):
                low = np.searchsorted(values[:, k], window[:, k])
                high = np.searchsorted(values[:, k], window[:, k], side="right")
                hit = np.flatnonzero(high > low)
                if len(hit):
                    width = high[hit] - low[hit]
                    at = np.repeat(low[hit], width) + offsets(width)
                    found.append(np.stack([np.repeat(docs[owner[hit]], width), items[at, k]], 1))
        return np.unique(np.concatenate(found), axis=0)


def rarest(hashes: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles, and their items: of each item as many of the rarest as no document with `percent` can lack all of."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, number, times = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.lexsort((hashes, times[number], owner))
    needed = -(-percent * sizes // 100)
    chosen = order[offsets(sizes) < np.repeat(sizes - needed + 1, sizes)]
    chosen = chosen[np.argsort(hashes[chosen], kind="stable")]
    return hashes[chosen], owner[chosen]


def offsets(widths: np.ndarray) -> np.ndarray:
    """0..width-1 for every width, in one array."""
    return np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths)


def search(documents: DataFrame, packed, percent: int) -> DataFrame:
    """Verified rows of one block of items, sent as a pickled list of (id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*pickle.loads(packed.value), percent)
        for batch, texts in common.unpacked(batches):
            ids = batch.column("id")
            for part in shingles.chunks([len(text) for text in texts]):
                hashes, counts = shingles.shingles(texts[part])
                ends = np.cumsum(counts)
                rows = []
                for doc, item in items.candidates(hashes, counts):
                    own = np.unique(hashes[ends[doc] - counts[doc] : ends[doc]])
                    shared = len(np.intersect1d(own, items.sets[item], assume_unique=True))
                    if 100 * shared >= percent * len(items.sets[item]):
                        rows.append((items.ids[item], ids[part.start + int(doc)].as_py(), shared, len(items.sets[item])))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(column, pa.int64()) for column in zip(*rows, strict=True)],
                        ["item_id", "id", "n_shared", "n_item"],
                    )

    return documents.select("id", "text").mapInArrow(scan, FOUND)


def contained(documents: DataFrame, items: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(item_id, id, n_shared, n_item) of every item and document that contains it.

    Both inputs have rows (id, text). Blocks of items are collected one at a time.
    """
    spark = documents.sparkSession
    items = items.filter("id is not null").select("id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block + 1)
    found = []
    for number in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == number).collect()
        sent = spark.sparkContext.broadcast(pickle.dumps(([r["id"] for r in own], [r["text"].encode() for r in own])))
        part = search(documents, sent, percent)
        found.append(part if blocks == 1 else common.stage(part, "containment-block"))
        if blocks > 1:
            sent.unpersist()
    return reduce(DataFrame.union, found)
