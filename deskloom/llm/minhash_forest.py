"""Near duplicates by an LSH forest over MinHash signatures.

Every tree is one sorted order of the signatures: Spark range-partitions and
sorts all (tree, signature) rows, and a sweep takes as candidates the rows with
the longest common prefixes, which are the neighbours. The depth adapts to the
region: a row is compared with the `WINDOW` rows after it that share the first
`SHALLOW` values at least, so in a crowded region the deepest prefixes come
first. Sketches sort out clearly different pairs.

A first sweep takes the nearest neighbours in some of the trees, which connects
most of every group with few pairs. The next one pairs, of the rows that aren't
connected yet, all in the window, in all trees. Where more than `WINDOW` rows
share the first values (a crowded bucket), the rows outside the bucket's largest
component are compared with every row of the bucket, best candidates first, until
no pair of different components is left untried. These rows carry their least
shingle hashes, all of them in a text of up to `LEAST` shingles, so a task counts
what two rows share and passes on the pairs that reach the similarity, not those
that only look alike. A link counts only after the full shingle sets have been
compared.

A link of similarity 0.75 shares the first three values of a tree with
probability 0.42, so all 24 trees miss it with 2e-6, in a crowded bucket too. The
price is that rows of one bucket that stay apart are compared with one another in
the task, which takes time with the square of their number, but no rows.

Cases: a null or empty text, or one of blanks only, has no shingles, links with
nothing and is kept. Equal sets are linked by a 128-bit hash of the sorted set.
Repeated rows are one node. A row without id takes its class from others and
links nothing itself. Texts are read whole. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, shingles

TREES = 24
DEPTH = 6  # values of a tree's key
SHALLOW = 3  # values that candidates share at least
KEYS = shingles.odd(41, TREES * DEPTH)
WINDOW = 64  # rows that a row is compared with in a sweep
SLICE = 4096  # rows of a crowded bucket that a task compares with those outside its largest component
BEST = (4, None)  # candidates of a row that the passes over crowded buckets try; the last tries all
FIRST = 6  # trees whose nearest neighbours the first sweep pairs
SKETCH = 0.55  # estimated similarity below which a pair is no candidate, 4 deviations under 0.75
PERCENT = 75
LEAST = 256  # least hashes of a text that rows of crowded buckets carry
LIKELY = 0.61  # similarity by the least hashes of longer texts below which a pair is no link, 5 deviations under 0.75

SIGNED = "id long, n_shingles long, set_key binary, signature binary"
SWEPT = "a long, b long, estimate float"


def signatures(documents: DataFrame) -> DataFrame:
    """(id, n_shingles, set_key, signature) of every row (id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.unpacked(batches):
            for part in shingles.chunks([len(text) for text in texts]):
                hashes, counts = shingles.sets(texts[part])
                values = iter(shingles.least(hashes, counts, KEYS).astype(np.uint16))
                ends = np.cumsum(counts)
                keys, made = [], []
                for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
                    keys.append(blake2b(hashes[end - n : end].tobytes(), digest_size=16).digest() if n else None)
                    made.append(next(values).tobytes() if n else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id")[part.start : part.stop],
                        pa.array(counts, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(made, pa.binary()),
                    ],
                    ["id", "n_shingles", "set_key", "signature"],
                )

    return documents.select("id", "text").mapInArrow(sign, SIGNED)


def dealt(signed: DataFrame, label: str) -> DataFrame:
    """One row per tree: (tree, k1, k2, id, n, label, sketch); four key values in k1, two in k2."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, TREES, DEPTH)
            n = len(values)
            bits = (values.reshape(n, -1, 4) & 3).astype(np.uint8)
            sketch = bits[:, :, 0] | bits[:, :, 1] << 2 | bits[:, :, 2] << 4 | bits[:, :, 3] << 6
            sketches = pa.array([row.tobytes() for row in sketch], pa.binary())
            wide = values.astype(np.int64)
            for tree in range(TREES):
                v = wide[:, tree]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, tree, np.int32)),
                        pa.array((v[:, 0] << 48) | (v[:, 1] << 32) | (v[:, 2] << 16) | v[:, 3]),
                        pa.array((v[:, 4] << 16) | v[:, 5]),
                        batch.column("id"),
                        batch.column("n_shingles"),
                        batch.column(label),
                        sketches,
                    ],
                    ["tree", "k1", "k2", "id", "n", "label", "sketch"],
                )

    return signed.select(*dict.fromkeys(["id", "n_shingles", label, "signature"])).mapInArrow(
        deal, "tree int, k1 long, k2 long, id long, n long, label long, sketch binary"
    )


def orders(signed: DataFrame, label: str, without: DataFrame | None = None) -> DataFrame:
    """The rows of all trees in order, without some buckets; no bucket lies in two partitions."""
    rows = dealt(signed, label)
    if without is not None:
        rows = rows.withColumn("bucket", F.shiftright("k1", 16)).join(without, ["tree", "bucket"], "left_anti").drop("bucket")
    rows = rows.repartitionByRange("tree", F.shiftright("k1", 16))
    return rows.sortWithinPartitions("tree", "k1", "k2", "id")


def best(rows: np.ndarray, close: np.ndarray, most: int | None) -> np.ndarray:
    """Places of the `most` closest candidates of every row."""
    order = np.lexsort((-close, rows))
    if most is None or not len(order):
        return order
    starts = np.flatnonzero(np.diff(rows[order], prepend=rows[order[0]] - 1))
    return order[np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order))) < most]


def closeness(apart: np.ndarray) -> np.ndarray:
    """Estimated similarity of two rows whose sketches differ in so many values."""
    return ((1 - apart / (TREES * DEPTH)) - 0.25) / 0.75


def swept(a, b, close) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(a, pa.int64()),
            pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()),
            pa.nulls(n, pa.float32()) if b is None else pa.array(close.astype(np.float32)),
        ],
        ["a", "b", "estimate"],
    )


def sweep(window: int, first_trees: int = 0):
    """Pairs of neighbouring rows of different labels.

    For the first sweep only nearest neighbours in the first trees, and every
    row with a candidate in any tree, or in a crowded bucket, as (id, null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = {name: batch.column(name).to_numpy() for name in ("tree", "k1", "id", "n", "label")}
            own["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(
                batch.num_rows, -1
            )
            old = 0
            if kept is not None:
                old = len(kept["id"])
                own = {name: np.concatenate([kept[name], values]) for name, values in own.items()}
            n = len(own["id"])
            bucket = own["k1"] >> 16
            fresh = np.ones(n, bool)
            fresh[1:] = (bucket[1:] != bucket[:-1]) | (own["tree"][1:] != own["tree"][:-1])
            first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            marked = np.zeros(n, bool)
            found = []
            for step in range(1, min(window, n - 1) + 1):
                i = np.arange(max(0, old - step), n - step)
                j = i + step
                same = first[i] == first[j]
                if step == window:
                    marked[i[same]] = marked[j[same]] = True
                same &= own["label"][i] != own["label"][j]
                low, high = np.minimum(own["n"][i], own["n"][j]), np.maximum(own["n"][i], own["n"][j])
                i = i[same & (100 * low >= PERCENT * high)]
                if not len(i):
                    continue
                j = i + step
                differs = own["sketch"][i] ^ own["sketch"][j]
                apart = np.bitwise_count((differs | differs >> np.uint32(1)) & np.uint32(0x55555555)).sum(1)
                close = closeness(apart)
                good = close >= SKETCH
                marked[i[good]] = marked[j[good]] = True
                if first_trees:
                    good &= (step == 1) & (own["tree"][i] < first_trees)
                if good.any():
                    found.append((i[good], j[good], close[good]))
            if found:
                i, j, close = (np.concatenate(part) for part in zip(*found, strict=True))
                a, b = own["id"][i], own["id"][j]
                yield swept(np.minimum(a, b), np.maximum(a, b), close)
            if first_trees and marked.any():
                yield swept(np.unique(own["id"][marked]), None, None)
            kept = {name: values[max(0, n - window) :] for name, values in own.items()}

    return run


def crowded(known: DataFrame, window: int) -> DataFrame:
    """(tree, bucket, size, main) of the buckets of more than `window` rows and several components; main is the largest."""
    rows = dealt(known, "component").groupBy("tree", F.shiftright("k1", 16).alias("bucket"), "label").agg(F.count("*").alias("n"))
    whole = rows.groupBy("tree", "bucket").agg(
        F.sum("n").alias("size"), F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")
    )
    return whole.filter((F.col("size") > window) & (F.col("labels") > 1)).drop("labels")


def shared(out: list[np.ndarray], every: list[np.ndarray], i: np.ndarray, j: np.ndarray, n: tuple) -> np.ndarray:
    """Which pairs (out[i], every[j]) may be links, by their least hashes; n: numbers of shingles of the two.

    Up to the smaller of the two largest hashes, each side has all its hashes; of
    two texts of up to LEAST shingles these are the sets.
    """
    good = np.zeros(len(i), bool)
    edges = np.flatnonzero(np.diff(i, prepend=-1, append=-1)) if len(i) else np.zeros(1, int)
    for first, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        x, others = out[i[first]], [every[at] for at in j[first:end].tolist()]
        sizes = np.array([len(y) for y in others])
        owner = np.repeat(np.arange(len(others)), sizes)
        y = np.concatenate(others)
        whole = np.array([len(x) == n[0][i[first]]] * len(others)) & (sizes == n[1][j[first:end]])
        last = np.minimum(x[-1], y[np.cumsum(sizes) - 1])
        last[whole] = np.iinfo(np.uint32).max
        at = np.minimum(np.searchsorted(x, y), len(x) - 1)
        within = y <= last[owner]
        both = np.bincount(owner, (x[at] == y) & within, len(others))
        union = np.searchsorted(x, last, "right") + np.bincount(owner, within, len(others)) - both
        good[first:end] = np.where(whole, 100 * both >= PERCENT * union, both >= LIKELY * union)
    return good


def across(known: DataFrame, buckets: DataFrame, most: int | None, least: DataFrame) -> DataFrame:
    """Pairs of rows of different components anywhere in the crowded buckets that look
    like links, of the `most` closest of each row in a slice.

    The rows outside a bucket's main component go to each of its slices, every row to one.
    """
    rows = dealt(known, "component").withColumn("bucket", F.shiftright("k1", 16)).join(buckets, ["tree", "bucket"])
    slices = F.ceil(F.col("size") / SLICE).cast("int")
    own = F.array(F.struct(F.pmod(F.xxhash64("id"), slices).cast("int").alias("slice"), F.lit(True).alias("late")))
    each = F.transform(F.sequence(F.lit(0), slices - 1), lambda s: F.struct(s.alias("slice"), F.lit(False).alias("late")))
    places = F.when(F.col("label") != F.col("main"), F.concat(each, own)).otherwise(own)
    carried = ["main", "id", "n", "label", "sketch", "least"]
    rows = rows.join(least, "id").select("tree", "bucket", *carried, F.explode(places).alias("place"))
    rows = rows.select("tree", "bucket", "place.slice", "place.late", *carried)
    group = ["tree", "bucket", "slice"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in (*group, "late", "main", "id", "n", "label")}
            table["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            table["least"] = np.empty(batch.num_rows, object)
            table["least"][:] = [np.frombuffer(part, np.uint32) for part in batch.column("least").to_pylist()]
            fresh = np.any([np.diff(table[name], prepend=table[name][0]) != 0 for name in group], axis=0)
            bounds = [0, *np.flatnonzero(fresh).tolist(), batch.num_rows]
            for low, high in zip(bounds, bounds[1:], strict=False):
                now = tuple(int(table[name][low]) for name in group)
                if now != key:
                    key, held = now, None
                middle = low + int((~table["late"][low:high]).sum())  # the early ones come first
                if middle > low:
                    more = {name: table[name][low:middle] for name in ("id", "n", "label", "sketch", "least")}
                    held = more if held is None else {name: np.concatenate([held[name], more[name]]) for name in more}
                if held is not None and high > middle:
                    every = {name: table[name][middle:high] for name in ("id", "n", "label", "sketch", "least", "main")}
                    for at in range(0, len(held["id"]), 256):
                        yield from pairs({name: values[at : at + 256, None] for name, values in held.items()}, every)

    def pairs(out: dict, every: dict) -> Iterator[pa.RecordBatch]:
        once = (every["label"] == every["main"]) | (out["id"] < every["id"])  # two outside the main component meet twice
        low, high = np.minimum(out["n"], every["n"]), np.maximum(out["n"], every["n"])
        i, j = np.nonzero((out["label"] != every["label"]) & once & (100 * low >= PERCENT * high))
        if not len(i):
            return
        apart = np.zeros(len(i), np.int64)
        for word in range(every["sketch"].shape[1]):
            differs = out["sketch"][:, 0, word][i] ^ every["sketch"][:, word][j]
            apart += np.bitwise_count((differs | differs >> np.uint32(1)) & np.uint32(0x55555555))
        close = closeness(apart)
        good = np.flatnonzero(close >= SKETCH)
        chosen = np.sort(good[best(i[good], close[good], most)])
        a, b = i[chosen], j[chosen]
        linked = shared(out["least"][:, 0], every["least"], a, b, (out["n"][:, 0], every["n"]))
        chosen = chosen[linked]
        if len(chosen):
            a, b = out["id"][i[chosen], 0], every["id"][j[chosen]]
            yield swept(np.minimum(a, b), np.maximum(a, b), close[chosen])

    return rows.repartition(*group).sortWithinPartitions(*group, "late").mapInArrow(compare, SWEPT)


def texts_of(documents: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """(id, packed): the compressed texts of some documents, one for each id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch, texts in common.unpacked(batches):
            made = [press.compress(text) for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary())], ["id", "packed"])

    packed = documents.filter("id is not null").select("id", "text").mapInArrow(pack, "id long, packed binary")
    found = packed.join(ids, "id", "left_semi")
    return found.dropDuplicates(["id"]) if repeated else found


def least_of(texts: DataFrame) -> DataFrame:
    """(id, least): the upper halves of the least shingle hashes of packed texts, in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            packed, made = batch.column("packed").to_pylist(), []
            for part in shingles.chunks([zstandard.frame_content_size(text) for text in packed]):
                hashes, counts = shingles.sets([unpack.decompress(text) for text in packed[part]])
                upper = (hashes >> np.uint64(32)).astype(np.uint32)  # in order, as the hashes of a text are
                starts = (np.cumsum(counts) - counts).tolist()
                made += [upper[at : at + min(n, LEAST)].tobytes() for at, n in zip(starts, counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary())], ["id", "least"])

    return texts.select("id", "packed").mapInArrow(cut, "id long, least binary")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            left, right = batch.column("pa").to_pylist(), batch.column("pb").to_pylist()
            sizes = [zstandard.frame_content_size(x) + zstandard.frame_content_size(y) for x, y in zip(left, right, strict=True)]
            good = np.zeros(batch.num_rows, bool)
            for part in shingles.chunks(sizes):
                packed = list(dict.fromkeys(left[part] + right[part]))
                number = {text: i for i, text in enumerate(packed)}
                hashes, counts = shingles.sets([unpack.decompress(text) for text in packed])
                parts = np.split(hashes, np.cumsum(counts)[:-1])
                for i in range(part.start, part.stop):
                    x, y = parts[number[left[i]]], parts[number[right[i]]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    first = texts.select(F.col("id").alias("a"), F.col("packed").alias("pa"))
    second = texts.select(F.col("id").alias("b"), F.col("packed").alias("pb"))
    full = pairs.select("a", "b").join(first, "a").join(second, "b")
    return full.select("a", "b", "pa", "pb").mapInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(id, n_shingles, component, kept) for every row (id, text)."""
    signed = common.stage(signatures(documents), "forest-signatures")
    classes = (
        signed.filter("n_shingles > 0")
        .groupBy("set_key")
        .agg(F.min("id").alias("rep"), F.max("id").alias("last"))
        .filter("rep is not null")
    )
    classes = common.stage(classes, "forest-classes")
    alone = signed.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    swept = common.stage(orders(alone, "id").mapInArrow(sweep(WINDOW, FIRST), SWEPT), "forest-sweep")
    pairs = swept.filter("b is not null").select("a", "b").distinct()
    alike = common.stage(swept.filter("b is null").select(F.col("a").alias("id")).distinct(), "forest-alike")
    repeated = not signed.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    texts = common.stage(texts_of(documents, alike, repeated), "forest-texts")
    alone = common.stage(alone.join(alike, "id", "left_semi"), "forest-rows")

    tried = common.stage(pairs, "forest-pairs")
    links = common.stage(confirmed(tried, texts), "forest-links")
    nodes = common.stage(graph.components(links), "forest-nodes")

    def linked(found: DataFrame) -> None:
        """Tries the pairs that weren't tried before."""
        nonlocal tried, nodes
        rest = common.stage(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "forest-rest")
        more = common.stage(confirmed(rest, texts), "forest-more")
        tried = tried.union(rest)
        if not more.isEmpty():
            nodes = common.stage(graph.extended(nodes, more), "forest-nodes")

    def labelled() -> DataFrame:
        return alone.join(nodes, "id", "left").withColumn("component", F.coalesce("component", "id"))

    def crowds(known: DataFrame) -> DataFrame:
        return common.stage(crowded(known, WINDOW), "forest-crowded")

    known = labelled()
    few = orders(known, "component", crowds(known).select("tree", "bucket"))
    linked(few.mapInArrow(sweep(WINDOW), SWEPT))
    least = None
    for most in BEST:
        known = labelled()
        buckets = crowds(known)
        if buckets.isEmpty():
            break
        if least is None:
            least = common.stage(least_of(texts), "forest-least")
        linked(across(known, buckets, most, least))

    same = classes.filter("rep < last").select("set_key", "rep")
    named = signed.select("id", "n_shingles", "set_key").join(same, "set_key", "left")
    named = named.withColumn("rep", F.coalesce("rep", "id"))
    found = nodes.select(F.col("id").alias("rep"), "component")
    return named.join(found, "rep", "left").select(
        "id",
        "n_shingles",
        F.coalesce("component", "rep").alias("component"),
        F.col("id").eqNullSafe(F.coalesce("component", "rep")).alias("kept"),
    )
