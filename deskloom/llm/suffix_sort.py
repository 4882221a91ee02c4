"""Repeated passages of a corpus, byte by byte, by sorting suffixes.

A passage is a string of `length` bytes that starts at two places. Of every
window of that length one k-gram is the anchor, the one of least hash, so equal
windows have equal anchors at equal offsets. Only windows whose anchor occurs
twice in the corpus go on; neighbouring windows of one anchor travel together as
a context of at most 2 * `length` bytes, and equal contexts travel once.

Contexts of one anchor meet in a task. There the suffixes that start at the same
distance from the anchor are put in order by mergesort. Two suffixes are compared
through polynomial hashes of prefixes of the data: a binary search finds their
common extension, so a comparison takes a logarithmic number of steps. Neighbours
that agree for the whole length are compared byte by byte before they count, and
a bucket with a collision is sorted on its bytes. Suffixes go in blocks first:
blocks equal in all their bytes are repeated, blocks not even equal in the bytes
that all their windows share aren't, and only the rest is sorted start by start.

An anchor with very many different contexts, such as a line of a third of all
documents, isn't gathered: its blocks, and where these don't decide it its
windows, are counted by two hashes, 128 bits in all, in an aggregation that
combines before it shuffles.

Cases: null and empty texts and texts shorter than a passage keep everything.
Overlapping occurrences in one document count. Repeated rows are copies of each
other, so nothing of theirs beyond the length is kept. Rows of one id and
different texts are told apart by a hash of the text. Empty tables give an empty
result. Further columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingles

LENGTH = 200
GRAM = 50  # bytes of an anchor
SPAN = LENGTH - GRAM + 1  # places an anchor can have in a window
SEGMENT = 1 << 19  # bytes worked on at once, a power of two
BLOCK = 16  # starts that are compared together
RUN = 1024  # different contexts of an anchor that meet in a task

_BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


class Prefixes:
    """Polynomial hashes of all prefixes of some data, modulo 2**64."""

    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int = 0):
        base, n = _BASES[which], len(data)
        held = self.tables.get(which)
        if held is None or len(held[0]) <= n:
            size = max(n + 1, SEGMENT + 4 * LENGTH)
            held = self.tables[which] = powers(base, size), powers(pow(base, -1, 1 << 64), size)
        self.inverse = held[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * held[0][:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of substrings, the same wherever they stand."""
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]


def least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every `span` neighbours."""
    n = len(values) - span + 1
    rows = -(-len(values) // span)
    padded = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(rows, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])


def anchored(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of texts that stand one after another: first and last window, place, two hashes.

    `ends` are the ends of the texts in the data; a window lies within one text.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    n = len(data) - LENGTH + 1
    if n < 1:
        return none
    prefixes = Prefixes(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = shingles.mix((prefixes.sums[GRAM:] - prefixes.sums[:-GRAM]) * prefixes.inverse[: len(at)])
    mask = np.uint64(SEGMENT - 1)
    anchors = (least((grams & ~mask) | at.astype(np.uint64), SPAN) & mask).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    valid = np.zeros(n + 1, np.int64)
    fits = ends - starts >= LENGTH
    valid[starts[fits]] += 1
    valid[(ends - LENGTH + 1)[fits]] -= 1
    inside = np.cumsum(valid[:n]) > 0
    anchors = np.where(inside, anchors, -1)
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    kept = anchors[first] >= 0
    first, last = first[kept], last[kept]
    place = anchors[first]
    context = shingles.mix(Prefixes(data, 1).of(first, last + LENGTH))
    return first, last, place, grams[place].view(np.int64), context.view(np.int64)


def segments(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Numbers of texts, where in them their parts start, and the parts, one segment in all at most.

    A longer text comes in parts that share all but one byte of a window.
    """
    numbers, size, own = [], 0, []
    for number, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        if size and size + len(text) > SEGMENT:
            yield numbers, [0] * len(numbers), own
            numbers, size, own = [], 0, []
        if len(text) <= SEGMENT:
            numbers.append(number)
            own.append(text)
            size += len(text)
            continue
        for start in range(0, len(text) - LENGTH + 1, SEGMENT - LENGTH + 1):
            yield [number], [start], [text[start : start + SEGMENT]]
    if numbers:
        yield numbers, [0] * len(numbers), own


PLACED = "gram long, context long, shape int, id long, key long, first long"


def anchors(documents: DataFrame) -> DataFrame:
    """One row per anchor; shape packs the number of further windows and the anchor's offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.unpacked(batches):
            ids, keys = batch.column("id"), batch.column("key")
            for numbers, origins, own in segments(texts):
                ends = np.cumsum([len(text) for text in own])
                first, last, place, gram, context = anchored(np.frombuffer(b"".join(own), np.uint8), ends)
                text = np.searchsorted(ends, first, side="right")
                origin = np.array(origins)[text] - (ends - [len(part) for part in own])[text]
                row = pa.array(np.array(numbers)[text])
                shape = ((last - first) << 8) | (place - first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram),
                        pa.array(context),
                        pa.array(shape.astype(np.int32)),
                        ids.take(row),
                        keys.take(row),
                        pa.array(first + origin),
                    ],
                    ["gram", "context", "shape", "id", "key", "first"],
                )

    return documents.select("id", "key", "text").mapInArrow(run, PLACED)


def repeated(documents: DataFrame) -> DataFrame:
    """Hashes of the anchors that occur twice at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in common.unpacked(batches):
            for _, _, own in segments(texts):
                ends = np.cumsum([len(text) for text in own])
                gram = anchored(np.frombuffer(b"".join(own), np.uint8), ends)[3]
                gram, n = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), pa.array(np.minimum(n, 2).astype(np.int32))], ["gram", "n"]
                )

    counted = documents.select("text").mapInArrow(run, "gram long, n int")
    return counted.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram")


def packed(documents: DataFrame) -> DataFrame:
    """(id, key, packed) with the text compressed, for less to shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch, texts in common.unpacked(batches):
            made = [press.compress(text) for text in texts]
            columns = [batch.column("id"), batch.column("key"), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "packed"])

    return documents.select("id", "key", "text").mapInArrow(run, "id long, key long, packed binary")


CUT = "gram long, context long, shape int, n long, crowded boolean, body binary"


def contexts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of contexts, each from the one document named for it; from every copy of a repeated row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            size = 0
            for text, places in zip(batch.column("packed").to_pylist(), batch.column("places").to_pylist(), strict=True):
                body = unpack.decompress(text)
                for p in places:
                    part = body[p["first"] : p["first"] + (p["shape"] >> 8) + LENGTH]
                    rows.append((p["gram"], p["context"], p["shape"], p["n"], p["crowded"], part))
                    size += len(part)
                if size > 8_000_000:
                    yield table(rows)
                    rows, size = [], 0
            if rows:
                yield table(rows)

    def table(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["gram", "context", "shape", "n", "crowded", "body"])

    place = F.struct("first", "gram", "context", "shape", "n", "crowded")
    places = wanted.groupBy("id", "key").agg(F.collect_list(place).alias("places"))
    joined = packed(documents).alias("d").join(
        places.alias("p"), F.col("d.id").eqNullSafe(F.col("p.id")) & (F.col("d.key") == F.col("p.key"))
    )
    return joined.select("packed", "places").mapInArrow(run, CUT)


class Sorter:
    """Suffixes of some data in order, within buckets."""

    def __init__(self, data: bytes):
        self.bytes = data
        self.data = np.frombuffer(data + b"\0" * 8, np.uint8)
        self.prefixes = Prefixes(self.data)
        self.heads = np.ndarray((len(data) + 1,), ">u8", self.data.tobytes(), strides=(1,))

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, `most` at most, by binary search."""
        sums, inverse = self.prefixes.sums, self.prefixes.inverse
        sx, sy, ix, iy = sums[x], sums[y], inverse[x], inverse[y]
        low, high = np.zeros(len(x), np.int64), most.copy()
        probe = most
        while True:
            same = (sums[x + probe] - sx) * ix == (sums[y + probe] - sy) * iy
            low = np.where(same, probe, low)
            high = np.where(same, high, probe - 1)
            if (low >= high).all():
                return low
            probe = (low + high + 1) >> 1

    def less(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Whether suffix x is before y; `equal` says what equal ones give."""
        a, b = self.heads[x], self.heads[y]
        out = a < b
        alike = np.flatnonzero(a == b)
        if len(alike):
            x, y, cap = x[alike], y[alike], most[alike]
            shared = self.common(x, y, cap)
            tail = self.data[x + shared] < self.data[y + shared]
            out[alike] = np.where(shared >= cap, equal[alike], tail)
        return out

    def order(self, starts: np.ndarray, bucket: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the suffixes by bucket and order, and whether each equals the one before.

        All suffixes of a bucket have the same `most`. Bottom-up mergesort of all
        buckets together: an element's new place is its place in its own run plus
        the number of smaller ones in the run it is merged with.
        """
        order = np.argsort(bucket, kind="stable")
        label = bucket[order]
        fresh = np.concatenate([[True], label[1:] != label[:-1]]) if len(order) else np.zeros(0, bool)
        base = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        firsts = np.flatnonzero(fresh)
        size = np.repeat(np.diff(np.append(firsts, len(order))), np.diff(np.append(firsts, len(order))))
        run = 1
        while len(size) and run < size.max():
            at = np.flatnonzero(size > run)
            place = at - base[at]
            mine = place // run
            low = base[at] + (mine ^ 1) * run
            high = np.minimum(low + run, base[at] + size[at])
            low = np.minimum(low, high)
            paired = low < high
            at, place, mine, low, high = (values[paired] for values in (at, place, mine, low, high))
            from_ = low.copy()
            x, cap = starts[order[at]], most[order[at]]
            right = (mine & 1) == 1
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) >> 1
                before = self.less(starts[order[middle]], x[open_], cap[open_], right[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
                open_ = open_[low[open_] < high[open_]]
            target = base[at] + (mine >> 1) * 2 * run + (place - mine * run) + (low - from_)
            moved = order[at]
            order[target] = moved
            run *= 2
        equal = np.zeros(len(order), bool)
        at = np.flatnonzero(~fresh)
        if len(at):
            x, y, cap = starts[order[at - 1]], starts[order[at]], most[order[at]]
            equal[at] = self.common(x, y, cap) >= cap
            at = at[equal[at]]
            x, y, cap = starts[order[at - 1]], starts[order[at]], most[order[at]]
            for wrong in np.unique(base[at[~self.verified(x, y, cap)]]).tolist():
                end = wrong + size[wrong]
                text = lambda i: self.bytes[starts[i] : starts[i] + most[i]]
                own = sorted(order[wrong:end].tolist(), key=text)
                order[wrong:end] = own
                equal[wrong + 1 : end] = [text(a) == text(b) for a, b in zip(own, own[1:], strict=False)]
        return order, equal

    def verified(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether the bytes agree, eight at a time; the last eight may overlap those before."""
        out = np.ones(len(x), bool)
        for step in range(0, int(most.max(initial=0)), 8):
            shift = np.minimum(step, most - 8)
            out &= self.heads[x + shift] == self.heads[y + shift]
        return out


def classes(order: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each element's class of equals, and the size of the class."""
    number = np.cumsum(~equal) - 1
    out = np.empty(len(order), np.int64)
    out[order] = number
    return out, np.bincount(number, minlength=1)[out] if len(out) else out


def blocked(shape: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of neighbouring windows: context, number, and least and largest distance from the anchor."""
    width, offset = (shape >> 8).astype(np.int64), (shape & 255).astype(np.int64)
    first, last = (offset - width) // BLOCK, offset // BLOCK
    count = last - first + 1
    owner = np.repeat(np.arange(len(shape)), count)
    block = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    near = np.maximum(block * BLOCK, (offset - width)[owner])
    far = np.minimum(block * BLOCK + BLOCK - 1, offset[owner])
    return owner, block, near, far


def resolve(gram: np.ndarray, shape: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each context that another context of its anchor has; -1 if none."""
    m = len(bodies)
    sizes = np.array([len(body) for body in bodies], np.int64)
    base = np.cumsum(sizes) - sizes
    sorter = Sorter(b"".join(bodies))
    offset = (shape & 255).astype(np.int64)
    owner, block, near, far = blocked(shape)
    anchor = base[owner] + offset[owner]
    group = np.unique(gram, return_inverse=True)[1][owner]

    def bucket(*parts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(parts[0]), np.int64)
        for part in parts:
            out = out * 512 + part
        return out

    whole = LENGTH + far - near
    order, equal = sorter.order(anchor - far, bucket(group, near, far), whole)
    done = classes(order, equal)[1] > 1
    shared = np.full(len(owner), LENGTH - BLOCK + 1)
    order, equal = sorter.order(anchor - block * BLOCK, bucket(group, block), shared)
    family, members = classes(order, equal)
    open_ = np.bincount(family, weights=~done, minlength=1) > 0 if len(family) else np.zeros(1, bool)
    kept = np.flatnonzero((members > 1) & open_[family])
    steps = (far - near + 1)[kept]
    element = np.repeat(kept, steps)
    distance = near[element] + np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
    order, equal = sorter.order(
        anchor[element] - distance, bucket(family[element], distance), np.full(len(element), LENGTH)
    )
    again = classes(order, equal)[1] > 1

    first, last = np.full(m, np.iinfo(np.int64).max), np.full(m, -1)
    for own, a, b in ((owner[done], near[done], far[done]), (owner[element[again]], distance[again], distance[again])):
        np.minimum.at(first, own, offset[own] - b)
        np.maximum.at(last, own, offset[own] - a)
    return np.where(last < 0, -1, first), last


FOUND = "gram long, context long, shape int, low int, high int"


def meet(cut: DataFrame) -> DataFrame:
    """Windows that different contexts of one anchor share; whole groups in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            own = distinct(pa.Table.from_batches([batch] if kept is None else [*kept.to_batches(), batch]))
            gram = own.column("gram").to_numpy()
            change = np.flatnonzero(gram[1:] != gram[:-1])
            full = int(change[-1]) + 1 if len(change) else 0
            yield from parts(own.slice(0, full))
            kept = own.slice(full)
        if kept is not None:
            yield from parts(kept)

    def distinct(own: pa.Table) -> pa.Table:
        """Without rows that repeat the one before."""
        keys = [own.column(name).to_numpy() for name in ("gram", "context", "shape")]
        fresh = np.ones(len(own), bool)
        fresh[1:] = np.any([key[1:] != key[:-1] for key in keys], axis=0)
        return own if fresh.all() else own.filter(pa.array(fresh))

    def parts(own: pa.Table) -> Iterator[pa.RecordBatch]:
        gram = own.column("gram").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(gram[1:] != gram[:-1]) + 1, [len(gram)]]) if len(gram) else [0]
        start = 0
        for i in range(1, len(edges)):
            if edges[i] - start >= 2000 or i == len(edges) - 1:
                yield one(own.slice(start, edges[i] - start))
                start = edges[i]

    def one(own: pa.Table) -> pa.RecordBatch:
        shape = own.column("shape").to_numpy()
        first, last = resolve(own.column("gram").to_numpy(), shape, own.column("body").to_pylist())
        hit = pa.array((last >= 0) & (own.column("n").to_numpy() == 1))
        columns = [own.column(name).combine_chunks() for name in ("gram", "context", "shape")]
        columns += [pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["gram", "context", "shape", "low", "high"]).filter(hit)

    dealt = cut.repartition("gram").sortWithinPartitions("gram", "context", "shape")
    return dealt.mapInArrow(run, FOUND)


UNIT = "one long, two long, whole boolean, gram long, context long, shape int, n long, low int, high int"


def salted(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray) -> list[pa.Array]:
    """Two independent hashes of each substring and its salt."""
    both = [Prefixes(data, which).of(starts, ends) for which in (0, 1)]
    return [pa.array(shingles.mix(one + shingles.mix(salt.astype(np.uint64))).view(np.int64)) for one in both]


def units(cut: DataFrame) -> DataFrame:
    """For every block of a context two rows: by all bytes of its windows, and by those they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, base in few(batches):
            shape = batch.column("shape").to_numpy()
            owner, block, near, far = blocked(shape)
            offset = (shape & 255)[owner].astype(np.int64)
            anchor = base[owner] + offset
            kept = [batch.column(name).take(pa.array(owner)) for name in ("gram", "context", "shape", "n")]
            kept += [pa.array((offset - far).astype(np.int32)), pa.array((offset - near).astype(np.int32))]
            core = anchor - block * BLOCK
            for whole, starts, ends, salt in (
                (True, anchor - far, anchor - near + LENGTH, near * 512 + far + (1 << 20)),
                (False, core, core + LENGTH - BLOCK + 1, block),
            ):
                flag = pa.array(np.full(len(owner), whole))
                yield pa.RecordBatch.from_arrays([*salted(data, starts, ends, salt), flag, *kept], NAMES)

    NAMES = ["one", "two", "whole", "gram", "context", "shape", "n", "low", "high"]
    return cut.mapInArrow(run, UNIT)


def windows(cut: DataFrame) -> DataFrame:
    """One row per window of the ranges of a context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, base in few(batches):
            ranges = [[(r["low"], r["high"]) for r in own] for own in batch.column("ranges").to_pylist()]
            owner = np.repeat(np.arange(len(ranges)), [sum(b - a + 1 for a, b in own) for own in ranges])
            step = np.concatenate([np.arange(a, b + 1) for own in ranges for a, b in own])
            starts = base[owner] + step
            offset = (batch.column("shape").to_numpy() & 255)[owner].astype(np.int64)
            kept = [batch.column(name).take(pa.array(owner)) for name in ("gram", "context", "shape", "n")]
            yield pa.RecordBatch.from_arrays(
                [*salted(data, starts, starts + LENGTH, offset - step), *kept, pa.array(step.astype(np.int32))],
                ["one", "two", "gram", "context", "shape", "n", "step"],
            )

    return cut.mapInArrow(run, "one long, two long, gram long, context long, shape int, n long, step int")


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Small slices of contexts, their bytes in a row, and where each starts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            bodies = part.column("body").to_pylist()
            sizes = np.array([len(body) for body in bodies], np.int64)
            yield part, np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(sizes) - sizes


def count(cut: DataFrame) -> DataFrame:
    """The same for anchors of very many contexts, by counting instead of sorting.

    Blocks repeated in all their bytes are done. Of the others only those whose
    shared bytes are repeated can have a repeated window. Their windows are
    counted, together with those of one context for every kind of done block.
    """
    key = ["gram", "context", "shape"]
    cut = common.stage(cut, "suffix-crowded")
    found = common.stage(units(cut), "suffix-units")
    often = found.groupBy("one", "two").agg(F.count("*").alias("times")).filter("times > 1").drop("times")
    hit = common.stage(found.join(often, ["one", "two"], "left_semi"), "suffix-hits")
    done = hit.filter("whole")
    place = F.struct(*key, "low", "high")
    known = done.groupBy("one", "two").agg(F.min(place).alias("at")).select("at.*")
    left = hit.filter("not whole").select(*key, "low", "high").join(done.select(*key, "low"), [*key, "low"], "left_anti")
    ranges = left.union(known).groupBy(*key).agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    single = common.stage(windows(cut.join(ranges, key)), "suffix-windows")
    twice = single.groupBy("one", "two").agg(F.count("*").alias("times")).filter("times > 1").drop("times")
    more = single.join(twice, ["one", "two"], "left_semi").select(*key, "n", F.col("step").alias("low"), F.col("step").alias("high"))
    every = done.select(*key, "n", "low", "high").union(more).filter("n = 1")
    return every.groupBy(*key).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def spans(documents: DataFrame) -> DataFrame:
    """(id, key, spans) of the documents with repeated bytes; spans may overlap.

    Input rows are (id, key, text), the key a hash that tells texts of one id apart.
    """
    twice = common.stage(repeated(documents), "suffix-grams")
    placed = common.stage(anchors(documents).join(twice, "gram", "left_semi"), "suffix-anchors")
    kinds = placed.groupBy("gram", "context", "shape").agg(
        F.count("*").alias("n"), *[F.first(name).alias(name) for name in ("id", "key", "first")]
    )
    kinds = common.stage(kinds, "suffix-contexts")
    several = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    copied = kinds.filter("n > 1").select(
        "gram", "context", "shape", F.lit(0).alias("low"), F.shiftright("shape", 8).alias("high")
    )
    wanted = kinds.join(several, "gram").withColumn("crowded", F.col("kinds") > RUN)
    # Cut once for both ways of comparing, as all texts are shuffled for it.
    cut = common.stage(contexts(documents, wanted), "suffix-cut")
    # Where every context of an anchor is copied there is nothing left to find.
    found = copied.union(meet(cut.filter("not crowded").drop("crowded")))
    crowded = cut.filter("crowded").drop("crowded")
    if not crowded.isEmpty():
        found = found.union(count(crowded.dropDuplicates(["gram", "context", "shape"])))
    found = common.stage(found, "suffix-found")
    hit = placed.join(found, ["gram", "context", "shape"])
    span = F.struct((F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high") + LENGTH).alias("stop"))
    return hit.groupBy("id", "key").agg(F.collect_list(span).alias("spans"))


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the spans."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((span["start"], span["stop"]) for span in found or ()):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], stop)
        else:
            out.append((start, stop))
    return out


def cleaned(documents: DataFrame) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row (id, text); kept is binary."""
    keyed = documents.select("id", F.xxhash64(F.col("id").isNull(), "id", "text").alias("key"), "text")
    found = spans(keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for text, own in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                body, runs = unpack.decompress(text), merged(own)
                edges = [0, *[edge for run in runs for edge in run], len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(body), len(body) - len(kept), len(runs), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = packed(keyed).alias("d").join(
        found.alias("f"), F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.key") == F.col("f.key")), "left"
    )
    kind = "id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return joined.select("d.id", "packed", "spans").mapInArrow(run, kind)
