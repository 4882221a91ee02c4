"""Packing of tokenised documents into sequences of a fixed length.

Documents become pieces; only one longer than a sequence is cut, with the odd
piece first. Pieces are dealt at random into groups of about `GROUP`, each
packed by one task: best fit in order of size, then local search. The search
takes documents from the emptier of two underfull bins: it moves one, exchanges
one for a smaller one, or two for one, always so that the sum of squared fills
grows, until no such step is left; bins that end up empty are dropped. A group
wastes less than a few sequences, a share of some 1e-4.

Ids are those of the given tokenizer file. Texts of Latin letters and common
signs go through a faster encoder of the same vocabulary, if its file is given;
for them the two agree, whatever Unicode versions they were built with.

Cases: a null or empty text is the end token alone. Repeated rows are packed each. An
empty table gives no pieces. Further columns are ignored. Texts of any length
are packed whole.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 2048
END = 0  # id that closes a document
GROUP = 20_000  # pieces packed together

PLAIN = re.compile(r"[\x00-ɏ‐-‧€]*")
PIECES = "id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def encoder(vocabulary: str, ranks: str | None, pattern: str | None):
    """Function from texts to lists of ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(vocabulary)
    full.encode_special_tokens = True
    if not ranks:
        return lambda texts: [made.ids for made in full.encode_batch_fast(texts, add_special_tokens=False)]
    import tiktoken

    with open(ranks, "rb") as file:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [
            fast.encode_ordinary(text) if PLAIN.fullmatch(text) else full.encode(text, add_special_tokens=False).ids
            for text in texts
        ]

    return encode


def pieces(
    documents: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, length: int = LENGTH
) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every row (id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks, pattern)
        for batch in batches:
            keys, texts, rows = batch.column("id").to_pylist(), batch.column("text").to_pylist(), []
            for at in range(0, len(texts), 200):
                for key, ids in zip(keys[at : at + 200], encode(texts[at : at + 200]), strict=True):
                    whole = np.array([*ids, END], "<u4")
                    first = len(whole) % length or length
                    edges = [0, *range(first, len(whole) + 1, length)]
                    for n, (start, end) in enumerate(zip(edges, edges[1:], strict=False)):
                        rows.append((key, n, start, end - start, zlib.crc32(whole[start:end].tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int32()),
                    *[pa.array(column, pa.int64()) for column in columns[2:]],
                ],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    return documents.select("id", "text").mapInArrow(cut, PIECES)


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Bins of item numbers; items in falling order, each into the fullest bin it fits."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r: some bin has room r
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = length, len(bins)
            bins.append([])
        bins[at].append(item)
        left = room - size
        if left:
            by_room[left].append(at)
            rooms |= 1 << left
    return bins


def improve(bins: list[list[int]], sizes: np.ndarray, length: int) -> list[list[int]]:
    """Local search over the underfull bins; full ones stay as they are."""
    fills = np.array([sizes[own].sum() for own in bins], np.int64)
    opened = np.flatnonzero(fills < length)
    items = np.array([item for at in opened for item in bins[at]], np.int64)
    if len(opened) < 2:
        return bins
    home = np.full(len(sizes), -1, np.int64)
    for at in opened:
        home[bins[at]] = at
    own_sizes = sizes[items].astype(np.int64)
    own_home = home[items]

    def gain(low: int, moved: int, back: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Growth of the sum of squares when `moved` tokens go up and `back` come down; -1 if barred."""
        net = moved - back
        grown = 2 * net * (fills[to] - fills[low] + net)
        return np.where((net > 0) & (to != low) & (fills[to] + net <= length), grown, -1)

    def step(low: int) -> bool:
        inside = np.flatnonzero(own_home == low)
        room = np.where(opened == low, -1, length - fills[opened])
        best = (0, None, None, None)
        for x in inside:
            moved = int(own_sizes[x])
            fits = gain(low, moved, np.zeros(len(opened), np.int64), opened)
            at = int(fits.argmax())
            if fits[at] > best[0]:
                best = (int(fits[at]), [x], None, int(opened[at]))
            swaps = gain(low, moved, own_sizes, own_home)
            at = int(swaps.argmax())
            if swaps[at] > best[0]:
                best = (int(swaps[at]), [x], at, int(own_home[at]))
        most = int(room.max())
        for i, x in enumerate(inside):
            for y in inside[i + 1 :]:
                moved = int(own_sizes[x] + own_sizes[y])
                if moved - int(own_sizes.max()) > most:
                    continue
                swaps = gain(low, moved, own_sizes, own_home)
                at = int(swaps.argmax())
                if swaps[at] > best[0]:
                    best = (int(swaps[at]), [x, y], at, int(own_home[at]))
        _, up, down, to = best
        if up is None:
            return False
        for x in up:
            own_home[x] = to
            fills[to] += own_sizes[x]
            fills[low] -= own_sizes[x]
        if down is not None:
            own_home[down] = low
            fills[low] += own_sizes[down]
            fills[to] -= own_sizes[down]
        return True

    changed = True
    while changed:
        changed = False
        for low in opened[np.argsort(fills[opened], kind="stable")]:
            while 0 < fills[low] < length and step(int(low)):
                changed = True
    shut = set(opened.tolist())
    out = [own for at, own in enumerate(bins) if at not in shut]
    for at in opened:
        own = items[own_home == at].tolist()
        if own:
            out.append(own)
    return out


def pack(cut: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Pieces with their sequence and their place in it."""

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([(name, "ascending") for name in ("id", "piece", "ids_crc32")])
        sizes = table.column("length").to_numpy()
        bins = improve(best_fit(sizes, length), sizes, length)
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for number, own in enumerate(bins):
            sequence[own] = number
            offset[own] = np.cumsum(sizes[own]) - sizes[own]
        number = table.column("part")[0].as_py()
        done = table.drop_columns(["part"])
        done = done.append_column("sequence_id", pa.array(sequence + (number << 32), pa.int64()))
        return done.append_column("offset", pa.array(offset, pa.int64()))

    parts = -(-cut.count() // group)
    part = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(max(parts, 1)))
    return cut.withColumn("part", part).groupBy("part").applyInArrow(fill, PACKED)


def sequences(
    documents: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, length: int = LENGTH
) -> DataFrame:
    """Pieces of all documents, packed."""
    cut = common.stage(pieces(documents, vocabulary, ranks, pattern, length), "packing-pieces")
    return pack(cut, length)
