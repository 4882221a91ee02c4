"""Periodic runs of words by suffix trees, and texts without the repetition.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends keeping q. The method, for a sequence of words:

1. Ukkonen's suffix trees of the sequence and of its reversal, each with an
   Euler tour whose depths a sparse table answers minima of: the depth of the
   lowest common ancestor of two leaves is the longest common extension of two
   places, forward in one tree and backward in the other, in constant time.
2. Candidates of a run are the longest Lyndon words that begin at each place, in
   both orders of the alphabet. They end at the next smaller suffix, or the next
   greater one, so the order of the leaves gives them all.
3. Each candidate, as the root of a run with its length as period, is extended
   both ways; if the extensions together reach a period, there is a run. Every
   run has its Lyndon root among them.

Sequences are stretches of a text. A run of at least `least` words and
`exponent` periods repeats each of its short word sequences, of a length that
follows from the two bounds. So where a short sequence stands only once, no run
passes, and the trees are built over what lies between such places; this loses
no run, and is done again for what is left, `ROUNDS` times at most.

Cases: a null or empty text has no runs and stays empty. A text without runs is
its words joined by one space. Repeated rows give equal results. An empty table
gives an empty result. Further columns are ignored. Words are bytes between
blanks (09-0D, 20), compared whole, with letter case. Texts are read whole; a
task holds the trees of one stretch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST, EXPONENT = 6, 4  # words and periods of a run at least
RUN = "struct<start: long, length: long, period: long>"
FOUND = f"id long, runs array<{RUN}>, collapsed binary"

ROUNDS = 8  # of narrowing stretches down before their trees are built

_SHIFT = 32


class SuffixTree:
    """Suffix tree of a list of whole numbers >= 0, with constant-time common extensions.

    `order` is the lexicographic order of the suffixes; the empty suffix is the
    smallest.
    """

    def __init__(self, symbols: list[int]):
        text = [*(symbol + 1 for symbol in symbols), 0]  # 0 ends the text and occurs nowhere else
        self.n = len(text)
        self._grow(text)
        self._tour(text)

    def _grow(self, text: list[int]) -> None:
        """Ukkonen's construction: one symbol at a time, from the active point."""
        n = len(text)
        start, end, parent, link, suffix = [0], [0], [0], [0], [-1]
        child: dict[int, int] = {}
        node = length = edge = waiting = 0
        for i, symbol in enumerate(text):
            waiting += 1
            made = 0
            while waiting:
                if not length:
                    edge = i
                key = node << _SHIFT | text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i), end.append(n), parent.append(node), link.append(0), suffix.append(i - waiting + 1)
                    if made:
                        link[made] = node
                        made = 0
                else:
                    first = start[below]
                    size = end[below] - first
                    if length >= size:
                        edge += size
                        length -= size
                        node = below
                        continue
                    if text[first + length] == symbol:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    middle = len(start)
                    start.append(first), end.append(first + length), parent.append(node), link.append(0), suffix.append(-1)
                    child[key] = middle
                    start[below] = first + length
                    parent[below] = middle
                    child[middle << _SHIFT | text[first + length]] = below
                    child[middle << _SHIFT | symbol] = middle + 1
                    start.append(i), end.append(n), parent.append(middle), link.append(0), suffix.append(i - waiting + 1)
                    if made:
                        link[made] = middle
                    made = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self._nodes = start, end, parent, suffix

    def _tour(self, text: list[int]) -> None:
        """Euler tour with children by first symbol, and the minima of its depths."""
        start, end, parent, suffix = map(np.array, self._nodes)
        count = len(start)
        letter = np.array(text)[start]
        letter[0] = parent[0] = -1
        ranked = np.lexsort((letter, parent))[1:]  # children of a node side by side; without the root
        edges = np.searchsorted(parent[ranked], np.arange(count + 1)).tolist()
        children = ranked.tolist()
        size = (end - start).tolist()
        tour, visits, leaves = [], [0] * count, []
        stack = [(0, 0, edges[0])]  # node, its depth, next child
        visits[0] = 0
        tour.append(0)
        while stack:
            node, depth, at = stack.pop()
            if at == edges[node + 1]:
                if stack:
                    tour.append(stack[-1][1])
                continue
            stack.append((node, depth, at + 1))
            below = children[at]
            visits[below] = len(tour)
            deeper = depth + size[below]
            tour.append(deeper)
            if edges[below] == edges[below + 1]:
                leaves.append(below)
                tour.append(depth)
            else:
                stack.append((below, deeper, edges[below]))
        self.order = suffix[leaves]
        place = np.zeros(self.n, np.int64)  # where the tour meets the leaf of each suffix
        place[self.order] = np.array(visits)[leaves]
        self._place = place
        level = np.array(tour, np.int32)
        self._minima = [level]
        step = 1
        while step < len(level):
            level = np.minimum(level[:-step], level[step:])
            self._minima.append(level)
            step *= 2

    def extension(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at two places share, for arrays of different places."""
        a, b = self._place[first], self._place[second]
        low, high = np.minimum(a, b), np.maximum(a, b) + 1
        level = np.frexp(high - low)[1] - 1
        out = np.zeros(len(low), np.int64)
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            table = self._minima[k]
            out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k)])
        return out


def next_beyond(rank: list[int]) -> np.ndarray:
    """For each place the next place of a smaller rank, the length if there is none."""
    n = len(rank)
    out, stack = [n] * n, []
    for at, own in enumerate(rank):
        while stack and rank[stack[-1]] > own:
            out[stack.pop()] = at
        stack.append(at)
    return np.array(out, np.int64)


def runs(symbols: list[int], least: int = 2, exponent: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start and period.

    A run has `exponent` periods (2 or more) and `least` symbols or more. A Lyndon
    word has no smaller period, so neither has the run it is the root of.
    """
    n = len(symbols)
    if n < max(2, least):
        return []
    forward, backward = SuffixTree(symbols), SuffixTree(symbols[::-1])
    rank = np.zeros(n + 1, np.int64)
    rank[forward.order] = np.arange(n + 1)
    places = np.arange(n)
    first, second = [], []
    for order in (rank[:n].tolist(), (-rank[:n]).tolist()):
        end = next_beyond(order)
        inside = end < n
        first.append(places[inside])
        second.append(end[inside])
    i, j = np.concatenate(first), np.concatenate(second)
    period = j - i
    # Backward from before i and j: place x of the text is n - 1 - x of the reversal.
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    left[inner] = backward.extension(n - i[inner], n - j[inner])
    right = forward.extension(i, j)
    start, length = i - left, left + right + period
    whole = (length >= exponent * period) & (length >= 2 * period) & (length >= least)
    found = np.unique(np.stack([start, period, length], 1)[whole], axis=0)
    return [(start, length, period) for start, period, length in found.tolist()]


def gram(least: int, exponent: int) -> int:
    """Words of the longest sequences each of which a run repeats at a distance of its period."""
    return min(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 1))


def stretches(words: np.ndarray, size: int, least: int) -> list[tuple[int, int]]:
    """Parts of a sequence of word numbers in which every `size` words in a row occur again.

    Each is (first, end) of at least `least` words. A run lies in one of them.
    """
    parts = [(0, len(words))] if len(words) >= least else []
    for _ in range(ROUNDS):
        if not parts or size < 1:
            break
        # Same numbers for the same words of the same part: all parts are narrowed at once.
        lengths = np.array([end - first - size + 1 for first, end in parts])
        owner = np.repeat(np.arange(len(parts)), lengths)
        starts = np.repeat(np.array([first for first, _ in parts]) - np.cumsum(lengths) + lengths, lengths)
        starts += np.arange(len(starts))
        key = owner.astype(np.uint64)
        for i in range(size):
            key = key * np.uint64(0x9E3779B97F4A7C15) + words[starts + i].astype(np.uint64)
            key ^= key >> np.uint64(29)
        _, place, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[place] > 1
        edge = np.ones(len(again), bool)
        edge[1:] = (owner[1:] != owner[:-1]) | (again[1:] != again[:-1])
        at = np.flatnonzero(edge)
        sizes = np.diff(np.append(at, len(again)))
        own = again[at] & (sizes + size - 1 >= least)
        narrowed = [(a, a + b + size - 1) for a, b in zip(starts[at[own]].tolist(), sizes[own].tolist(), strict=True)]
        if narrowed == parts:
            break
        parts = narrowed
    return parts


def text_runs(words: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, by start and period."""
    least = max(least, exponent)
    if len(words) < least:
        return []
    numbers: dict[bytes, int] = {}
    own = np.array([numbers.setdefault(word, len(numbers)) for word in words], np.int64)
    found = []
    for first, end in stretches(own, gram(least, exponent), least):
        found += [(first + start, length, period) for start, length, period in runs(own[first:end].tolist(), least, exponent)]
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined, without those that a run contains after its first period."""
    if not found:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[at] for at in kept.tolist()])


def find(
    documents: DataFrame,
    least: int = LEAST,
    exponent: int = EXPONENT,
    prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(id, runs, collapsed) of every row (id, text).

    prepare(id, words) may change the words of a text before they are searched.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.unpacked(batches):
            all_runs, all_texts = [], []
            for key, text in zip(part.column("id").to_pylist(), texts, strict=True):
                words = (text or b"").split()
                if prepare:
                    words = prepare(key, words)
                own = text_runs(words, least, exponent)
                all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                all_texts.append(collapsed(words, own))
            kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(all_runs, kind), pa.array(all_texts, pa.binary())],
                ["id", "runs", "collapsed"],
            )

    return documents.select("id", F.col("text").cast("string").alias("text")).mapInArrow(search, FOUND)
