"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays.

Words are runs of bytes other than blanks (09-0D, 20); A-Z are lower-cased. A
text of fewer than five words has its whole word sequence as its only shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
CHUNK = 2_000_000  # bytes of text worked on at once; one longer text is a chunk by itself

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1


def odd(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


_POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(4095, 0x9E3779B97F4A7C15, np.uint64))]).astype(np.uint64)
_PLACES = odd(5, WIDTH + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(sizes: list[int], most: int = CHUNK) -> Iterator[slice]:
    """Slices of neighbouring texts of about `most` bytes in all."""
    first = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield slice(first, i)
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield slice(first, len(sizes))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[data]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    owner = np.cumsum(first) - 1
    place = np.arange(len(data)) - starts[np.maximum(owner, 0)]
    terms = _LOWER[data] * _POWERS[place & 4095]
    terms += (place >> 12).astype(np.uint64) * terms
    terms[blank] = 0
    ends = np.cumsum([len(text) + 1 for text in texts])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    return mix(np.add.reduceat(terms, starts)), counts


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order, and their number for each text."""
    hashes, counts = words(texts)
    ends = np.cumsum(counts)
    n = len(hashes)
    if not n:
        return hashes, np.zeros(len(texts), np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    out = np.zeros(n, np.uint64)
    for i in range(min(WIDTH, n)):
        out[: n - i] += hashes[i:] * _PLACES[i]
    left = ends[owner] - np.arange(n)
    whole = left >= WIDTH
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    for text in short:
        at = ends[text] - counts[text]
        own = hashes[at : ends[text]]
        size = np.full(1, len(own), np.uint64)
        out[at] = np.concatenate([own * _PLACES[: len(own)], size * _PLACES[WIDTH:]]).sum(dtype=np.uint64)
        whole[at] = True
    out = out[whole]
    return mix(out), np.bincount(owner[whole], minlength=len(texts))


def sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and their number."""
    hashes, counts = shingles(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.bincount(owner[fresh], minlength=len(texts))


def least(hashes: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each: one row per text that has shingles, one column per key."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.zeros((len(starts), len(keys)), np.uint32)
    for i, key in enumerate(keys):
        if len(starts):
            out[:, i] = np.minimum.reduceat((hashes ^ (key >> np.uint64(7))) * key, starts) >> np.uint64(32)
    return out
