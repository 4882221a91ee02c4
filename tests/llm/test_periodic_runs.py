"""Runs against all periods tried one by one."""

import hashlib
import random
import time
import zlib

import numpy as np

from deskloom.llm import periodic_runs

from .conftest import prose


def plain(words, least, exponent):
    """Runs by definition, (start, length, period)."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - at >= max(least, exponent * q, 2 * q):
                found.setdefault((at, end + q - at), q)  # the smallest period comes first
            at = max(end, at + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda run: (run[0], run[2]))


def sequences(count, seed=3):
    pick = random.Random(seed)
    for i in range(count):
        letters = pick.choice([1, 2, 3, 6])
        words = [pick.randrange(letters) for _ in range(pick.randrange(50))]
        if i % 2:
            root = [pick.randrange(letters + 2) for _ in range(pick.randrange(1, 7))]
            words = words[:9] + root * pick.randrange(2, 8) + root[: pick.randrange(len(root))] + words[9:30] + root * 5
        yield words


def test_runs_of_two_periods():
    for words in sequences(1500):
        assert periodic_runs.runs(words) == plain(words, 2, 2), words


def test_runs_of_texts_with_bounds():
    for i, words in enumerate(sequences(1500, 4)):
        least, exponent = [(6, 4), (2, 2), (3, 3), (10, 2), (2, 5)][i % 5]
        found = periodic_runs.text_runs([b"%d" % word for word in words], least, exponent)
        assert found == plain(words, max(least, exponent), exponent), (words, least, exponent)


def test_extensions_are_the_shared_beginnings():
    for words in sequences(200, 5):
        if len(words) < 2:
            continue
        tree = periodic_runs.SuffixTree(words)
        assert [words[i:] for i in tree.order.tolist()] == sorted(words[i:] for i in range(len(words) + 1))
        i, j = np.triu_indices(len(words), 1)
        shared = [next((k for k in range(len(words)) if words[a : a + k + 1] != words[b : b + k + 1] or b + k >= len(words)), 0) for a, b in zip(i, j)]  # noqa: B905
        assert tree.extension(i, j).tolist() == shared


def test_narrowing_keeps_every_run():
    words = [f"{i}".encode() for i in range(400)] + [b"a", b"b"] * 5 + [f"{i}".encode() for i in range(400)] + [b"c"] * 6
    assert periodic_runs.text_runs(words) == [(400, 10, 2), (810, 6, 1)]
    numbers = np.unique(words, return_inverse=True)[1]
    assert sum(end - first for first, end in periodic_runs.stretches(numbers, periodic_runs.gram(6, 4), 6)) < 40


def test_long_run_takes_linear_time():
    started = time.process_time()
    assert periodic_runs.text_runs([b"w%d" % (i % 5000) for i in range(60_000)]) == [(0, 60_000, 5000)]
    assert time.process_time() - started < 20


def expected(key, text):
    """The row of the query, from the definition."""
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain(words, 6, 4)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = 1000 * best[1] // best[2] if runs else None
    return (str(key), len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query(docs, query):
    texts = [prose(i, 40 + i) for i in range(60)]
    texts += ["la la la la la la", "a b " * 9 + "c " * 8, "A a A a A a", "x y " * 12, prose(5, 3) + " tra la" * 400]
    rows = [*enumerate(texts), (70, None), (71, ""), (72, " \n\t"), (None, "no no no no no no no"), (3, texts[3])]
    found = query("op12_periodic_runs", documents=docs(rows))
    told = [(str(r[0]), *tuple(r)[1:]) for r in found]
    assert sorted(told, key=str) == sorted((expected(*row) for row in rows), key=str)
    assert sum(row[1] > 0 for row in told) > 6
