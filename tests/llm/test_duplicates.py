"""Exact copies, near copies and repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskloom.llm import common, containment, graph, minhash_forest, shingles, suffix_sort

from .conftest import prose


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) < 5:
        return {tuple(words)} - {()}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def edited(text, seed, times):
    pick, words = random.Random(seed), text.split()
    for n in range(times):
        words[pick.randrange(len(words))] = f"edit{seed}x{n}"
    return " ".join(words)


def components(texts):
    sets = [shingle_set(text) for text in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return [(len(own), x) for own, x in zip(sets, label, strict=True)]


def test_content_sort(docs, query):
    texts = ["a b", "a  b", "a\t\nb", "A b", "a b ", None, "", "x" * 100_000, "x" * 100_000] + ["hot one"] * 40
    found = {row["doc_id"]: row for row in query("op6_content_sort", documents=docs(texts))}
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", text or "") for text in texts]
    for i, text in enumerate(plain):
        assert found[i]["keep_id"] == plain.index(text)
        assert found[i]["group_size"] == plain.count(text)
        assert found[i]["kept"] == (plain.index(text) == i)
        assert found[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_content_sort_keeps_one_of_repeated_rows(docs, query):
    found = query("op6_content_sort", documents=docs([(3, "t"), (3, "t"), (8, "t")]))
    assert [row["kept"] for row in found].count(True) == 1
    assert {(row["keep_id"], row["group_size"]) for row in found} == {(3, 3)}


def test_forest_against_all_pairs(docs, query):
    texts = [prose(i, 60) for i in range(30)] + ["Same Words here", "same words  HERE", "one", None, ""]
    texts += [edited(texts[i % 4], 100 + i, i % 5) for i in range(80)]  # crowded groups of near copies
    found = {row["doc_id"]: row for row in query("op5_minhash_forest", documents=docs(texts))}
    for i, (n, component) in enumerate(components(texts)):
        assert (found[i]["n_shingles"], found[i]["component_id"]) == (n, component)
        assert found[i]["kept"] == (i == component)


@pytest.mark.parametrize("slice_", [minhash_forest.SLICE, 50])
def test_crowded_links_beyond_the_window(slice_, docs, query, monkeypatch):
    """The first and the last are linked; everywhere in the orders others stand between them."""
    monkeypatch.setattr(minhash_forest, "WINDOW", 1)
    monkeypatch.setattr(minhash_forest, "SLICE", slice_)
    base, n = prose(1, 200), 150
    texts = [f"{base} {prose(100 + i, 25 if i in (0, n) else 80)}" for i in range(n + 1)]
    want = components(texts)
    assert [label for _, label in want] == [*range(n), 0]
    found = {row["doc_id"]: row for row in query("op5_minhash_forest", documents=docs(texts))}
    assert [(found[i]["n_shingles"], found[i]["component_id"]) for i in range(n + 1)] == want


def test_sketch_estimates_similarity(spark, docs):
    signed = minhash_forest.signatures(common.rows(docs([prose(1, 400), edited(prose(1, 400), 5, 9)]))).collect()
    a, b = (np.frombuffer(row["signature"], np.uint16) for row in signed)
    x, y = shingle_set(prose(1, 400)), shingle_set(edited(prose(1, 400), 5, 9))
    assert abs((a == b).mean() - len(x & y) / len(x | y)) < 0.15


def test_links_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5000, 5000)], "a long, b long")
    found = dict(graph.components(links).collect())
    assert all(found[i] == 0 for i in range(301)) and found[1001] == 1000


def test_components_are_extended(spark):
    schema = "a long, b long"
    nodes = graph.components(spark.createDataFrame([(1, 2), (3, 4), (5, 6)], schema))
    more = spark.createDataFrame([(4, 6), (2, 1), (9, 10), (6, 0)], schema)
    found = graph.extended(nodes, more).collect()
    assert sorted(found) == [(0, 0), (1, 1), (2, 1), (3, 0), (4, 0), (5, 0), (6, 0), (9, 9), (10, 9)]


def test_shingles_are_those_of_the_words():
    texts = [b"A b\x0bC d e F", b"a  B c d e f", b"", b" ", b"one", b"ONE", b"a b c d e a b c d e a", b"w" * 9000, b"w" * 9001]
    hashes, counts = shingles.sets(texts)
    parts = np.split(hashes, np.cumsum(counts)[:-1])
    assert counts.tolist() == [2, 2, 0, 0, 1, 1, 5, 1, 1]
    assert parts[0].tolist() == parts[1].tolist() and parts[4].tolist() == parts[5].tolist()
    assert parts[7].tolist() != parts[8].tolist()


def removed(texts, length=suffix_sort.LENGTH):
    bodies = [(text or "").encode() for text in texts]
    seen = Counter(body[i : i + length] for body in bodies for i in range(len(body) - length + 1))
    out = []
    for body in bodies:
        mask = np.zeros(len(body) + 1, int)
        for i in range(len(body) - length + 1):
            if seen[body[i : i + length]] > 1:
                mask[i : i + length] = 1
        kept = bytes(b for b, m in zip(body, mask, strict=False) if not m)
        out.append((len(body), int(mask.sum()), int((np.diff(mask, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("run", [suffix_sort.RUN, 2])
def test_repeated_passages(run, docs, query, monkeypatch):
    """With two contexts to a task, nearly every anchor goes the way of the crowded ones."""
    monkeypatch.setattr(suffix_sort, "RUN", run)
    shared = prose(7, 60)
    texts = [prose(i, 30) + " " + shared[i : i + 190 + 3 * i] + " " + prose(50 + i, 30) for i in range(12)]
    texts += [prose(90, 80)] * 3 + [edited(prose(91, 300), i, 3) for i in range(6)]
    texts += ["z" * 700, "ab" * 300, prose(92, 50) + prose(92, 50), "é" * 150, None, "", "x" * 199, "short"]
    found = {row["doc_id"]: row for row in query("op2_suffix_sort", documents=docs(texts))}
    for i, want in enumerate(removed(texts)):
        assert tuple(found[i][1:]) == want, i


def test_texts_travel_once_for_both_kinds_of_anchors(docs, query, monkeypatch):
    """Texts are compressed for a shuffle to cut contexts and for the result, not again for crowded anchors."""
    shuffled, packed = [], suffix_sort.packed
    monkeypatch.setattr(suffix_sort, "RUN", 2)
    monkeypatch.setattr(suffix_sort, "packed", lambda documents: shuffled.append(1) or packed(documents))
    shared = prose(7, 60)
    texts = [prose(i, 30) + " " + shared + " " + prose(50 + i, 30) for i in range(6)]
    texts += [prose(80 + i, 30) + " " + prose(8, 60) + " " + prose(90 + i, 30) for i in range(2)]
    found = {row["doc_id"]: row for row in query("op2_suffix_sort", documents=docs(texts))}
    assert [tuple(found[i][1:]) for i in range(len(texts))] == removed(texts)
    assert len(shuffled) == 2


def test_long_text_crosses_segments(docs, query, monkeypatch):
    monkeypatch.setattr(suffix_sort, "SEGMENT", 1 << 11)
    texts = [prose(1, 900), prose(2, 400) + prose(1, 900)[2000:4500], prose(3, 20)]
    found = {row["doc_id"]: row for row in query("op2_suffix_sort", documents=docs(texts))}
    for i, want in enumerate(removed(texts)):
        assert tuple(found[i][1:]) == want


def test_suffixes_are_sorted():
    pick = random.Random(5)
    data = bytes(pick.choice(b"ab") for _ in range(3000))
    sorter = suffix_sort.Sorter(data)
    starts, bucket = np.arange(0, 2900), np.arange(0, 2900) % 3
    order, equal = sorter.order(starts, bucket, np.full(2900, 16))
    keys = [(bucket[i], data[starts[i] : starts[i] + 16]) for i in order]
    assert keys == sorted(keys)
    assert equal.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:], strict=False)]


def test_contained_items(spark, docs):
    sizes = [5, 9, 17, 30, 66, 130]
    items = [(i, prose(200 + i, n)) for i, n in enumerate(sizes)] + [(7, "two words"), (8, prose(200, 5)), (9, None)]
    long = prose(300, 20_000).split()
    texts = [
        " ".join([*long[: 900 * (i + 1)], text.upper(), *long[900 * (i + 1) :]]) for i, text in items[:6]
    ] + ["Two  words", prose(301, 500), edited(items[5][1], 1, 5), edited(items[5][1], 1, 40)]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, text in enumerate(texts):
        own = shingle_set(text)
        for i, item in items:
            need = shingle_set(item)
            if need and 100 * len(own & need) >= 75 * len(need):
                want.add((i, d, len(own & need), len(need)))
    for block in (containment.BLOCK, 400):  # one block of items, and several
        found = containment.contained(common.rows(docs(texts)), common.rows(table, "item_id"), block=block).collect()
        assert {tuple(row) for row in found} == want and len(found) == len(want)


def test_scattered_and_short_items_are_found(spark, docs):
    short = [(i, prose(1000 + i, 5 + i % 4)) for i in range(400)]
    long = [(1000 + i, prose(2000 + i, 60)) for i in range(8)]
    words = prose(3000, 30_000).split()
    texts = []
    for n in range(0, 400, 10):  # short items inside long documents
        parts = [" ".join([*words[40 * n + 600 * k : 40 * n + 600 * k + 600], text]) for k, (_, text) in enumerate(short[n : n + 10])]
        texts.append(" ".join(parts))
    for _, text in long:  # pieces of an item, 2,000 words apart
        own = text.split()
        pieces = [" ".join([*own[k : k + 20], *words[100 * k : 100 * k + 2000]]) for k in (0, 20, 40)]
        texts.append(" ".join(pieces))
    items = short + long
    table = spark.createDataFrame(items, "item_id long, text string")
    sets = [shingle_set(text) for text in texts]
    want = set()
    for i, item in items:
        need = shingle_set(item)
        for d, own in enumerate(sets):
            if 100 * len(own & need) >= 75 * len(need):
                want.add((i, d, len(own & need), len(need)))
    assert len({i for i, *_ in want}) == len(items)
    found = containment.contained(common.rows(docs(texts)), common.rows(table, "item_id")).collect()
    assert {tuple(row) for row in found} == want and len(found) == len(want)


@pytest.mark.parametrize("ids", [[None, 5, 7], [7, None, 5, 5], [None, None], [None, 3]])
def test_content_sort_without_ids(ids, docs, query):
    """A row without id stays only where no row of its group has one."""
    found = query("op6_content_sort", documents=docs([(i, "t") for i in ids] + [(None, "other")]))
    group = [row for row in found if row["group_size"] == len(ids)]
    known = [i for i in ids if i is not None]
    keeper = min(known) if known else None
    assert [row["keep_id"] for row in group] == [keeper] * len(ids)
    assert [row["doc_id"] for row in group if row["kept"]] == [keeper]


@pytest.mark.parametrize("least", [10**6, 40])
def test_least_hashes_tell_links_from_others(least):
    pick = np.random.default_rng(3)
    sets = []
    for i in range(60):
        if i % 6 == 0:
            base = pick.integers(0, 2**64, pick.integers(1, 300), dtype=np.uint64)
        own = base.copy()
        changed = pick.random(len(own)) < pick.choice([0, 0.1, 0.14, 0.16, 0.3])
        own[changed] = pick.integers(0, 2**64, changed.sum(), dtype=np.uint64)
        sets.append(np.unique(own))
    upper = [(own >> np.uint64(32)).astype(np.uint32)[:least] for own in sets]
    n = np.array([len(own) for own in sets])
    i, j = np.triu_indices(60, 1)
    said = minhash_forest.shared(upper, upper, i, j, (n, n))
    for a, b, ok in zip(i, j, said):  # noqa: B905
        both = len(np.intersect1d(sets[a], sets[b]))
        similarity = both / (n[a] + n[b] - both)
        if similarity >= 0.75:
            assert ok
        elif least > 300 or similarity < 0.3:
            assert not ok
    assert 20 < said.sum() < 200


def test_crowded_families_pass_on_links_only(spark, docs):
    """Most members of a family are less alike than a link: they aren't passed on as pairs."""
    base = prose(8, 150)
    rows = [(i, edited(base, i, 3 + i % 9)) for i in range(300)]
    table = common.rows(docs(rows))
    signed = minhash_forest.signatures(table)
    texts = minhash_forest.texts_of(table, table.select("id"), False)
    known = signed.withColumn("component", F.col("id"))
    buckets = minhash_forest.crowded(known, 20)
    pairs = minhash_forest.across(known, buckets, None, minhash_forest.least_of(texts)).select("a", "b").distinct().collect()
    sets = [shingle_set(text) for _, text in rows]

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return 100 * both >= 75 * len(sets[a] | sets[b])

    assert pairs and all(linked(a, b) for a, b in pairs)
