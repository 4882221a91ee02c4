"""Hard negatives against all inner products."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deskloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id int, score string, query_id string"


def table(spark, rows):
    return spark.createDataFrame([(*row, 1, "x", "y") for row in rows], SCHEMA)


def made(count, size=12, seed=1):
    pick = random.Random(seed)
    return [(i, [pick.gauss(0, 0.4) + (j == i % 3) for j in range(size)], pick.randrange(4)) for i in range(count)]


def plain(rows):
    """The rows of the query, from the definition."""
    usable = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in vector]
        usable[key] = ((label + 1) % 10 if key % 7 == 0 else label, whole)
    out = []
    for anchor, (label, vector) in usable.items():
        if anchor % 50:
            continue
        scores = sorted((-sum(x * y for x, y in zip(vector, v)), key) for key, (_, v) in usable.items() if key != anchor)  # noqa: B905
        same = [(-s, key) for s, key in scores if usable[key][0] == label][:5]
        for score, positive in same:
            fit = [(-s, key) for s, key in scores if usable[key][0] != label and 50 * score <= -100 * s <= 95 * score]
            out += [(anchor, positive, rank, key, score, s) for rank, (s, key) in enumerate(fit[:3], 1)]
    return sorted(out)


def test_query(spark, query):
    rows = made(700)
    rows += [(700, None, 1), (701, [1.0, None], 1), (702, [float("nan")], 1), (703, [float("inf")], 1), (704, [0.5], None),
             (None, [1.0], 1), (750, [], 2), (751, [2.0, 1.0], 2), (-50, [1.0] * 12, 3), (800, rows[0][1], 0), (801, rows[0][1], 0)]
    found = query("op13_hard_negatives", embeddings=table(spark, rows))
    expected = plain(rows)
    assert sorted(tuple(row) for row in found) == expected
    assert len(expected) > 30


def test_ties_and_a_label_of_its_own(spark, query):
    rows = [(i, [1.0, 0.0], 1) for i in range(0, 60, 3)] + [(100 + i, [0.8, 0.1], 2) for i in range(40)] + [(350, [1.0], 9)]
    found = sorted(tuple(row) for row in query("op13_hard_negatives", embeddings=table(spark, rows)))
    assert found == plain(rows) and found


def test_repeated_rows_count_once(spark, query):
    rows = made(300)
    once = query("op13_hard_negatives", embeddings=table(spark, rows))
    twice = query("op13_hard_negatives", embeddings=table(spark, rows + rows[:90]))
    assert sorted(map(tuple, once)) == sorted(map(tuple, twice))


def test_empty_table(spark, query):
    assert query("op13_hard_negatives", embeddings=table(spark, [])) == []


@pytest.mark.parametrize("size, spread", [(64, 0.5), (3, 4.0), (17, 9e3)])
def test_scores_are_exact(size, spread):
    values = np.random.default_rng(2).normal(0, spread, (50, size))
    packing = hard_negatives.Packing(size, values.min(), values.max(), 256)
    packed = packing.pack(pa.array(values.tolist()))
    whole = np.floor(256 * values).astype(np.int64)
    assert (packing.scores(packing.tables(packed[:20]), packed) == whole[:20] @ whole.T).all()


def test_many_tiles_and_blocks(spark, monkeypatch):
    for name, value in (("TILE_ANCHORS", 3), ("TILE_ROWS", 17), ("BLOCK", 5)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = made(400, 5, 7)
    df = table(spark, rows).select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    seen = sorted(map(tuple, hard_negatives.mine(df, F.col("id") % 50 == 0).collect()))
    renamed = [(i, v, (label - 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    assert seen == plain(renamed)


def test_too_large_vectors_are_refused():
    with pytest.raises(ValueError, match="too large"):
        hard_negatives.Packing(64, -1e9, 1e9, 256)
