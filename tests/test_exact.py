"""Sums, places and best domains that don't depend on how rows are dealt out."""

import math
import random
import struct
import tracemalloc
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deskloom import kernels
from deskloom.functions import exact
from deskloom.operators import metrics, order, quality

PARTS = [1, 7, 211]


def bits(row):
    return [struct.pack("<d", x) if isinstance(x, float) else x for x in row]


def values(seed=1):
    pick = random.Random(seed)
    tiny = [pick.random() * 10.0 ** pick.randrange(-15, 12) * pick.choice([-1, 1]) for _ in range(2000)]
    return [*tiny, 0.1, 0.2, 0.3, -0.6, 1e15, -1e15, 2.0**-60, 0.0, -0.0]


@pytest.mark.parametrize("parts", PARTS)
def test_total_is_the_nearest_double(spark, parts):
    for seed in (1, 2):
        numbers = values(seed)
        df = spark.createDataFrame([(x,) for x in numbers], "x double").repartition(parts)
        got = df.agg(exact.total("x").alias("total"), exact.mean("x").alias("mean")).first()
        true = float(sum(map(Fraction, numbers)))
        assert math.isclose(got["total"], true, rel_tol=2**-52)
        assert got["mean"] == got["total"] / len(numbers)


def test_total_cancels_to_the_last_bit(spark):
    for numbers in ([1e16, 1.0, -1e16], [-0.5], [0.1] * 10, [2.0**40, 2.0**-50, -(2.0**40)], [-1.5, 1.25], [2.0**30 - 0.5, -(2.0**30)]):
        got = spark.createDataFrame([(x,) for x in numbers], "x double").agg(exact.total("x")).first()[0]
        assert got == math.fsum(numbers), numbers


def test_total_of_none_is_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert df.agg(exact.total("x"), exact.mean("x")).first() == (None, None)
    mixed = spark.createDataFrame([(None,), (2.0,)], "x double")
    assert mixed.agg(exact.total("x"), exact.mean("x")).first() == (2.0, 2.0)


def test_figures_have_the_same_bits_in_any_parts(spark):
    pick = random.Random(3)
    rows = [(pick.choice([0.85, 0.7, 1 / 3, 0.0, 1.0, pick.random()]), pick.random() < 0.7) for _ in range(5000)]
    seen = set()
    for parts in PARTS:
        df = spark.createDataFrame(rows, "confidence double, correct boolean").repartition(parts)
        found = [*map(tuple, metrics.brier(df).collect()), *sorted(map(tuple, metrics.calibration(df).collect()))]
        seen.add(repr([bits(row) for row in found]))
    assert len(seen) == 1
    n, brier, spread, flat = metrics.brier(df).first()
    confidence = np.array([c for c, _ in rows])
    assert n == 5000 and not flat
    assert brier == pytest.approx(np.mean([(c - ok) ** 2 for c, ok in rows]), rel=1e-12)
    assert spread == pytest.approx(confidence.std(), rel=1e-12)


def test_flat_confidence_has_no_spread(spark):
    df = spark.createDataFrame([(0.1, True)] * 1000, "confidence double, correct boolean")
    assert tuple(metrics.brier(df).first())[2:] == (0.0, True)


@pytest.mark.parametrize("parts", PARTS)
def test_places_follow_the_order(spark, parts):
    pick = random.Random(4)
    rows = [(pick.randrange(50), i, "t" * pick.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, text string").repartition(parts)
    got = order.placed(df, F.desc("a"), "b").collect()
    wanted = {row: n for n, row in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    assert {(r.a, r.b, r.text): r.place for r in got} == wanted


def test_places_need_no_single_task(spark):
    """Only the sizes of the parts meet in one task."""
    df = spark.range(1000).withColumn("text", F.lit("x"))
    plan = order.placed(df, "id")._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "text" not in window.split("FileScan")[0]


def test_places_of_no_rows(spark):
    assert order.placed(spark.range(0), "id").collect() == []


def test_many_domains_in_bounded_memory(spark):
    """20,000 domains for a batch of documents: rows x domains would be 320 MB."""
    domains, rows, words = 20_000, 2_000, 400
    pick = np.random.default_rng(5)
    gains = np.where(pick.random((words, domains)) < 0.05, 1.0, 0.0)
    base = np.log(pick.integers(1000, 1100, domains).astype(float))
    terms = pa.array([f"w{i}" for i in range(words)])
    texts = [[{"term": f"w{w}", "tf": int(n)} for w, n in zip(pick.choice(words, 5, False), pick.integers(1, 4, 5))] for _ in range(rows)]  # noqa: B905
    tails = [[{"place": int(p), "gain": 2.0} for p in pick.choice(domains, 2, False)] if i % 3 else None for i in range(rows)]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(range(rows)),
            pa.array(["d"] * rows),
            pa.array(texts, pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))),
            pa.array(tails, pa.list_(pa.struct([("place", pa.int64()), ("gain", pa.float64())]))),
        ],
        ["doc_id", "domain", "words", "tail"],
    )
    tracemalloc.start()
    found = next(kernels.best_domain([batch], base, (terms, gains))).column("_best").to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    for i in range(0, rows, 97):
        score = -base * sum(w["tf"] for w in texts[i])
        for word in texts[i]:
            score += word["tf"] * gains[int(word["term"][1:])]
        for row in tails[i] or []:
            score[row["place"]] += row["gain"]
        assert found[i] == np.round(score, 6).argmax()


def test_many_domains_from_end_to_end(spark, monkeypatch):
    """Each document has the wording of the next domain, so all are misfiled; few gains are sent."""
    monkeypatch.setattr(quality, "SENT_GAINS", 5_000)
    n = 3_000
    rows = [(i, f"d{i:05}", " ".join([f"own{(i + 1) % n:05}"] * 3 + ["common"] * (i % 3))) for i in range(n)]
    rows += [(n + i, f"d{i:05}", " ".join([f"own{i:05}"] * 9)) for i in range(n)]
    found = quality.misfiled(spark.createDataFrame(rows, "doc_id long, domain string, content string"))
    told = {r.doc_id: (r.best_domain, r.misfiled) for r in found.collect()}
    assert all(told[i] == (f"d{(i + 1) % n:05}", True) for i in range(n))
    assert all(told[n + i] == (f"d{i:05}", False) for i in range(n))
