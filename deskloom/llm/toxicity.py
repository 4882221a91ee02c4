"""Toxicity by the nearest labelled examples.

Terms whose document frequency differs clearly between the labels (a z-test) are
the dimensions; their weights are 1 + log tf times an inverse document frequency
counted over all documents. A document's most similar examples by cosine are
found exactly with a block-max inverted index: examples stand in blocks, every
posting list knows its largest weight per block, and only blocks are scored whose
bound reaches the k-th best cosine of the blocks with the highest bounds. Votes weighted by
similarity, with a prior of one vote at the base rate, are turned into a
probability by a logistic curve in the vote and in the length of the document's
vector, that is how much evidence there is; the curve is fitted on the examples,
each scored without itself.

Cases: a text without any such term, as null and empty ones, gets the base rate of the
examples without one. Ties in similarity go to the smaller example id. Labels that
contradict each other count as toxic; labels without document or value are left
out. Without examples of both kinds every score is the rate seen, 0 without
any. Repeated rows are scored alike. Further columns are ignored. Texts are read
whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
SAMPLE = 20_000  # labelled documents the model is fitted on, about
TERMS = 20_000  # dimensions, at most
CLEAR = 5.0  # z of a term that becomes a dimension
LEAST = 3  # examples a term must be in
NEIGHBOURS = 25
BLOCK = 64  # examples of a block
FIRST = 8  # blocks scored before the others are ruled out


def terms(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Index:
    """Block-max inverted index of unit vectors."""

    dimensions: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    entries: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # where each term's entries start
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of an entry: the block
    tops: np.ndarray = field(default_factory=lambda: np.zeros(0))  # and the largest weight in it
    edges: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # and where its postings start
    posts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # examples, by term and number
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    empty: float = 0.0  # share of toxic among examples without a dimension
    base: float = 0.0  # share of toxic among the others
    curve: tuple[float, ...] = (0.0, 1.0, 0.0)

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray, float]:
        """Dimensions and unit weights of a document, and the length before."""
        at = np.array(sorted(self.dimensions[word] for word in counts), np.int64)
        tf = {self.dimensions[word]: n for word, n in counts.items()}
        weights = np.array([(1 + log(tf[i])) for i in at]) * self.idf[at]
        size = float(np.sqrt((weights**2).sum()))
        return at, weights / size, size

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray, float]]) -> None:
        size = np.array([len(at) for at, *_ in vectors], np.int64)
        term = np.concatenate([at for at, *_ in vectors]) if vectors else np.zeros(0, np.int64)
        weights = np.concatenate([own for _, own, _ in vectors]) if vectors else np.zeros(0)
        example = np.repeat(np.arange(len(vectors)), size)
        order = np.lexsort((example, term))
        term, self.posts, self.weights = term[order], example[order], weights[order]
        block = self.posts // BLOCK
        fresh = np.ones(len(term), bool)
        fresh[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(fresh)
        self.blocks, self.edges = block[first], np.append(first, len(term))
        self.tops = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.entries = np.searchsorted(term[first], np.arange(len(self.idf) + 1))

    def nearest(self, at: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest with a common term, best first.

        The blocks of the highest bounds are scored first. Their k-th cosine is
        what the bound of any other block must reach for it to be scored too.
        """
        found, close = np.zeros(0, np.int64), np.zeros(0)
        fan = self.entries[at + 1] - self.entries[at]
        entry = np.repeat(self.entries[at], fan) + spans(fan)
        if not len(entry):
            return found, close
        weight, block = np.repeat(weights, fan), self.blocks[entry]
        bounds = np.bincount(block, weight * self.tops[entry])
        high = min(len(bounds), FIRST)
        order = np.argpartition(-bounds, high - 1)
        first = np.zeros(len(bounds), bool)
        first[order[:high]] = True
        left = ~first
        for chosen in (first, left):
            own = chosen[block]
            at_, width = self.edges[entry[own]], self.edges[entry[own] + 1] - self.edges[entry[own]]
            post = np.repeat(at_, width) + spans(width)
            scores = np.bincount(self.posts[post], np.repeat(weight[own], width) * self.weights[post])
            there = np.flatnonzero(scores > 0)
            there = there[there != without]
            found = np.concatenate([found, there])
            close = np.concatenate([close, np.round(scores[there], 12)])
            best = np.lexsort((self.ids[found], -close))[:k]
            found, close = found[best], close[best]
            # The bound may come out a hair below an equal score.
            left &= bounds > (close[-1] - 1e-9 if len(close) == k else 0)
            if not left.any():
                break
        return found, close

    def vote(self, found: np.ndarray, close: np.ndarray) -> float:
        return float((close @ self.labels[found] + self.base) / (close.sum() + 1))

    def calibrated(self, raw: float, size: float) -> float:
        a, b, c = self.curve
        return 1 / (1 + exp(-max(-30.0, min(30.0, a + b * logit(raw) + c * log(size)))))


def spans(widths: np.ndarray) -> np.ndarray:
    """0..width-1 for every width, in one array."""
    return np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths)


def logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Intercept and slopes by Newton's method with a small ridge towards the vote alone."""
    prior = np.array([0.0, 1.0, 0.0])
    w = prior
    design = np.column_stack([np.ones(len(x)), x])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - y) + 0.1 * (w - prior)
        bend = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(3)
        move = np.linalg.solve(bend, slope)
        w = w - move
        if np.abs(move).max() < 1e-9:
            break
    return tuple(float(x) for x in w)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = TERMS) -> Index:
    """Index of the labelled documents: rows (id, text) and rows (id, toxic).

    Of many labelled documents about `sample` are examples, chosen by a hash of
    their id; their number bounds what is collected and broadcast. Document
    frequencies of the dimensions come from all documents.
    """
    spark = documents.sparkSession
    known = labels.filter("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    picked = F.broadcast(common.sampled(known, "id", sample))
    examples = common.stage(documents.join(picked, "id").dropDuplicates(["id"]), "toxicity-examples")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found.update((word, toxic > 0) for word in set(terms(text)))
            words = Counter(word for word, _ in found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(words), pa.string()),
                    pa.array([found[word, True] for word in words], pa.int64()),
                    pa.array([found[word, False] for word in words], pa.int64()),
                ],
                ["word", "bad", "good"],
            )

    sizes = {bool(row["toxic"]): row["n"] for row in examples.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    rate = bad / (bad + good) if bad + good else 0.0
    if not bad or not good:
        return Index({}, np.zeros(0), np.zeros(0, np.int64), np.zeros(0), empty=rate, base=rate)
    counts = examples.select("text", "toxic").mapInArrow(count, "word string, bad long, good long")
    counts = counts.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = (F.col("bad") + F.col("good")) / (bad + good)
    z = (F.col("bad") / bad - F.col("good") / good) / F.sqrt(share * (1 - share) * (1 / bad + 1 / good))
    clear = counts.filter((F.col("bad") + F.col("good") >= LEAST) & (share < 1)).withColumn("z", F.abs(z))
    chosen = clear.filter(F.col("z") >= CLEAR).orderBy(F.desc("z"), "word").limit(most).collect()
    dimensions = {word: i for i, word in enumerate(sorted(row["word"] for row in chosen))}

    ship = spark.sparkContext.broadcast(dimensions)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        n = 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column("text").to_pylist():
                found.update(ship.value.keys() & terms(text))
        yield pa.RecordBatch.from_arrays(
            [pa.array([*found, ""], pa.string()), pa.array([*found.values(), n], pa.int64())], ["word", "n"]
        )

    df = documents.select("text").mapInArrow(frequencies, "word string, n long").groupBy("word").agg(F.sum("n"))
    seen = dict(df.collect())  # one row per dimension and one for the number of documents
    total = seen.pop("", 0)
    idf = np.array([log((1 + total) / (1 + seen.get(word, 0))) + 1 for word in dimensions])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Counter(w for w in terms(text) if w in ship.value) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("toxic"),
                    pa.array([list(c) for c in made], pa.list_(pa.string())),
                    pa.array([list(c.values()) for c in made], pa.list_(pa.int64())),
                ],
                ["id", "toxic", "words", "counts"],
            )

    kind = "id long, toxic int, words array<string>, counts array<long>"
    rows = examples.select("id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(vectors, kind)
    without = rows.filter(F.size("words") == 0).agg(F.count("*"), F.sum((F.col("toxic") > 0).cast("int"))).first()
    full = rows.filter(F.size("words") > 0).collect()  # at most the sample
    # Neighbours in the index have the same rarest term, so that bounds of blocks are tight.
    rarest = {row["id"]: max(((idf[dimensions[w]], w) for w in row["words"]), default=(0, "")) for row in full}
    full.sort(key=lambda row: (rarest[row["id"]], row["id"]))
    index = Index(
        dimensions,
        idf,
        np.array([row["id"] for row in full], np.int64),
        np.array([row["toxic"] > 0 for row in full], np.float64),
        empty=((without[1] or 0) + rate) / ((without[0] or 0) + 1),
    )
    index.base = float(index.labels.mean()) if len(full) else rate
    made = [index.vector(dict(zip(row["words"], row["counts"], strict=True))) for row in full]
    index.build(made)
    if len(full):
        votes = left_out(rows.filter(F.size("words") > 0), index).collect()  # at most the sample
        seen = np.array([(row["vote"], row["size"], row["toxic"]) for row in votes])
        index.curve = logistic(np.stack([[logit(p) for p in seen[:, 0]], np.log(seen[:, 1])], 1), seen[:, 2])
    return index


def left_out(examples: DataFrame, index: Index) -> DataFrame:
    """(vote, size, toxic): the vote on every example without itself, scored in tasks."""
    ship = examples.sparkSession.sparkContext.broadcast(index)
    tasks = examples.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ship.value
        number = {key: i for i, key in enumerate(own.ids.tolist())}
        for batch in batches:
            made = []
            columns = [batch.column(name).to_pylist() for name in ("id", "words", "counts")]
            for key, words, counts in zip(*columns, strict=True):
                at, weights, size = own.vector(dict(zip(words, counts, strict=True)))
                made.append((own.vote(*own.nearest(at, weights, NEIGHBOURS, without=number[key])), size))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([vote for vote, _ in made], pa.float64()),
                    pa.array([size for _, size in made], pa.float64()),
                    batch.column("toxic").cast(pa.bool_()),
                ],
                ["vote", "size", "toxic"],
            )

    spread = examples.select("id", "toxic", "words", "counts").repartition(tasks, "id")
    return spread.mapInArrow(run, "vote double, size double, toxic boolean")


def score(documents: DataFrame, index: Index, k: int = NEIGHBOURS) -> DataFrame:
    """(id, score, evidence) of every row (id, text); evidence are the nearest examples."""
    ship = documents.sparkSession.sparkContext.broadcast(index)
    near = pa.struct([("id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ship.value
        known: dict = {}
        for batch in batches:
            if len(known) > 100_000:
                known.clear()
            scores, evidence = [], []
            for text in batch.column("text").to_pylist():
                counts = Counter(filter(own.dimensions.__contains__, terms(text)))
                key = tuple(sorted(counts.items()))
                if key not in known:
                    if counts:
                        at, weights, size = own.vector(counts)
                        found, close = own.nearest(at, weights, k)
                        shown = [
                            {"id": int(own.ids[i]), "similarity": float(c), "toxic": bool(own.labels[i])}
                            for i, c in zip(found[:3], close[:3], strict=True)
                        ]
                        known[key] = own.calibrated(own.vote(found, close), size), shown
                    else:
                        known[key] = own.empty, []
                scores.append(known[key][0])
                evidence.append(known[key][1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(near))],
                ["id", "score", "evidence"],
            )

    kind = "id long, score double, evidence array<struct<id: long, similarity: double, toxic: boolean>>"
    return documents.select("id", "text").mapInArrow(run, kind)
