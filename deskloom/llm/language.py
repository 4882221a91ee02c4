"""Language identification of mixed text.

Script ranges say which languages a word may belong to. A word's score for a
language comes from the counts of the word, or for unknown words from its
letter trigrams. Viterbi with a switching penalty then finds the best
labelling of the words of a document, whose runs are the spans.

Cases: a null or empty text, or one without a letter, has no span and the
language `und` with score 0. Text in scripts that no learned language is written in gets
the most frequent language, with its share of the examples as score. Ties go to
the language that sorts first. Repeated rows are predicted alike. With no
labelled row every text is `und`. Further input columns are ignored. Texts of
any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
SAMPLE = 20_000  # labelled documents the model is fitted on, at most
VOCABULARY = 40_000  # words kept per language
LANGUAGES = 200  # languages a model may have
SWITCH = 6.0  # cost of changing the language, in nats
FLOOR = -9.0  # lowest score of a word for a language
CACHE = 400_000  # words a worker remembers between parts of batches
SPAN = pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])

# First and last code point of the letters of a script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "indic": [(0x900, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "ethiopic": [(0x1200, 0x139F)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x323AF)],
}


def script(word: str) -> str:
    """Script of the first letter that has one."""
    for letter in word:
        point = ord(letter)
        for name, ranges in SCRIPTS.items():
            if any(first <= point <= last for first, last in ranges):
                return name
    return "other"


def trigrams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


@dataclass
class Model:
    """Per language: counts of words and trigrams, and the scripts it is written in."""

    languages: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]
    unseen: np.ndarray
    allowed: dict[str, np.ndarray]
    prior: np.ndarray  # share of the languages among the words of the examples

    def score(self, word: str) -> np.ndarray:
        """Log share of each language for the word; zeros if its script is nobody's."""
        mask = self.allowed.get(script(word))
        if mask is None:
            return np.zeros(len(self.languages), np.float32)
        known = self.words.get(word)
        if known is None:
            known = sum((self.grams.get(gram, self.unseen) for gram in trigrams(word)), np.zeros(len(self.languages)))
        known = np.where(mask, known, -np.inf)
        known = known - known.max()
        return np.maximum(known - log(np.exp(known).sum()), FLOOR).astype(np.float32)


def fit(documents: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> Model:
    """Model of the rows (id, text, lang) with a language.

    Counts come from about `sample` documents and the `vocabulary` most frequent
    words of each language, so the model's size is bounded.
    """
    labelled = documents.filter(F.col("lang").isNotNull() & (F.col("lang") != ""))
    picked = common.sampled(labelled, "id", sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in common.parts(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                found.update((lang, word) for word in WORD.findall(text.lower()))
            yield counted(found)
            found.clear()

    def counted(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang for lang, _ in found], pa.string()),
                pa.array([word for _, word in found], pa.string()),
                pa.array(list(found.values()), pa.int64()),
            ],
            ["lang", "word", "n"],
        )

    counts = (
        picked.select("text", "lang")
        .mapInArrow(count, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    counts = common.stage(counts, "language-words")
    names = common.small(counts.select("lang").distinct(), LANGUAGES)
    if names is None:
        raise ValueError(f"more than {LANGUAGES} languages")
    per: dict[str, dict[str, int]] = {}
    for (lang,) in sorted(names):
        top = counts.filter(F.col("lang") == lang).orderBy(F.desc("n"), "word").limit(vocabulary)
        per[lang] = {row["word"]: row["n"] for row in top.collect()}
    return model(per)


def model(counts: dict[str, dict[str, int]]) -> Model:
    """Smoothed log frequencies from word counts per language."""
    names = sorted(counts)
    totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(names)))
    grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(names)))
    written: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(names)))
    for i, name in enumerate(names):
        for word, n in counts[name].items():
            totals[word][i] += n
            written[script(word)][i] += n
            for gram in trigrams(word):
                grams[gram][i] += n
    size = sum(totals.values(), np.zeros(len(names)))
    gram_size = sum(grams.values(), np.zeros(len(names)))
    smooth = 0.5
    base = np.log(size + smooth * (len(totals) + 1))
    gram_base = np.log(gram_size + smooth * (len(grams) + 1))
    return Model(
        names,
        {word: np.log(n + smooth) - base for word, n in totals.items() if n.sum() >= 3},
        {gram: np.log(n + smooth) - gram_base for gram, n in grams.items()},
        np.log(smooth) - gram_base,
        {name: n >= 0.01 * size for name, n in written.items() if (n >= 0.01 * size).any()},
        size / max(size.sum(), 1),
    )


class Scored(dict):
    """Number of each word met; scores, letters that count, and whether it has any, by number."""

    def __init__(self, fitted: Model):
        super().__init__()
        self.fitted = fitted
        self.scores = np.zeros((1024, len(fitted.languages)), np.float32)
        self.letters = np.zeros(1024, np.int64)
        self.spoken = np.zeros(1024, bool)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.letters):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            self.spoken = np.concatenate([self.spoken, np.zeros_like(self.spoken)])
        self.scores[n] = self.fitted.score(word)
        self.spoken[n] = any(map(str.isalpha, word))
        self.letters[n] = len(word) if self.spoken[n] and script(word) in self.fitted.allowed else 0
        self[word] = n
        return n


def viterbi(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, scores: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word of several documents, all advanced together.

    Document d has the words `words[starts[d] : starts[d] + sizes[d]]`; rows of
    `scores` belong to word numbers. Documents must come longest first.
    """
    n, width = len(words), scores.shape[1]
    labels = np.zeros(n, np.int16)
    if not n:
        return labels
    longest = int(sizes[0])
    alive = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    stay = np.zeros((n, width), bool)
    best = np.zeros(n, np.int16)
    value = scores[words[starts[: alive[0]]]].astype(np.float64)
    last = np.zeros(len(starts), np.int16)
    for step in range(1, longest + 1):
        at = alive[step] if step < longest else 0
        last[at : len(value)] = value[at:].argmax(1)
        if not at:
            break
        value = value[:at]
        place = starts[:at] + step
        top = value.argmax(1)
        jump = value[np.arange(at), top] - switch
        kept = value >= jump[:, None]
        stay[place] = kept
        best[place] = top
        value = np.where(kept, value, jump[:, None]) + scores[words[place]]
        value -= value.max(1, keepdims=True)
    for step in range(longest - 1, -1, -1):
        at = alive[step]
        place = starts[:at] + step
        now = last[:at]
        labels[place] = now
        last[:at] = np.where(stay[place, now], now, best[place])
    return labels


def labelled(batches: Iterator[pa.RecordBatch], fitted: Model, switch: float, spans: bool) -> Iterator[pa.RecordBatch]:
    """What predict returns, for batches of (id, text).

    The arrays of a part are many times the size of its texts, so a batch is cut.
    """
    known = Scored(fitted)
    for batch in common.parts(batches):
        if len(known) > CACHE:
            known = Scored(fitted)
        lookup = known.__getitem__
        found = [
            np.fromiter(map(lookup, WORD.findall(text.lower())), np.int32) for text in batch.column("text").to_pylist()
        ] if fitted.languages else [np.zeros(0, np.int32) for _ in range(batch.num_rows)]
        sizes = np.array([len(words) for words in found], np.int64)
        order = np.argsort(-sizes, kind="stable")
        starts = np.concatenate([[0], np.cumsum(sizes[order])[:-1]]).astype(np.int64)
        words = np.concatenate([found[i] for i in order])
        labels = viterbi(words, starts, sizes[order], known.scores, switch)
        letters, spoken = known.letters[words], known.spoken[words]
        out = [None] * len(order)
        for place, i in enumerate(order):
            own = slice(int(starts[place]), int(starts[place] + sizes[i]))
            out[i] = summary(labels[own], letters[own], spoken[own], fitted, spans)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array([x[0] for x in out], pa.string()),
                pa.array([x[1] for x in out], pa.float64()),
                pa.array([x[2] for x in out], pa.int32()),
                pa.array([x[3] for x in out], pa.list_(SPAN)),
            ],
            ["id", "lang_pred", "score", "n_spans", "spans"],
        )


def predict(documents: DataFrame, fitted: Model, switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """(id, lang_pred, score, n_spans, spans) for every row (id, text).

    The language is the one with most letters in its spans, the score its share
    of all letters. A span is (first word, number of words, language).
    """
    ship = documents.sparkSession.sparkContext.broadcast(fitted)
    return documents.select("id", "text").mapInArrow(
        lambda batches: labelled(batches, ship.value, switch, spans),
        "id long, lang_pred string, score double, n_spans int, spans array<struct<first: int, words: int, lang: string>>",
    )


def summary(own: np.ndarray, letters: np.ndarray, spoken: np.ndarray, fitted: Model, spans: bool) -> tuple:
    """Language, score, number of spans and spans of one document."""
    if not spoken.any():
        return "und", 0.0, 0, []
    names = fitted.languages
    total = np.bincount(own, weights=letters, minlength=len(names))
    if not total.any():
        total = fitted.prior
    top = int(total.argmax())
    edges = np.flatnonzero(np.diff(own)) + 1
    runs = []
    if spans:
        first = np.concatenate([[0], edges])
        width = np.diff(np.concatenate([first, [len(own)]]))
        runs = [{"first": int(a), "words": int(b), "lang": names[own[a]]} for a, b in zip(first, width, strict=True)]
    return names[top], float(total[top] / total.sum()), len(edges) + 1, runs
