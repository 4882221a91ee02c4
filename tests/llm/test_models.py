"""Language, toxicity and licence models: known answers, held-out accuracy, brute force."""

import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from deskloom.llm import common, language, licenses, toxicity

from .conftest import prose

SPEECH = {
    "en": "the people of this town were walking along the river with their children and talking about what they had seen",
    "de": "die leute dieser stadt gingen mit ihren kindern am fluss entlang und sprachen ueber das was sie gesehen hatten",
    "ru": "жители этого города гуляли вдоль реки со своими детьми и говорили о том что они видели",
}


def spoken(lang, seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(SPEECH[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def fitted():
    counts = {lang: {word: 9 for word in text.split()} for lang, text in SPEECH.items()}
    return language.model(counts)


def labels_of(fitted, words, switch=language.SWITCH):
    known = language.Scored(fitted)
    numbers = np.array([known[word] for word in words], np.int32)
    return language.viterbi(numbers, np.zeros(1, np.int64), np.array([len(words)]), known.scores, switch), known, numbers


def test_viterbi_is_the_best_of_all_labellings(fitted):
    words = "the leute река stadt were sie xyz".split()
    found, known, numbers = labels_of(fitted, words, 1.5)

    def value(labels):
        own = sum(known.scores[n][label] for n, label in zip(numbers, labels, strict=True))
        return own - 1.5 * sum(a != b for a, b in zip(labels, labels[1:], strict=False))

    every = np.array(np.meshgrid(*[range(3)] * len(words))).reshape(len(words), -1).T
    assert value(found) == pytest.approx(max(value(row) for row in every), abs=1e-4)


def test_documents_advance_together_as_alone(fitted):
    known = language.Scored(fitted)
    texts = [spoken(lang, i, 5 + 13 * i).split() for i, lang in enumerate(["ru", "en", "de", "en"])][::-1]
    numbers = [np.array([known[w] for w in words], np.int32) for words in texts]
    sizes = np.array([len(n) for n in numbers])
    starts = np.cumsum(sizes) - sizes
    together = language.viterbi(np.concatenate(numbers), starts, sizes, known.scores, 2.0)
    for n, start, size in zip(numbers, starts, sizes, strict=True):
        alone = language.viterbi(n, np.zeros(1, np.int64), np.array([size]), known.scores, 2.0)
        assert together[start : start + size].tolist() == alone.tolist()


def test_batches_are_labelled_in_parts_of_bounded_text(fitted, monkeypatch):
    texts = [spoken(lang, i, n) for i, (lang, n) in enumerate([("en", 30), ("ru", 90), ("de", 5), ("en", 400), ("de", 40)])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([*texts, "", "12 _"])], ["id", "text"])
    [whole] = language.labelled([batch], fitted, language.SWITCH, True)
    met, plain = [], language.viterbi
    monkeypatch.setattr(common.parts, "__defaults__", (1000,))
    monkeypatch.setattr(language, "viterbi", lambda words, *rest: met.append(len(words)) or plain(words, *rest))
    found = list(language.labelled([batch.slice(0, 0), batch], fitted, language.SWITCH, True))
    assert pa.Table.from_batches(found).to_pylist() == whole.to_pylist()
    assert sum(met) == sum(len(text.split()) for text in texts)
    sizes = [len(text.encode()) for text in batch.column("text").to_pylist()]
    for part in found:
        own = sizes[part.column("id")[0].as_py() :][: part.num_rows]
        assert len(own) == 1 or sum(own) <= 1000


def test_spans_of_mixed_text(spark, fitted, docs):
    mixed = f"{spoken('en', 1, 30)} {spoken('ru', 2, 50)} {spoken('de', 3, 20)}"
    row = language.predict(common.rows(docs([mixed])), fitted).first()
    assert [(s["first"], s["words"], s["lang"]) for s in row["spans"]] == [(0, 30, "en"), (30, 50, "ru"), (80, 20, "de")]
    assert row["lang_pred"] == "ru" and 0 < row["score"] < 1 and row["n_spans"] == 3


def test_texts_without_letters_or_in_other_scripts(spark, fitted, docs):
    rows = language.predict(common.rows(docs(["² ½ 12 _", "日本語 です", "² the"])), fitted).collect()
    assert [row["lang_pred"] for row in rows] == ["und", "de", "en"]
    assert rows[0]["score"] == 0 and rows[1]["score"] == pytest.approx(max(fitted.prior)) and rows[2]["score"] == 1


def test_scripts_narrow_candidates(fitted):
    assert fitted.languages == ["de", "en", "ru"]
    assert fitted.score("новое").argmax() == 2 and fitted.score("новое")[0] == language.FLOOR
    assert fitted.score("日本").tolist() == [0, 0, 0]
    assert language.script("ß") == "latin" and language.script("ア") == "kana"


def test_language_query_learns_only_from_its_part(spark, query):
    rows = []
    for i in range(120):
        lang = list(SPEECH)[i % 3]
        held = crc32(str(i).encode()) % 3 == 1
        rows.append((i, spoken(lang, i, 30), "wrong" if held else lang, "s"))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = query("op3_language", documents=table)
    for row in found:
        assert row["held_out"] == (crc32(str(row["doc_id"]).encode()) % 3 == 1)
        assert row["lang_pred"] == list(SPEECH)[row["doc_id"] % 3] and 0 <= row["score"] <= 1


def index_of(seed, n):
    pick = np.random.default_rng(seed)
    names = [f"t{i}" for i in range(40)]
    index = toxicity.Index({name: i for i, name in enumerate(names)}, pick.uniform(1, 5, 40), np.arange(n), pick.integers(0, 2, n) * 1.0)
    counts = [{names[t]: int(pick.integers(1, 5)) for t in pick.choice(40, pick.integers(1, 9), replace=False)} for _ in range(n)]
    counts[5], counts[6] = counts[4], counts[4]  # ties
    vectors = [index.vector(c) for c in counts]
    index.build(vectors)
    full = np.zeros((n, 40))
    for row, (at, weights, _) in zip(full, vectors, strict=True):
        row[at] = weights
    return index, vectors, full


@pytest.mark.parametrize("n", [8, 500])
def test_nearest_examples_are_exact(n):
    index, vectors, full = index_of(n, n)
    for i in range(0, n, 3):
        at, weights, _ = vectors[i]
        cosines = np.round(full @ full[i], 12)
        want = [j for j in np.lexsort((index.ids, -cosines)) if cosines[j] > 0 and j != i][:7]
        found, close = index.nearest(at, weights, 7, without=i)
        assert found.tolist() == want
        assert close == pytest.approx(cosines[want])


def test_toxic_words_are_learned(spark, docs, query):
    bad = ["gruk", "vrelm", "spoit"]
    texts = [prose(i, 40) + (f" {bad[i % 3]} {bad[(i + 1) % 3].upper()}!" if i % 4 == 0 else "") for i in range(300)]
    labels = spark.createDataFrame(
        [(i, 1, int(i % 4 == 0)) for i in range(250)] + [(3, 0, 0), (999, 1, 1), (7, 1, None)],
        "doc_id long, quality int, toxic int",
    )
    found = query("op7_toxicity", documents=docs(texts), labels=labels)
    assert all(row["predicted"] == (row["doc_id"] % 4 == 0) for row in found)
    assert all(row["held_out"] == (crc32(str(row["doc_id"]).encode()) % 5 == 0) for row in found)
    assert all(not row["evidence"] or row["evidence"][0]["toxic"] == (row["doc_id"] % 4 == 0) for row in found)


def test_labels_of_the_held_out_part_are_not_seen(spark, docs, query):
    held = [i for i in range(200) if crc32(str(i).encode()) % 5 == 0]
    texts = [prose(i, 20) + (" gruk" if i in held else "") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i in held)) for i in range(200)], "doc_id long, quality int, toxic int")
    assert {row["score"] for row in query("op7_toxicity", documents=docs(texts), labels=labels)} == {0.0}


@pytest.fixture(scope="module")
def licensed(spark):
    inline = f"{prose(1, 70)} Licensed under the Apache License, Version 2.0. {prose(2, 70)}"
    texts = [
        f"{prose(3, 50)}\nReleased under the MIT License.\n{prose(4, 20)}",
        inline,
        "You may redistribute this under the terms of the GNU General Public License, version 3, or any later version.",
        prose(5, 500),
        "She renewed her driving licence and the general public cheered version 3.",
        "Licensed under CC BY-NC 4.0.\n\nThis work is licensed under the GNU General Public License, version 3.",
        "",
    ] + [prose(100 + i, 120) for i in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    model = licenses.fit(table)
    return model, licenses.scan(table, model).filter("confirmed").collect()


def test_licence_families(licensed):
    found = {}
    for row in licensed[1]:
        found.setdefault(row["id"], set()).add(row["family"])
    assert found == {0: {"mit"}, 1: {"apache"}, 2: {"gpl"}, 5: {"cc-by-nc", "gpl"}}


def test_licence_paragraph_and_calibration(licensed):
    model, rows = licensed
    assert {row["paragraph"] for row in rows if row["id"] == 0} == {1}
    assert 0.5 <= model.least <= 0.95 and all(row["probability"] >= model.least for row in rows)


def test_licence_scan_has_no_python(spark, licensed):
    plan = licenses.scan(spark.range(1).selectExpr("id", "'a' AS text"), licensed[0])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_windows_cover_every_word(spark):
    words = [f"w{i}" for i in range(100)]
    table = spark.createDataFrame([(1, " ".join(words) + "\n\n!!\nlast"), (2, None)], "id long, text string")
    rows = licenses.windows(common.rows(table, "id")).collect()
    seen = {row["first"] + i for row in rows if row["paragraph"] == 0 for i in range(len(row["words"]))}
    assert seen == set(range(100)) and {row["paragraph"] for row in rows} == {0, 3}
    assert all(len(row["words"]) <= licenses.WINDOW for row in rows)


def test_licences_learn_from_every_window(spark):
    """No sample: all windows are counted, and ones that come once in many decide."""
    texts = [prose(i, 40) for i in range(150)] + ["The city issues software license number 2 to any person."] * 50
    table = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = licenses.counted(licenses.read(table)).collect()
    assert sum(row["n"] for row in found) == licenses.windows(table).count() == 350
    words = {tuple(row["grams"]) for row in found}
    assert () in words and any("license" in grams for grams in words)


def test_licence_threshold_sees_all_windows(spark):
    rows = spark.createDataFrame([(0.1, 9_980), (0.7, 11), (0.8, 9)], "probability double, n long")
    assert licenses.least_probability(rows) == 0.7
    assert licenses.least_probability(rows.filter("n < 0")) == 0.5
    assert licenses.least_probability(rows.filter("n = 9")) == 0.8
