"""Searches over blocks against full scans, refreshed indexes against new ones, learned languages."""

import random
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deskloom import kernels
from deskloom.operators import blocks, clusters, dense, lexical, metrics, postings, quality
from deskloom.plans import index as ix

TOPICS = {
    "bank": "refund card payment loan credit debit account balance branch teller".split(),
    "code": "compile loop python variable function class module import debug test".split(),
    "home": "kitchen garden window door carpet lamp table chair sofa shelf".split(),
}


def texts(count, seed=1):
    pick = random.Random(seed)
    for i in range(count):
        domain = pick.choice([*TOPICS, "bank"])
        words = TOPICS[domain][: pick.randrange(3, 11)]
        yield i, f"p/{i}", domain, " ".join([*pick.choices(words, k=pick.randrange(4, 40)), *pick.choices(["help", "please", "now", f"rare{i}"], k=4)])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*row, row[3]) for row in texts(900)] + [(900, "p/900", None, "refund card", "x"), (901, "p/901", "bank", "", "")]
    return spark.createDataFrame(rows, "doc_id int, doc_path string, domain string, content string, content_hash string")


@pytest.fixture(scope="module")
def queries(spark):
    pick = random.Random(2)
    rows = [(f"q{i}", " ".join(pick.choices(sum(TOPICS.values(), []), k=3) + [f"rare{i}"]), pick.choice([None, None, "code"])) for i in range(40)]
    return spark.createDataFrame([*rows, ("none", "unknown words", None)], "query_id string, query string, domain_filter string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def saved(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_DOCS", 16)
    ix.save(ix.build(docs), str(tmp_path / "index"))
    return ix.load(spark, str(tmp_path / "index")).lexical


@pytest.mark.parametrize("drop_zero", [False, True])
@pytest.mark.parametrize("block_rows", [blocks.BLOCK_QUERIES, 7])
def test_blocks_find_what_a_scan_finds(docs, queries, saved, drop_zero, block_rows):
    scan = lexical.top_documents(queries, lexical.build_index(docs), 5, drop_zero)
    assert rows_of(lexical.top_documents(queries, saved, 5, drop_zero, block_rows=block_rows)) == rows_of(scan)


def test_blocks_hold_each_vector_once(docs, saved):
    flat = saved.blocks.select("domain", F.explode("docs").alias("doc_id"))
    assert rows_of(flat) == rows_of(docs.where("content != ''").select("domain", "doc_id"))
    heads = saved.blocks.select(F.size("docs").alias("n"), F.size("slots") == F.size("most"), F.size("slots") == F.size("ends"))
    assert all(n <= 16 and a and b for n, a, b in heads.collect())


def test_a_search_scores_some_blocks_only(queries, saved):
    """Pairs of a query and a block that are scored, and blocks that are read at all."""
    asked = queries.select("query_id", "query", F.coalesce("domain_filter", F.lit("")).alias("domain_filter"))
    for wanted, share in ((asked, 0.9), (asked.where("domain_filter = 'code'"), 0.9)):
        block = lexical.query_weights(wanted, saved.vocab, "domain_filter").where(F.size("postings") > 0).toArrow()
        packed = lexical.pack_queries(block)
        read = postings.reading(lambda packed=packed: packed, packed, saved.blocks, 3).first()
        assert 0 < read["pairs_read"] < share * read["pairs"]
    total = saved.blocks.count()
    assert read["blocks"] < total, "blocks of other domains are not read"


def vectors(spark, count=1500, size=8, seed=3):
    pick = np.random.default_rng(seed)
    middle = pick.normal(size=(12, size))
    rows = [(i, str(i % 4), (middle[i % 12] + pick.normal(0, 0.15, size)).tolist()) for i in range(count)]
    rows += [(count, "0", [0.0] * size), (count + 1, "1", [1.0]), (count + 2, None, middle[0].tolist()), (count + 3, "2", None)]
    rows += [(count + 4 + i, "3", middle[1].tolist()) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id int, domain string, embedding array<double>")


def vector_queries(spark, count=30, size=8):
    pick = np.random.default_rng(4)
    rows = [(i, [None, "1", "9"][i % 3], pick.normal(size=size).tolist()) for i in range(count)]
    return spark.createDataFrame([*rows, (99, None, [1.0])], "query_id int, domain_filter string, embedding array<double>")


@pytest.mark.parametrize("prefilter", [False, True])
def test_clusters_find_what_a_scan_finds(spark, prefilter):
    table, asked = vectors(spark), vector_queries(spark)
    made = clusters.clustered(table, 8, 20).persist()
    for n in (1, 24, 2000):
        scan = dense.top_documents(asked, table, n, prefilter)
        assert rows_of(dense.top_documents(asked, made, n, prefilter)) == rows_of(scan)
    few = dense.top_documents(asked, made, 5, prefilter, block_rows=4)
    assert rows_of(few) == rows_of(dense.top_documents(asked, table, 5, prefilter))
    made.unpersist()


def test_clusters_are_skipped(spark):
    table, asked = vectors(spark), vector_queries(spark)
    block = asked.where("query_id < 90").select("query_id", F.coalesce("domain_filter", F.lit("")).alias("domain_filter"), "embedding").toArrow()
    packed = (block.column("query_id").combine_chunks(), kernels.matrix(block.column("embedding").combine_chunks(), 8), *blocks.domain_filters(block))
    read = clusters.reading(lambda: packed, clusters.clustered(table, 8, 20), 5).first()
    assert read["pairs_read"] < 0.5 * read["pairs"]


def test_bounds_hold():
    pick = np.random.default_rng(5)
    for spread in (1e-9, 1e-4, 0.1, 1.0):
        rows = pick.normal(size=(50, 6)) * spread + pick.normal(size=6)
        unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        centre = unit.sum(axis=0) / np.linalg.norm(unit.sum(axis=0))
        asked = np.concatenate([pick.normal(size=(200, 6)), rows])
        asked /= np.linalg.norm(asked, axis=1, keepdims=True)
        bound = clusters.bounds(asked, centre[None], np.array([(unit @ centre).min()]))[0]
        assert ((asked @ unit.T).max(axis=1) <= bound + clusters.SLACK).all()


def test_clusters_of_nothing(spark):
    empty = vectors(spark).limit(0)
    assert dense.top_documents(vector_queries(spark), clusters.clustered(empty, 0), 5).count() == 0


def test_refresh_counts_changed_texts_only(spark, docs, tmp_path):
    ix.save(ix.build(docs), str(tmp_path / "v1"))
    # Some go, some change, some come, one moves to another domain; texts of the others aren't there.
    new = docs.where("doc_id % 10 != 3").withColumn("new", F.col("doc_id") % 7 == 0)
    new = new.withColumn("content", F.when(F.col("new"), F.concat("content", F.lit(" brandnew refund"))).otherwise(F.col("content")))
    new = new.withColumn("domain", F.when(F.col("doc_id") == 5, "code").otherwise(F.col("domain")))
    new = new.unionByName(spark.createDataFrame([(2000, "p/2000", "home", "sofa lamp", "h", True)], new.schema))
    new = new.withColumn("content_hash", F.md5("content")).where("doc_id != 900")
    old = docs.withColumn("content_hash", F.md5("content"))
    ix.save(ix.build(old), str(tmp_path / "v2"))
    changed = F.col("new") | (F.col("doc_id") == 5)
    bare = new.withColumn("content", F.when(changed, F.col("content"))).drop("new")
    got = ix.refresh(spark, str(tmp_path / "v2"), str(tmp_path / "v3"), bare).lexical
    wanted = lexical.build_index(new)

    def shown(index):
        weights = lexical.term_weights(index.weights, index.vocab, "doc_id", "domain")
        return rows_of(weights.select("doc_id", "domain", "term", "tf", F.round("weight", 9)))

    assert shown(got) == shown(wanted)
    assert rows_of(got.statistics) == rows_of(wanted.statistics)
    assert rows_of(got.vocab.drop("slot")) == rows_of(wanted.vocab.drop("slot"))


def test_a_saved_index_takes_the_staged_tables(spark, docs, queries, tmp_path):
    wanted = rows_of(lexical.top_documents(queries, lexical.build_index(docs), 5))
    made = ix.build(docs)
    staged = [Path(table.staged_in.removeprefix("file:")) for table in (made.lexical.counts, made.lexical.statistics)]
    ix.save(made, str(tmp_path / "index"), take=True)
    assert not any(path.exists() for path in staged)
    found = ix.load(spark, str(tmp_path / "index"))
    assert rows_of(lexical.top_documents(queries, found.lexical, 5)) == wanted
    assert rows_of(found.lexical.statistics) == rows_of(lexical.build_index(docs).statistics)
    # A table that wasn't staged is written, and stays where it was.
    ix.save(found, str(tmp_path / "again"), take=True)
    assert rows_of(found.lexical.counts) == rows_of(ix.load(spark, str(tmp_path / "again")).lexical.counts)


def test_words_and_pairs_of_lists():
    lists = pa.array([["the", "red", "card", "the", "red", "card"], [], None, ["red"], ["a", "the"]])
    found = kernels.word_terms(lists, pa.array(["the"])).to_pylist()
    plain = [{t["term"]: t["tf"] for t in row} for row in found]
    assert plain == [{"red": 2, "card": 2, "red card": 2, "card red": 1}, {}, {}, {"red": 1}, {"a": 1}]
    assert kernels.word_terms(pa.array([], pa.list_(pa.string())), pa.array(["the"])).to_pylist() == []


def test_grams_of_words():
    found = kernels.word_grams(pa.array([["abc", "abc", "é"], None, ["ab"]]), 3).to_pylist()
    plain = [{g["gram"]: g["tf"] for g in row} for row in found]
    assert plain == [{"_ab": 2, "abc": 2, "bc_": 2, "_é_": 1}, {}, {"_ab": 1, "ab_": 1}]


def test_languages_are_learned_from_labels(spark):
    pick = random.Random(6)
    words = {"xx": ["zorp", "zarp", "quzzle", "zizz"], "yy": ["mlemo", "amelo", "lommela", "emlo"], "zz": ["krati", "katri", "tikra"]}
    rows = [(i, name, " ".join(pick.choices(words[name], k=12))) for i, name in enumerate(["xx", "yy", "zz"] * 40)]
    rows += [(500, None, "mlemo mlemo"), (501, "xx", "123 !!"), (502, "yy", None), (503, "xx", "ωωω")]
    df = spark.createDataFrame(rows, "doc_id int, lang string, content string")
    profiles = quality.learn_profiles(df.where("doc_id < 60"), "lang")
    found = {r.doc_id: r.language for r in quality.detect(df, profiles, "doc_id").collect()}
    assert all(found[i] == name for i, name, _ in rows if i < 500)
    assert [found[i] for i in (500, 501, 502, 503)] == ["yy", None, None, None]
    assert metrics.confusion(quality.detect(df, profiles, "lang"), "language", "lang").where("guess = truth").agg(F.sum("n")).first()[0] == 120


def test_no_labels_no_languages(spark):
    df = spark.createDataFrame([(1, None, "words here")], "doc_id int, lang string, content string")
    profiles = quality.learn_profiles(df, "lang")
    assert [r.language for r in quality.detect(df, profiles, "doc_id").collect()] == [None]


def zipf(spark, count=400, seed=8):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    rows = [(i, "d", " ".join(pick.choices(words, weights, k=60))) for i in range(count)]
    return spark.createDataFrame(rows, "doc_id int, domain string, content string").repartition(5)


@pytest.mark.parametrize("capacity", [10**6, 700, 60, 5])
def test_summaries_give_the_exact_vocabulary(spark, capacity):
    """Lacking nothing, something, or too much to tell: the most frequent terms are the same."""
    counted = lexical.stage(lexical.terms(zipf(spark), "doc_id"), "counts")
    exact = lexical.stage(lexical.term_statistics(counted.select(F.inline("terms"))), "exact")
    found = lexical.heavy_statistics(counted, 30, capacity)
    assert rows_of(lexical.most_frequent(found, 30)) == rows_of(lexical.most_frequent(exact, 30))
    if capacity == 700:
        assert 30 <= found.count() < exact.count() / 3, "only terms that can be frequent were counted"


def test_a_summary_holds_so_many_terms_and_bounds_the_others():
    lists = [[{"term": f"t{j}", "tf": 1 + (j == 3)} for j in range(i, i + 40)] for i in range(0, 400, 4)]
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    batches = [pa.RecordBatch.from_arrays([pa.array(lists[at : at + 7], kind)], ["terms"]) for at in range(0, len(lists), 7)]
    rows = [row for batch in kernels.heavy_terms(iter(batches), 50) for row in batch.to_pylist()]
    lacking = [row["total"] for row in rows if row["term"] is None]
    held = {row["term"]: row["total"] for row in rows if row["term"] is not None}
    assert len(lacking) == 1 and len(held) <= 50
    true = {}
    for row in lists:
        for term in row:
            true[term["term"]] = true.get(term["term"], 0) + term["tf"]
    assert all(held.get(term, 0) <= n <= held.get(term, 0) + lacking[0] for term, n in true.items())


def test_an_index_from_summaries_is_not_saved(spark, tmp_path):
    index = lexical.build_index(zipf(spark, 20), 30, summary=50)
    with pytest.raises(ValueError, match="refreshed"):
        ix.save(ix.CorpusIndex(index.documents, index, None), str(tmp_path / "index"))


def test_lists_are_worked_on_in_parts(spark):
    """A batch of many words takes the memory of a part of it, and gives the same rows."""
    words = [f"w{i * i % 7919}" for i in range(1500)]
    batch = pa.record_batch({"n": list(range(2000)), "words": pa.array([words[i % 90 :] if i % 7 else None for i in range(2000)])})
    stop = pa.array(["w1"])

    def made(lists):
        return kernels.word_terms(lists, stop)

    tracemalloc.start()
    sizes = [found.num_rows for found in kernels.mapped_lists([batch], "words", "terms", made)]
    bounded = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    whole = made(batch.column("words"))
    assert bounded < tracemalloc.get_traced_memory()[1] / 4
    tracemalloc.stop()
    assert sum(sizes) == 2000 and len(sizes) > 8
    found = pa.Table.from_batches(list(kernels.mapped_lists([batch], "words", "terms", made)))
    assert found.column("n").to_pylist() == list(range(2000))
    as_sets = lambda rows: [{(x["term"], x["tf"]) for x in row} for row in rows.to_pylist()]
    assert as_sets(found.column("terms").slice(0, 300)) == as_sets(whole.slice(0, 300))


def test_parts_of_lists():
    lists = pa.array([[1] * 3, None, [], [1] * 9, [1], [1] * 2])
    assert list(kernels.list_parts(lists, 4)) == [(0, 3), (3, 4), (4, 6)]
    assert list(kernels.list_parts(lists.slice(3), 100)) == [(0, 3)]
    assert list(kernels.list_parts(lists.slice(0, 0), 4)) == []


def test_dot_of_nothing_in_common():
    one, two = (pa.array([[{"slot": slot, "weight": 1.0}]]) for slot in (1, 2))
    assert kernels.sparse_dot(one, two).to_pylist() == [0.0]
    assert kernels.sparse_dot(one.slice(0, 0), two.slice(0, 0)).to_pylist() == []


def test_a_large_head_takes_the_memory_of_a_part(monkeypatch):
    """Words are judged a part at a time however many known terms there are, and the result is the same."""
    pick = np.random.default_rng(3)
    known, gains = pa.array([f"word{i}" for i in range(50_000)]), pick.random((50_000, 2))
    rows = [[{"term": f"word{w}", "tf": 1 + w % 3} for w in own] for own in pick.integers(0, 60_000, (400, 100)).tolist()]
    rows[7], rows[8] = None, []
    words = pa.array(rows, pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())])))
    tail = pa.array([[]] * 400, pa.list_(pa.struct([("place", pa.int64()), ("gain", pa.float64())])))
    domains = pa.array(["a", "b"] * 200)
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), domains, words, tail], ["doc_id", "domain", "words", "tail"])

    def judged(values):
        monkeypatch.setattr(kernels, "PART_VALUES", values)
        tracemalloc.start()
        found = [part.column("_best").to_pylist() for part in kernels.best_domain([batch], np.array([3.0, 3.1]), (known, gains))]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return sum(found, []), peak

    whole, most = judged(100_000)
    found, bounded = judged(1_000)
    assert found == whole
    assert bounded < most / 4
