import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from deskloom import fixed, kernels
from deskloom.operators import blocks, chunking, dense, fusion, lexical
from deskloom.plans import index as ix, retrieval
from deskloom.session import stage

WORDS = "card login refund test page score limit plan error code team email invite export".split()


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    rows = [
        (f"d{k:03d}", ["bank", "code", "chat"][min(2, k % 5)], " ".join(rng.choices(WORDS, k=rng.randint(3, 30))))
        for k in range(n - 4)
    ]
    # Equal documents: ties everywhere.
    return rows + [(f"d{n - 4 + k:03d}", "bank", "refund card limit") for k in range(4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id string, domain string, content string")


QUERIES = [
    ("q1", "refund card", None), ("q2", "login page error", "code"), ("q3", "nothing shared zzz", None),
    ("q4", "limit", "bank"), ("q5", "the of", "chat"), ("q6", "refund", "nowhere"), ("q7", "", None),
]


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id string, query string, domain_filter string")


def terms(text):
    words = [w for w in text.lower().split() if len(w) > 1 and w not in fixed.STOP_WORDS]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def brute(rows, n, drop_zero=False, size=fixed.VOCABULARY):
    counts = {d: terms(text) for d, _, text in rows}
    total, df = Counter(), Counter()
    for c in counts.values():
        total.update(c)
        df.update(c.keys())
    vocab = sorted(total, key=lambda t: (-total[t], t))[:size]
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in vocab}

    def unit(c):
        raw = {t: k * idf[t] for t, k in c.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / norm for t, v in raw.items()}

    vectors = {d: unit(c) for d, c in counts.items()}
    out = {}
    for q, text, domain in QUERIES:
        if not text:
            continue
        v = unit(terms(text))
        scored = [(d, round(sum(w * vectors[d].get(t, 0) for t, w in v.items()), 9)) for d, dom, _ in rows if domain in (None, dom)]
        ranked = sorted((x for x in scored if x[1] > 0 or not drop_zero), key=lambda x: (-x[1], x[0]))[:n]
        for rank, (d, score) in enumerate(ranked, 1):
            out[q, rank] = (d, round(score, 6))
    return out


def as_dict(df):
    return {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 6)) for r in df.collect()}


@pytest.mark.parametrize("drop_zero", [False, True])
@pytest.mark.parametrize("size", [fixed.VOCABULARY, 25])
def test_lexical_top(docs, queries, drop_zero, size):
    index = lexical.build_index(docs, size)
    got = as_dict(lexical.top_documents(queries, index, 7, drop_zero))
    assert got == brute(corpus(), 7, drop_zero, size)


def test_lexical_top_in_several_blocks(docs, queries):
    index = lexical.build_index(docs)
    got = as_dict(lexical.top_documents(queries, index, 7, block_rows=2))
    assert got == brute(corpus(), 7)


def test_lexical_top_with_tiny_tiles_and_batches(spark, docs, queries, monkeypatch):
    monkeypatch.setattr(kernels, "TILE_CELLS", 8)
    monkeypatch.setattr(kernels, "TILE_PRODUCTS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        index = lexical.build_index(docs)
        assert as_dict(lexical.top_documents(queries, index, 7)) == brute(corpus(), 7)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_saved_index_gives_the_same(spark, docs, queries, tmp_path):
    ix.save(ix.build(docs), str(tmp_path / "index"))
    index = ix.load(spark, str(tmp_path / "index"), with_vectors=False)
    assert as_dict(lexical.top_documents(queries, index.lexical, 7)) == brute(corpus(), 7)


def test_a_vocabulary_too_large_to_send_is_joined(docs, queries, monkeypatch):
    monkeypatch.setattr(lexical, "SENT_TERMS", 3)
    index = lexical.build_index(docs, None)
    assert as_dict(lexical.top_documents(queries, index, 7)) == brute(corpus(), 7)


def test_an_index_is_complete_or_none(spark, docs, tmp_path):
    folder = str(tmp_path / "index")
    index = ix.build(docs)
    index.documents.write.parquet(f"{folder}/documents")  # as a save that broke off leaves it
    with pytest.raises(AnalysisException):
        ix.load(spark, folder)
    with pytest.raises(AnalysisException):
        ix.save(index, folder)
    ix.save(index, f"{folder}-2")
    assert ix.load(spark, f"{folder}-2").vectors is None
    with pytest.raises(AnalysisException):
        ix.save(ix.load(spark, f"{folder}-2"), f"{folder}-2")


def test_a_search_makes_weights_once_and_passes_on_few_rows(spark, docs, queries, monkeypatch):
    staged = []
    monkeypatch.setattr(blocks, "stage", lambda df, name, **options: staged.append(name) or stage(df, name, **options))
    index = lexical.build_index(docs.repartition(30))
    index._weights = index.weights.repartition(100)
    wanted = brute(corpus(), 7)
    assert as_dict(lexical.top_documents(queries, index, 7, block_rows=2)) == wanted
    assert staged.count("scanned") == 1
    tasks = blocks.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert blocks.in_few_tasks(index.weights).rdd.getNumPartitions() <= tasks < 100
    assert as_dict(lexical.top_documents(queries, index, 7)) == wanted and staged.count("scanned") == 1


def test_documents_meet_only_queries_of_their_domain(docs, queries, monkeypatch):
    index = lexical.build_index(docs)
    asked = queries.withColumn("domain_filter", F.coalesce("domain_filter", F.lit("")))
    weights = lexical.query_weights(asked.where("query != ''"), index.vocab, "domain_filter")
    packed = lexical.pack_queries(weights.where(F.size("postings") > 0).toArrow())
    batches = index.weights.select("doc_id", "domain", "postings").toArrow().to_batches()
    met, tiles = [], kernels._sparse_tiles
    monkeypatch.setattr(kernels, "_sparse_tiles", lambda asked, *rest: met.append(len(asked[0])) or tiles(asked, *rest))

    def found(most):
        monkeypatch.setattr(kernels, "SPLIT_DOMAINS", most)
        met.clear()
        return sorted(row for b in kernels.sparse_top(iter(batches), packed, 7) for row in zip(*b.to_pydict().values()))

    whole = found(-1)
    assert set(met) == {len(packed[2])}
    assert found(16) == whole and min(met) < len(packed[2])


def test_no_text_is_shuffled_for_an_index(docs, queries):
    index = lexical.build_index(docs)
    plan = index.weights._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_best_keeps_only_rows_that_count(monkeypatch):
    monkeypatch.setattr(kernels, "WAITING_ROWS", 10)
    rng = np.random.default_rng(3)
    best, rows = kernels.Best(4, 5), []
    for _ in range(60):
        query, doc, score = rng.integers(0, 5, 7), rng.integers(0, 10**6, 7), rng.integers(0, 20, 7) / 10
        rows += list(zip(query, -score, doc))
        keep = score >= best.least[query]
        best.add(query[keep], doc[keep], score[keep], np.ones(keep.sum(), bool))
    best.rank()
    got = list(zip(best.parts[0][0], -best.parts[0][2], best.parts[0][1]))
    assert got == [row for q in range(5) for row in sorted(r for r in rows if r[0] == q)[:4]]


def test_sparse_kernels():
    terms = pa.array([["b", "a", "b"], [], None, ["c"]])
    counted = kernels.tally(terms)
    assert [sorted((x["term"], x["tf"]) for x in row) for row in counted.to_pylist()] == [[("a", 1), ("b", 2)], [], [], [("c", 1)]]
    found = kernels.weigh(counted, (pa.array(["b", "a"]), np.array([7, 9]), np.array([2.0, 3.0])))
    assert [[(x["slot"], x["tf"], round(x["weight"], 6)) for x in row] for row in found.to_pylist()] == [[(7, 2, 0.8), (9, 1, 0.6)], [], [], []]
    assert kernels.sparse_dot(found, found).to_pylist() == pytest.approx([1, 0, 0, 0])


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, dim)).astype(np.float32)
    rows[n // 2 :] = rows[: n - n // 2]  # every vector twice
    return rows


@pytest.mark.parametrize("prefilter", [False, True])
@pytest.mark.parametrize("block_rows", [100, 2])
def test_dense_top(spark, prefilter, block_rows):
    d, q, n = vectors(40, 6, 1), vectors(6, 6, 2), 9
    d[5] = 0
    domains = ["a" if k % 3 else "b" for k in range(40)]
    wanted = [None, "a", "b", None, "b", "z"]
    dd = spark.createDataFrame([(k, domains[k], d[k].tolist()) for k in range(40)], "doc_id bigint, domain string, embedding array<float>")
    qq = spark.createDataFrame([(k, wanted[k], q[k].tolist()) for k in range(6)], "query_id bigint, domain_filter string, embedding array<float>")
    got = as_dict(dense.top_documents(qq, dd, n, prefilter, block_rows))

    def unit(x):
        x = x.astype(float)
        norm = np.linalg.norm(x)
        return x / norm if norm else x

    expected = {}
    for k in range(6):
        scored = sorted(((round(float(unit(q[k]) @ unit(d[j])), 9), j) for j in range(40)), key=lambda x: (-x[0], x[1]))
        fits = lambda j: wanted[k] in (None, domains[j])
        if prefilter:
            kept = [x for x in scored if fits(x[1])][:n]
        else:
            kept = [x for x in scored[:n] if fits(x[1])]
        for rank, (score, j) in enumerate(kept, 1):
            expected[k, rank] = (j, round(score, 6))
    assert got == expected


def test_bad_vectors_score_zero(spark):
    dd = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", None), (3, "a", [1.0])], "doc_id int, domain string, embedding array<float>")
    qq = spark.createDataFrame([(1, None, [1.0, 0.0])], "query_id int, domain_filter string, embedding array<float>")
    got = as_dict(dense.top_documents(qq, dd, 5))
    assert got == {(1, 1): (1, 1.0), (1, 2): (2, 0.0), (1, 3): (3, 0.0)}


def test_a_short_query_vector_does_not_matter(spark):
    dd = spark.createDataFrame([(n, "a", [float(n), 1.0, 2.0]) for n in range(9)], "doc_id int, domain string, embedding array<float>")
    qq = spark.createDataFrame([(0, None, [1.0]), (1, None, [3.0, 1.0, 2.0])], "query_id int, domain_filter string, embedding array<float>")
    got = as_dict(dense.top_documents(qq, dd, 2))
    assert got[1, 1] == (3, 1.0) and {q for q, _ in got} == {1}


def ranked_list(spark, rows):
    return spark.createDataFrame(rows, "query_id int, doc_id string, score double, rank int")


def test_fusion(spark):
    sem = ranked_list(spark, [(1, "a", 0.9, 1), (1, "b", 0.8, 2), (2, "x", 0.5, 1)])
    lex = ranked_list(spark, [(1, "c", 0.7, 1), (1, "b", 0.6, 2), (1, "z", 0.0, 3), (3, "y", 0.1, 1)])
    got = fusion.fuse({"semantic": sem, "lexical": lex}, 8).orderBy("query_id", "fused_rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(1, "b"), (1, "a"), (1, "c"), (1, "z"), (2, "x"), (3, "y")]
    b, a = got[0], got[1]
    assert b.rrf_sum == pytest.approx(2 / 62) and b.fused_score == pytest.approx(1 / 61)
    assert a.lexical_score == 0.0 and a.lexical_rank is None and a.semantic_score == 0.9
    assert fusion.fuse({"semantic": sem, "lexical": lex}, 2).where("query_id = 1").count() == 2


def test_fusion_sum_does_not_depend_on_list_order(spark):
    sem = ranked_list(spark, [(1, "a", 0.9, 1), (1, "b", 0.8, 7)])
    lex = ranked_list(spark, [(1, "b", 0.7, 3), (1, "a", 0.6, 9)])
    one = {r.doc_id: r.rrf_sum for r in fusion.fuse({"s": sem, "l": lex}).collect()}
    two = {r.doc_id: r.rrf_sum for r in fusion.fuse({"l": lex, "s": sem}).collect()}
    assert one == two


def chunks_of(spark, text, **options):
    df = spark.createDataFrame([(1, text)], "doc_id int, content string")
    return [(r.chunk_no, r.start, r.end, r.chunk) for r in chunking.chunk(df, **options).orderBy("chunk_no").collect()]


def test_chunks_of_short_texts(spark):
    assert chunks_of(spark, "x" * 1200) == [(0, 0, 1200, "x" * 1200)]
    assert chunks_of(spark, "short ") == [(0, 0, 6, "short ")]


def test_chunks_without_marks_repeat_the_tail(spark):
    spans = [(a, b) for _, a, b, _ in chunks_of(spark, "x" * 2500)]
    assert spans == [(0, 1200), (1000, 2200), (2000, 2500), (2300, 2500)]
    spans = [(a, b) for _, a, b, _ in chunks_of(spark, "x" * 2500, drop_tail=True)]
    assert spans == [(0, 1200), (1000, 2200), (2000, 2500)]


def test_cut_prefers_later_marks_only(spark):
    # A paragraph end late in the zone wins over an earlier sentence end.
    text = "a" * 1000 + ". " + "b" * 100 + "\n\n" + "c" * 900
    assert chunks_of(spark, text)[0][2] == 1104
    # A line end at the cut itself does not replace it; beyond it does.
    text = "a" * 1000 + "\n\n" + "b" * 50 + "\n" + "c" * 900
    assert chunks_of(spark, text)[0][2] == 1053
    # Marks before the zone do not count.
    text = "a" * 900 + ". " + "b" * 1000
    assert chunks_of(spark, text)[0][2] == 1200


def test_blank_chunks_are_dropped(spark):
    got = chunks_of(spark, "a" * 100 + " " * 2500 + "b")
    assert [c[3] for c in got] == ["a" * 100, "b", "b"] or all(c[3] for c in got)
    assert [c[0] for c in got] == list(range(len(got)))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .?!\n", min_size=1, max_size=300), st.integers(5, 60))
def test_chunks_cover_the_text_and_move_on(text, size):
    overlap = size // 6
    spans = list(kernels.chunk_spans(text, size, overlap))
    assert spans[0][0] == 0 and max(e for _, e in spans) == len(text)
    for (s1, e1), (s2, e2) in zip(spans, spans[1:]):
        assert s2 > s1 and s2 <= e1
    assert all(0 < e - s <= max(size, len(text) if len(text) <= size else size) for s, e in spans)


def test_hybrid_and_snippets(spark):
    long = ("Intro words here. " * 100) + ("The refund rule for a card is strict. " * 30) + ("Outro talk. " * 200)
    rows = [("l", "data/l.md", "bank", "t", "s", long.strip()), ("s", "data/s.md", "bank", "t", "s", "refund card plan"), ("o", "data/o.md", "code", "t", "s", "python loop")]
    docs = spark.createDataFrame(rows, "doc_id string, doc_path string, domain string, topic string, subtopic string, content string")
    vecs = spark.createDataFrame([("l", [1.0, 0.0]), ("s", [0.6, 0.8]), ("o", [0.0, 1.0])], "doc_id string, embedding array<float>")
    asked = spark.createDataFrame([("q", "refund rule card", None), ("e", "", None), ("d", "loop", "bank")], "query_id string, query string, domain_filter string")
    qv = spark.createDataFrame([("q", [1.0, 0.1]), ("d", [0.0, 1.0])], "query_id string, embedding array<float>")
    index = ix.build(docs, vecs)
    got = {(r.query_id, r.doc_id): r for r in retrieval.hybrid_topk(asked, index, qv).collect()}
    assert {q for q, _ in got} == {"q", "d"}
    assert ("d", "o") not in got
    assert got["q", "s"].is_full_file and got["q", "s"].snippet == "refund card plan"
    hit = got["q", "l"]
    assert not hit.is_full_file and "refund rule" in hit.snippet and len(hit.snippet) <= 2 * 1200 + 2
    assert got["q", "o"].lexical_score == 0.0  # padding keeps unrelated documents in

    chunk_vectors = chunking.chunk(docs.select("doc_id", "content")).select(
        "doc_id", "chunk_no", F.when(F.col("chunk_no") == 3, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding")
    )
    dense_hit = [r for r in retrieval.hybrid_topk(asked, index, qv, chunk_vectors).collect() if (r.query_id, r.doc_id) == ("q", "l")][0]
    parts = {r.chunk_no: r.chunk for r in chunking.chunk(docs.where("doc_id = 'l'")).collect()}
    assert dense_hit.snippet == parts[0] + "\n\n" + parts[3]


def test_index_refresh(spark, tmp_path):
    schema = "doc_id string, doc_path string, domain string, content string, content_hash string"
    rows = [(k, f"p/{k}", "bank", text, text) for k, text in (("a", "refund card"), ("b", "login page"), ("c", "test plan"))]
    docs = spark.createDataFrame(rows, schema)
    vecs = spark.createDataFrame([(k, [1.0, 0.0]) for k in "abc"], "doc_id string, embedding array<double>")
    ix.save(ix.build(docs, vecs), str(tmp_path / "v1"))
    made = lambda d: d.select("doc_id", "domain", F.array(F.lit(0.0), F.lit(2.0)).alias("embedding"), "doc_path")
    same = ix.refresh(spark, str(tmp_path / "v1"), str(tmp_path / "never"), docs, made)
    assert same.documents.count() == 3 and not (tmp_path / "never").exists()
    new = spark.createDataFrame([rows[0], ("b", "p/b", "bank", "logout", "logout"), ("d", "p/d", "bank", "export", "export")], schema)
    index = ix.refresh(spark, str(tmp_path / "v1"), str(tmp_path / "v2"), new, made)
    assert {r.doc_id: r.embedding[1] for r in index.vectors.collect()} == {"a": 0.0, "b": 2.0, "d": 2.0}
    asked = spark.createDataFrame([("q", "logout", None)], "query_id string, query string, domain_filter string")
    assert lexical.top_documents(asked, index.lexical, 3, drop_zero=True).first().doc_id == "b"
