"""The pipeline against a plain version, its stages one by one, and the SQL of the queries that have one."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from contract import check
from deskloom.llm import queries

from .conftest import prose
from .test_duplicates import components, edited, shingle_set

SF = "/root/testdata/sf0.001"


def corpus():
    """(doc_id, text) rows with something for every stage to drop."""
    item = prose(900, 40)
    clean = [prose(i, 60) for i in range(12)]
    rows = list(enumerate(clean))
    rows += [(20, None), (21, ""), (22, "12 34 !?"), (23, clean[1].replace(" ", "\n")), (24, clean[1] + " "), (25, clean[1])]
    rows += [(30 + i, edited(clean[2], i, 1)) for i in range(4)]
    rows += [(40, f"{prose(50, 300)} {item} {prose(51, 300)}"), (41, item), (42, f"{prose(52, 30)} {' '.join(item.split()[:12])}")]
    rows += [(60, clean[3]), (60, clean[3]), (61, prose(61, 5000))]
    return rows, item


def plain(rows, item):
    kept = {i: text for i, text in rows if text and any(c.isalpha() for c in text)}
    first = {}
    for i in sorted(kept):
        first.setdefault(" ".join(f"x{kept[i]}x".split()), i)
    kept = {i: kept[i] for i in first.values()}
    ids = sorted(kept)
    near = components([kept[i] for i in ids])
    kept = {i: kept[i] for place, i in enumerate(ids) if near[place][1] == place}
    need = shingle_set(item)
    return {i for i, text in kept.items() if 100 * len(shingle_set(text) & need) < 75 * len(need)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows, item = corpus()
    table = [(i, text, "xx", "s", len(text or ""), 5, "a", True) for i, text in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, ids string, kept boolean"
    spark.createDataFrame(table, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_against_a_plain_version(spark, tables):
    found = entry.queries()["pipeline"](spark, tables).collect()
    assert {row["doc_id"] for row in found} == plain(*corpus())
    assert len({(row["doc_id"], row["piece"]) for row in found}) == len(found)


def test_every_stage_but_the_last_returns_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "exact dedup", "near dedup", "decontamination", "packing"]
    sizes = [docs.count()]
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, tables)
        assert out.schema == docs.schema
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False))  # every stage has an effect


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, name):
    verdict = check.compare(spark, SF, name, queries.QUERIES[name], queries.SQL[name])
    assert ": OK " in verdict, verdict
