import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from contract import inputs
from deskloom.operators import manifest, quality
from deskloom.sources import corpus


def write(root, path, data):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_read_corpus(spark, tmp_path):
    root = tmp_path / "data"
    write(root, "Acme/top.md", " one ")
    write(root, "Acme/bill/q.md", "two")
    write(root, "Acme/bill/card/deep/q 1+1.v2.md", "three")
    write(root, "zeta/empty.md", " \n ")
    write(root, "zeta/bad.md", b"ok\xff\xfe end")
    write(root, "zeta/skip.txt", "no")
    write(root, "loose.md", "not in a domain")
    rows = corpus.read_corpus(spark, str(root)).orderBy("doc_id").collect()
    got = [(r.doc_path, r.domain, r.topic, r.subtopic, r.content) for r in rows]
    assert got == [
        ("data/Acme/bill/card/deep/q 1+1.v2.md", "acme", "bill", "card", "three"),
        ("data/Acme/bill/q.md", "acme", "bill", "q", "two"),
        ("data/Acme/top.md", "acme", "acme", "top", "one"),
        ("data/zeta/bad.md", "zeta", "zeta", "bad", "ok end"),
    ]
    assert rows[2].content_hash == hashlib.sha256(b"one").hexdigest()
    assert rows[0].mtime is not None


def test_a_corpus_of_many_files_is_read_by_few_tasks(spark, tmp_path):
    for n in range(300):
        write(tmp_path / "data", f"acme/t/{n}/q.md", f"text {n}")
    sizes = {"spark.sql.files.maxPartitionBytes": "4m", "spark.sql.files.openCostInBytes": "4m"}
    before = {name: spark.conf.get(name) for name in sizes}
    for name, value in sizes.items():
        spark.conf.set(name, value)
    try:
        rows = corpus.read_corpus(spark, str(tmp_path / "data"))
        assert rows.select("content").distinct().count() == 300
        assert rows.rdd.getNumPartitions() <= corpus.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert spark.conf.get(corpus.LISTING) == "10000"


def test_files_are_those_of_sparks_writer(spark, tmp_path):
    rows = spark.createDataFrame(
        [("de", "s", 1, b"one"), ("de", "s", 10, b"ten\n"), ("de", "s", 2, None), (None, "", 3, b"\xff\xe2\x82 x"),
         ("d e/=%#:ü", "[a]\\", None, b""), ("en", "s", 4, b"twice"), ("en", "s", 4, b"twice"), ("de", "s", -1, b"m")],
        "domain string, topic string, page long, text binary",
    ).withColumn("text", F.col("text").cast("string"))

    def texts(root):
        return sorted((str(f.parent.relative_to(root)), f.read_bytes()) for f in root.rglob("*.txt"))

    rows.coalesce(1).write.partitionBy("domain", "topic", "page").text(str(tmp_path / "spark"))
    inputs.write_files(rows, str(tmp_path / "own"))
    assert texts(tmp_path / "own") == texts(tmp_path / "spark") and len(texts(tmp_path / "own")) == 7
    # Nothing else is left there, and a file's name doesn't depend on the run.
    assert {f.name for f in (tmp_path / "own").rglob("*") if f.is_file()} == {"part.txt"}


def test_path_key_orders_by_parts(spark):
    paths = ["a-b/x.md", "a/y.md", "a/b/z.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r.p for r in df.orderBy(corpus.path_key(F.col("p"))).collect()]
    assert got == sorted(paths, key=lambda p: p.split("/"))


FRONT = """---
title: "A: b"
last_updated_iso: "2026-03-16T20:39:36Z"
empty:
breadcrumbs:
  - "Screen"
  - Guides
---
# Body
key: no
"""


def test_front_matter(spark):
    df = spark.createDataFrame([(FRONT,), ("no front",)], "content string")
    rows = df.select(*[c.alias(n) for n, c in corpus.front_matter(F.col("content")).items()]).collect()
    assert rows[0].front == {"title": "A: b", "last_updated_iso": "2026-03-16T20:39:36Z"}
    assert rows[0].breadcrumbs == ["Screen", "Guides"]
    assert rows[1].front == {} and rows[1].breadcrumbs == []


def test_front_dates(spark):
    heads = [
        'last_updated_iso: "2026-03-16T20:39:36Z"',
        'last_modified: "2017-07-18T16:48:39.721Z"',
        'last_updated_exact: "Feb 19, 2026, 3:31 PM"',
        'last_updated_exact: "soon"',
    ]
    df = spark.createDataFrame([(n, f"---\n{h}\n---\n") for n, h in enumerate(heads)], "n int, content string")
    front = corpus.front_matter(F.col("content"))["front"]
    got = [r.d for r in df.withColumn("d", corpus.front_date(front)).orderBy("n").select(F.col("d").cast("string").alias("d")).collect()]
    assert got == ["2026-03-16 20:39:36", "2017-07-18 16:48:39.721", "2026-02-19 15:31:00", None]


def test_folders_named_like_the_root(spark, tmp_path):
    root = tmp_path / "data" / "x" / "data"
    for path in ("zeta/data/b.md", "zeta/x/data/y/c.md", "data/d.md"):
        write(root, path, path)
    rows = corpus.read_corpus(spark, str(root) + "/").orderBy("doc_id").collect()
    assert [(r.doc_path, r.domain, r.topic) for r in rows] == [
        ("data/data/d.md", "data", "data"), ("data/zeta/data/b.md", "zeta", "data"), ("data/zeta/x/data/y/c.md", "zeta", "x"),
    ]


def test_catalogue_shapes(spark, tmp_path):
    tool = {"description": "d", "parameters": {"type": "object", "properties": {}, "required": ["a"]}}
    shapes = {
        "named": [{"name": "t", **tool}, {"no": "tool"}, 5],
        "action": [{"action": "t", **tool}],
        "keyed": {"t": tool},
    }
    for name, shape in shapes.items():
        (tmp_path / name).write_text(json.dumps(shape, indent=1))
        found = corpus.read_tools(spark, str(tmp_path / name)).collect()
        assert [(r.name, r.description, r.parameters.required) for r in found] == [("t", "d", ["a"])], name
    (tmp_path / "broken").write_text("[{")
    assert corpus.read_tools(spark, str(tmp_path / "broken")).count() == 0
    assert [r.name for r in corpus.read_tools(spark, str(tmp_path / "broken"), str(tmp_path / "keyed")).collect()] == ["t"]


def test_read_tools_falls_back(spark, tmp_path):
    tool = {"name": "t", "description": "d", "parameters": {"type": "object", "properties": {"a": {"type": "string", "description": "x"}}, "required": ["a"]}}
    (tmp_path / "tools.json").write_text(json.dumps([tool]))
    found = corpus.read_tools(spark, str(tmp_path / "none.json"), str(tmp_path / "tools.json")).collect()
    assert [r.name for r in found] == ["t"] and found[0].parameters.required == ["a"]
    assert corpus.read_tools(spark, str(tmp_path / "none.json")).count() == 0


def test_delta_and_refresh(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "doc_path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "doc_path string, content_hash string")
    changes = manifest.delta(old, new)
    assert {r.doc_path: r.status for r in changes.collect()} == {"a": "same", "b": "changed", "c": "deleted", "d": "new"}
    assert not manifest.is_current(changes) and manifest.is_current(manifest.delta(old, old))
    derived = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old")], "doc_path string, made string")
    out = manifest.refresh(derived, new, changes, lambda d: d.select("doc_path", F.lit("new").alias("made")))
    assert {(r.doc_path, r.made) for r in out.collect()} == {("a", "old"), ("b", "new"), ("d", "new")}


def test_manifest_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([("a", "1", "x")], "doc_path string, content_hash string, content string")
    manifest.write(docs, str(tmp_path / "m"))
    assert manifest.is_current(manifest.delta(manifest.read(spark, str(tmp_path / "m")), docs))
    assert manifest.read(spark, str(tmp_path / "none")) is None
    write(tmp_path, "broken/part-0.parquet", b"no parquet")
    assert manifest.read(spark, str(tmp_path / "broken")) is None


def test_prefer_recent(spark):
    rows = [(1, "a", 1, None, 2), (1, "b", 2, datetime(2020, 1, 1), 2), (1, "c", 3, datetime(2024, 1, 1), 2), (1, "d", 4, datetime(2024, 1, 1), 3)]
    df = spark.createDataFrame(rows, "query_id int, doc_id string, fused_rank int, doc_date timestamp, depth int")
    got = [r.doc_id for r in quality.prefer_recent(df).orderBy("preferred_rank").collect()]
    assert got == ["d", "c", "b", "a"]


def test_misfiled(spark):
    rows = [(n, "bank", "card payment money bank dispute") for n in range(5)] + [
        (n, "code", "compile function python variable loop") for n in range(5, 10)
    ] + [(10, "bank", "python function loop compile")]
    df = spark.createDataFrame(rows, "doc_id int, domain string, content string")
    assert [r.doc_id for r in quality.misfiled(df).where("misfiled").collect()] == [10]


@pytest.mark.parametrize("sent", [quality.SENT_GAINS, 2])
def test_misfiled_scores_every_domain(spark, monkeypatch, sent):
    """A document that shares no word with a small domain may still fit it best."""
    monkeypatch.setattr(quality, "SENT_GAINS", sent)
    rows = [(1, "big", "kiwi"), (2, "big", "word " * 40_000), (3, "small", "plum"), (4, "small", ""), (5, "big", "the")]
    df = spark.createDataFrame(rows, "doc_id int, domain string, content string")
    got = {r.doc_id: (r.best_domain, r.misfiled) for r in quality.misfiled(df).collect()}
    assert got == {1: ("small", True), 2: ("big", False), 3: ("small", False), 4: (None, False), 5: (None, False)}


def test_disagreement(spark):
    old, new = datetime(2020, 1, 1), datetime(2024, 1, 1)
    rows = [(1, "a", "t", old), (1, "a", "t", new), (2, "a", "t", old), (2, "a", "u", new), (3, "a", "t", None), (3, "b", "t", old)]
    df = spark.createDataFrame(rows, "query_id int, domain string, topic string, doc_date timestamp")
    got = {r.query_id: (r.sources, r.stale, r.mixed, r.low_confidence) for r in quality.disagreement(df).collect()}
    assert got == {1: (2, True, False, True), 2: (2, False, False, False), 3: (2, False, True, True)}


def test_language(spark):
    texts = ["The cat is in the house with you", "Der Hund und die Katze ist nicht da", "Le chat est dans la maison pour une nuit", "El gato no se fue por las casas", "", "日本語", "xyzzy"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, x string")
    got = [r.l for r in df.select("n", quality.language(F.col("x")).alias("l")).orderBy("n").collect()]
    assert got[:4] == ["en", "de", "fr", "es"] and got[4:] == [None] * 3
