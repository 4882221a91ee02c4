"""A training corpus from raw documents: five stages, each over all that the one before kept.

Cases: a null text counts as empty and goes with the first stage, as it has no
language. Decisions are by doc_id: rows that share one are kept or dropped
together, and so are the rows without any. An empty table gives no sequences.
Further columns stay as they are until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.llm import common, containment, content_sort, language, minhash_forest, queries


def keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among the ids (id), with their own columns."""
    same = F.col("docs.doc_id").eqNullSafe(F.col("ids.id"))
    return docs.alias("docs").join(ids.select("id").alias("ids"), same, "left_semi")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language go: null, empty, or without a letter."""
    table = common.rows(docs, "doc_id", "text", "lang")
    found = language.predict(table, language.fit(table), spans=False)
    return keep(docs, found.filter("lang_pred <> 'und'"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays; of repeated rows one."""
    found = common.stage(content_sort.duplicates(common.rows(docs)).filter("kept"), "pipeline-copies")
    kept = keep(docs, found)
    if found.count() == kept.count():
        return kept
    row = F.struct(*[F.col(f"`{name}`") for name in kept.columns]).alias("row")
    text = F.xxhash64(content_sort.normalised(F.coalesce("text", F.lit("")))).alias("body")
    once = kept.select("doc_id", text, row).groupBy("doc_id", "body").agg(F.first("row").alias("row"))
    return once.select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return keep(docs, minhash_forest.near_duplicates(common.rows(docs)).filter("kept"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    items = common.rows(common.read(spark, sf_dir, "benchmark"), "item_id")
    found = containment.contained(common.rows(docs), items).select("id").distinct()
    same = F.col("docs.doc_id").eqNullSafe(F.col("ids.id"))
    return docs.alias("docs").join(found.alias("ids"), same, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens: the pieces of every document and their places."""
    return queries.packed(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

# Packing needs a tokenizer and near-dedup components: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = common.stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-').lower()}")
    return docs
