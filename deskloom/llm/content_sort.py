"""Exact duplicates by sorting the contents.

Normalised texts are range-partitioned by sampled splitters and sorted by Spark,
which spills to disk as needed. Equal texts are then neighbours, and each is
compared in full with the one before it. A run that splitters cut, as a large
group must be, is put together from one row per run.

Cases: a null text equals an empty one. Repeated rows are members of their group
like any other, and exactly one row of a group is kept: one without id only where
no row of the group has any, and then keep_id is null. An empty table gives an
empty result. Further columns are ignored. Texts are compared whole, whatever
their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PREFIX = 64  # characters of a splitter; what sampling sends to the driver is bounded by it


def normalised(text: Column) -> Column:
    """Every run of blanks as one space; single spaces aren't touched."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted texts: id, first id of the run, place in the run, SHA-256 of the text."""
    before, head, digest, place = None, None, None, 0
    for batch in batches:
        ids, heads, places, digests = batch.column("id").to_pylist(), [], [], []
        for i, text in zip(ids, batch.column("text").to_pylist(), strict=True):
            if text == before:
                place += 1
            else:
                before, head, place = text, i, 0
                digest = hashlib.sha256(text.encode()).hexdigest()
            heads.append(head)
            places.append(place)
            digests.append(digest)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(heads, pa.int64()),
                pa.array(places, pa.int64()),
                pa.array(digests, pa.string()),
            ],
            ["id", "head", "place", "text_sha256"],
        )


def duplicates(documents: DataFrame) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each row (id, text)."""
    texts = documents.select("id", normalised(F.col("text")).alias("text"))
    dealt = texts.select(
        "*",
        F.substring("text", 1, PREFIX).alias("prefix"),
        F.xxhash64("text").alias("hash"),
        F.length("text").alias("length"),
    ).repartitionByRange("prefix", "length", "hash", F.asc_nulls_last("id"))
    # The head of a run is its smallest id, null only if none of its rows has one.
    found = dealt.sortWithinPartitions("prefix", "length", "text", F.asc_nulls_last("id")).select("id", "text")
    found = common.stage(
        found.mapInArrow(runs, "id long, head long, place long, text_sha256 string"), "content-runs"
    )
    pieces = found.groupBy("text_sha256", "head").agg(F.count("*").alias("size"))
    groups = (
        pieces.groupBy("text_sha256")
        .agg(F.min("head").alias("keep_id"), F.sum("size").alias("group_size"))
        .filter("group_size > 1")
    )
    # By run, of which a task sorted each: rows of one large group don't meet again.
    named = pieces.join(groups, "text_sha256").drop("size")
    same = (F.col("f.text_sha256") == F.col("g.text_sha256")) & F.col("f.head").eqNullSafe(F.col("g.head"))
    joined = found.alias("f").join(named.alias("g"), same, "left").select("f.*", "keep_id", "group_size")
    keep = F.coalesce("keep_id", "id")
    return joined.select(
        "id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("id").eqNullSafe(keep) & (F.col("place") == 0)).alias("kept"),
        "text_sha256",
    )
