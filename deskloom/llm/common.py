"""What the operators of this folder share: input columns, samples, staging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.session import stage

__all__ = ["parts", "read", "rows", "sampled", "share", "small", "stage", "unpacked"]

ROWS = 500  # texts unpacked at once
PART_BYTES = 4_000_000  # bytes of text worked on at once


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def rows(df: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """Key and text under fixed names, so that no further column can clash.

    A null text counts as empty.
    """
    return df.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        *[F.col(f"`{name}`") for name in more],
    )


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Small slices of batches with their texts as bytes, so that a task holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column("text").cast(pa.binary()).to_pylist()


def parts(batches: Iterator[pa.RecordBatch], size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts have at most so many bytes together, or one longer text."""
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(length, dtype=np.int64)
        first = 0
        while first < len(ends):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(first, last - first)
            first = last


def share(df: DataFrame, key: str, bound: int, seed: int = 17) -> Column:
    """Predicate that keeps about `bound` rows, chosen by a hash of the key.

    Costs one count; where the table has no more than `bound` rows all stay.
    """
    total = df.count()
    if total <= bound:
        return F.lit(True)
    cut = int(bound / total * 1_000_000_000)
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000_000)) < cut


def sampled(df: DataFrame, key: str, bound: int, seed: int = 17) -> DataFrame:
    return df.filter(share(df, key, bound, seed))


def small(df: DataFrame, bound: int) -> list | None:
    """The rows of a table of at most `bound` rows, None if there are more."""
    found = df.limit(bound + 1).collect()
    return found if len(found) <= bound else None
