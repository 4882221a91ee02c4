"""Query blocks: how a batch of queries reaches the tasks that hold documents.

Queries are cut into blocks of a bounded size. One block at a time is sent to the
tasks; if there are several, the queries are a written table, the result of each
block is written and what was sent is released: the driver holds one block,
however many there are, and no plan grows with them. Documents are never shuffled
or broadcast. Every set of queries goes this way.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from deskloom.session import new_folder, stage

# Queries of one block. A query has at most 512 characters of text, and vectors
# are cut by values besides, so a block stays under about 64 MB.
BLOCK_QUERIES = 32_768
BLOCK_VALUES = 8_000_000

# Groups that the rows of one query are ranked in first.
GROUPS = 64

# Tasks of a search, for each core. Each passes on n rows of every query, so what
# is ranked grows with the tasks, not with the documents.
TASKS_PER_CORE = 4


def in_few_tasks(rows: DataFrame) -> DataFrame:
    """Rows for a search, in no more tasks than keep all cores busy."""
    return rows.coalesce(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)


def domain_filters(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The domain names the queries ask for, and the place of each query's own
    among them (-1 for none)."""
    wanted = np.array(block.column("domain_filter").to_pylist(), dtype=str)
    names = np.unique(wanted[wanted != ""])
    return names, np.where(wanted == "", -1, np.searchsorted(names, wanted))


def each(
    queries: DataFrame,
    run: Callable[[Callable, tuple], DataFrame],
    pack: Callable[[pa.Table], tuple],
    rows: int = BLOCK_QUERIES,
    several: Callable[[], None] | None = None,
) -> DataFrame:
    """The rows that run(sent, packed) makes of every block of queries.

    pack makes what a task needs from a block: packed, which sent() gives inside
    a task. Queries of one block go to the tasks as they come. More are a written
    table; the rows of each block are written, and what was sent is released
    before the next. several is called before the first of several blocks.
    """
    spark = queries.sparkSession
    few = queries.limit(rows + 1).toArrow()
    if few.num_rows <= rows:
        packed = pack(few)
        only = spark.sparkContext.broadcast(packed)
        return run(lambda: only.value, packed)
    del few
    if several is not None:
        several()
    asked = stage(queries, "queries")
    parts = -(-asked.count() // rows)
    folder = new_folder(spark, "found")
    for part in range(parts):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow()
        packed = pack(block)
        sent = spark.sparkContext.broadcast(packed)
        found = run(lambda sent=sent: sent.value, packed)
        found.write.parquet(f"{folder}/block={part}")
        sent.destroy()
    return spark.read.schema(found.schema).parquet(folder).drop("block")


def search(
    queries: DataFrame,
    documents: DataFrame,
    pack: Callable[[pa.Table], tuple],
    score: Callable,
    schema: str,
    rows: int = BLOCK_QUERIES,
) -> DataFrame:
    """Rows of schema that the tasks return for all blocks, with the group of
    the task that returned them.

    score(batches, packed) runs in the task, on what pack made. Documents that
    several blocks are searched in are made once and written.
    """
    scanned = [documents]

    def run(sent, _):
        found = in_few_tasks(scanned[0]).mapInArrow(lambda batches: score(batches, sent()), schema)
        return found.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))

    def several():
        scanned[0] = stage(documents, "scanned", compression="zstd")

    return each(queries, run, pack, rows, several)


def best(found: DataFrame, n: int) -> DataFrame:
    """The n best rows of every query, ranked: score down, document up.

    Ranked within the groups first, so that what meets for one query does not
    grow with the number of tasks.
    """
    order = [F.desc("score"), F.asc("doc_id")]
    first = F.row_number().over(Window.partitionBy("query_id", "_group").orderBy(*order))
    few = found.withColumn("rank", first).where(F.col("rank") <= n).drop("_group")
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return few.withColumn("rank", last).where(F.col("rank") <= n)
