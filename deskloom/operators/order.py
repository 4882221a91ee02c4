"""Global order: the place of every row without passing all rows through one task."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from deskloom.session import stage

# A running number of a task's rows takes up the lower bits of Spark's row numbers.
_ROW_BITS = 33


def placed(rows: DataFrame, *order: Column | str, place: str = "place") -> DataFrame:
    """Rows with their place, from 1, in an order.

    The rows are range-partitioned by the order and sorted within the parts, so
    the parts follow each other; they are written with the number of the part and
    of the row in it. What is counted over all is one row per part: its rows, and
    by a running sum the rows before it. The place is that sum plus the row's
    number in the part. Equal rows get different places in any order, the same
    however often the result is read. Rows whose order keys are all equal lie in
    one part, so an order should end in a key.
    """
    at = F.monotonically_increasing_id()
    numbered = rows.orderBy(*order).select(
        "*",
        F.shiftright(at, _ROW_BITS).cast("int").alias("_part"),
        (at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1).alias("_row"),
    )
    written = stage(numbered, "placed")
    sizes = written.groupBy("_part").agg(F.count("*").alias("_rows"))
    # As many rows as the sort had parts.
    before = F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")
    offsets = sizes.select("_part", before.alias("_before"))
    out = written.join(F.broadcast(offsets), "_part")
    return out.withColumn(place, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before", "_rows")
