"""Ticket files: CSV in, CSV out, and tickets from a table of turns."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from deskloom import fixed
from deskloom.functions import text as t

CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


# Blanks around a value are part of it.
WRITTEN = {
    "header": True, "quote": '"', "escape": '"', "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def snake(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def read_table(spark: SparkSession, path: str, file: str | None = None) -> DataFrame:
    """Any ticket CSV as text columns with snake-case names, nulls as ""; if
    wanted, with the path of the file each row is from."""
    df = spark.read.options(**CSV).csv(path)
    columns = [F.coalesce(df[f"`{c}`"], F.lit("")).alias(snake(c)) for c in df.columns]
    return df.select(*columns, *([F.col("_metadata.file_path").alias(file)] if file else []))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of CSV files with a ticket_id that follows file names and lines.

    A file is read by one task from top to bottom, so a running number gives the
    order in it. The number of a file's first row is one row per file, as many as
    the driver's list of the files to read, so it is sent to the tasks.
    """
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    firsts = rows.groupBy("_file").agg(F.min("_at").alias("_first"))
    firsts = firsts.withColumn("_rank", F.row_number().over(Window.orderBy("_file")) - 1)
    place = F.shiftleft(F.col("_rank").cast("bigint"), 33) + F.col("_at") - F.col("_first")
    found = rows.join(F.broadcast(firsts), "_file")
    return found.withColumn("ticket_id", place).drop("_file", "_at", "_first", "_rank")


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    """ticket_id, issue, subject, company; ids follow the names of the files and
    the order in each. "None" reads as no company.
    """
    df = numbered(read_table(spark, path, "_file"))
    return df.select(
        "ticket_id",
        "issue",
        "subject",
        F.when(F.col("company") == "None", "").otherwise(F.col("company")).alias("company"),
    )


def write_output(output: DataFrame, path: str, order_by: str = "ticket_id") -> None:
    """Write the output table as CSV: the expected columns, in input order.

    The sort is a range sort, so the parts follow each other in order.
    """
    typed = output.orderBy(order_by).select([F.col(c).cast("string") for c in fixed.OUTPUT_COLUMNS])
    typed.write.options(**WRITTEN).csv(path)


def tickets_from_turns(turns: DataFrame, ids=("conv_id", "turn", "role", "text")) -> DataFrame:
    """Tickets (ticket_id, conv_id, issue) from one row per turn.

    One conversation is one ticket and one row, whole, however long it is: rules
    and prompts look at all of it.
    """
    conv, turn, role, text = (F.col(c) for c in ids)
    rows = turns.select(
        conv.alias("conv_id"),
        F.struct(turn.alias("turn"), role.alias("role"), text.alias("content")).alias("entry"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    messages = F.transform("entries", lambda e: F.struct(e["role"].alias("role"), e["content"].alias("content")))
    return grouped.select(
        F.col("conv_id").cast("string").alias("ticket_id"),
        "conv_id",
        F.to_json(messages).alias("issue"),
    )


def clean_inputs(tickets: DataFrame) -> DataFrame:
    """Trim the three inputs; a missing one is ""."""
    inputs = {c: t.null_safe(F.col(c)) for c in ("issue", "subject", "company") if c in tickets.columns}
    return tickets.withColumns(inputs)
