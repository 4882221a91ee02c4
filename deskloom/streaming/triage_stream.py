"""Triage of ticket files as they arrive: a stateless stream joined to static tables."""

from pyspark.sql import DataFrame, SparkSession, types as T

from deskloom.plans import triage

TICKETS = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("ticket_id", "issue", "subject", "company")]
)


def read_ticket_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Tickets from JSON-lines files dropped into a folder."""
    return spark.readStream.schema(TICKETS).json(folder)


def screened_stream(tickets: DataFrame, companies) -> DataFrame:
    """The row-wise part of the triage; keeps no state and needs no watermark."""
    return triage.screen(tickets, companies)


def start_triage(tickets: DataFrame, out: str, checkpoint: str, index, tools, companies, models=triage.Models()):
    """Run the whole triage on every micro-batch and write it as one folder per batch.

    A batch that is run again overwrites its own folder, so rows are not doubled.
    """
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        rows = triage.triage(batch, index, tools, companies, models)
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return tickets.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
