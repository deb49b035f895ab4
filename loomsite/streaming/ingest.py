"""Deliveries as a stream: snapshots that arrive late or twice, and counts by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_snapshots(deliveries: DataFrame, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends each micro-batch of deliveries to the Parquet table, partitioned by domain.

    Nothing is dropped on arrival: superseded and repeated deliveries are told apart when the table is read, where the
    row delivered last counts. A batch that is run again writes the same partition of its batch id anew.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("domain").parquet(f"{table}/batch={number}")

    return deliveries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, kind, n): events by time window; later than the watermark they are left out of a stream's result."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))
