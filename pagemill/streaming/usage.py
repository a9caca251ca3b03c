"""Continuous daily counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators.usage import UsageTotals

EVENTS = (
    T.StructType()
    .add("event_id", "long")
    .add("ts", "timestamp_ntz")
    .add("user_id", "long")
    .add("event_type", "string")
    .add("value", "double")
    .add("props", "string")
)


def totals(spark: SparkSession, out: str) -> UsageTotals:
    return UsageTotals(spark, f"{out}/counters")


def start_daily(
    spark: SparkSession, path: str, out: str, files_per_batch: int = 100, pause: str | None = None
) -> StreamingQuery:
    """Add the events of every micro-batch to the stored counters of their days.

    The counters are the state: no event is too late to count, and a replayed batch replaces its own rows.
    """
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    def add(rows: DataFrame, batch: int) -> None:
        totals(spark, out).add(rows.select("user_id", "ts", F.floor("value").alias("tokens")), batch)

    writer = events.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/checkpoint")
    writer = writer.trigger(processingTime=pause) if pause else writer.trigger(availableNow=True)
    return writer.start()


def read_daily(spark: SparkSession, out: str) -> DataFrame:
    """The counters of every user and day."""
    return totals(spark, out).daily().select("user_id", "date", "queries", "tokens")
