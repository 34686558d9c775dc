"""Structured Streaming front end: shift totals by event time, and files of orders linked as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_totals(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts and sums a type and day; of a stream the days close once the watermark has passed."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("at", late)
    return e.groupBy("event_type", F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "total")


def link_files(spark: SparkSession, folder: str, schema, link: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Runs ``link`` over each micro-batch of Parquet files in a folder; a batch that runs again overwrites its own part."""
    lines = spark.readStream.schema(schema).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        link(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
