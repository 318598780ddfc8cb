"""Incremental runs: new documents pass the per-document operators as they arrive. An extension; all these operators are stateless across batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_documents(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Applies an operator to every batch and appends its rows to a Parquet folder, one subfolder a batch, so that a repeated batch overwrites its own."""

    def write(batch: DataFrame, n: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events (ts, event_type) counted by tumbling window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("_w"), "event_type").agg(F.count("*").alias("n")).select(F.col("_w.start").alias("start"), "event_type", "n")
