"""Incremental ingest: the CSV converter as a Structured Streaming job."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.sources import csv_rows


def ingest_csv(spark: SparkSession, folder: str, schema: T.StructType, target: str, checkpoint: str, multi_line: bool = True) -> StreamingQuery:
    """Converts the CSV files that are new since the last run, exactly once, as the batch converter does, then stops."""
    rows = csv_rows(spark.readStream, folder, schema, multi_line)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
