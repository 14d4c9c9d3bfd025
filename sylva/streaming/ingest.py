"""Streaming ingestion: new JSON lines are embedded and appended to a vector table as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sylva.operators.clients import embed


def read_lines(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """row_id (a hash of the text) and text of JSON lines in files that appear in a folder."""
    text = F.get_json_object("value", f"$['{key}']")
    return spark.readStream.text(folder).select(text.alias("text")).where("text is not null").select(F.xxhash64("text").alias("row_id"), "text")


def append_vectors(lines: DataFrame, embedder: Callable[[str], list[float] | None], table: str, checkpoint: str) -> StreamingQuery:
    """Append row_id, text, vector to a Parquet table, exactly once per input row."""
    return embed(lines, embedder).drop("retries").writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key, with rows later than the watermark left out."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select("window.start", key, "n")
