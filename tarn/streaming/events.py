"""Windowed counts over a stream of events, with late data bounded by a watermark.

The same aggregation runs over a batch (`windowed`) and over a stream of files
(`stream`); the dialect itself has no streaming statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def windowed(events: DataFrame, *, size: str = "1 hour", slide: str | None = None, keys: tuple[str, ...] = ("event_type",), late: str = "10 minutes") -> DataFrame:
    """Counts and sums of `value` per window of `ts` and keys."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", size, slide or size), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def stream(spark: SparkSession, folder: str, schema: StructType, *, per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream, in the order they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def to_table(df: DataFrame, name: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Runs a stream to its present end into a table of the memory sink, for tests and inspection."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
