"""Event streams: windows with watermarks, deduplication, and their batch equivalents. An extension beyond the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Count and sum per window and type; works on streams (give `late`) and on tables."""
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes", late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Activity of a user without a pause of `gap`."""
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("user_id", F.col("w.start").alias("start"), "n", "total")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def read_stream(spark: SparkSession, path: str, per_trigger: int = 10) -> DataFrame:
    """Parquet files of a folder as they arrive; `per_trigger` limits the rate."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
