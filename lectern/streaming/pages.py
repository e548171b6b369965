"""Streams of arriving pages and events; an addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.files import PAGE


def page_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Pages from JSON-lines files as they arrive."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", max_files).json(folder)


def first_versions(pages: DataFrame, arrived: str, delay: str = "1 day") -> DataFrame:
    """Each (book, page, text) once within the watermark, so state stays bounded."""
    hashed = pages.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    return hashed.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(["book", "page_num", "text_hash"])


def weekly_counts(events: DataFrame, ts: str, concept: str, delay: str = "2 days") -> DataFrame:
    """Events per concept and tumbling week; weeks close behind the watermark."""
    return (
        events.withWatermark(ts, delay).groupBy(F.window(ts, "7 days", startTime="4 days"), concept)
        .agg(F.count("*").alias("n")).select(F.col("window.start").alias("week_start"), concept, "n")
    )


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process what is there and stop; a rerun goes on where it ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
