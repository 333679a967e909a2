"""Streams: mentions by window, duplicates dropped within a watermark, documents as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, folder: str, schema: StructType | str, files: int = 4) -> DataFrame:
    """Parquet files of a folder as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def mention_counts(events: DataFrame, by: str, ts: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each key and window; windows close when the watermark passes them."""
    counted = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    counted = counted.groupBy(F.window(ts, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), by, "n")


def sliding_mentions(events: DataFrame, by: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events of each key in the 24 hours up to every full hour (J11); ``operators.indexing.recent_mentions`` has them up to each event."""
    counted = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    counted = counted.groupBy(F.window(ts, "24 hours", "1 hour").alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.end").alias("until"), by, "n")


def activity(events: DataFrame, by: str, ts: str = "ts", every: int = 50) -> DataFrame:
    """Each session's last event, and whether its number of events calls for a reflection."""
    n = F.count(F.lit(1))
    return events.groupBy(by).agg(F.max(ts).alias("last"), ((n >= every) & (n % every == 0)).alias("reflect"))


def first_messages(messages: DataFrame, session: str, text: str, ts: str = "ts", prefix: int = 50, late: str = "1 hour") -> DataFrame:
    """A message for each session and first characters (J3); in a stream, state is kept as long as the watermark."""
    keyed = messages.where(F.trim(text) != "").withColumn("prefix", F.substring(text, 1, prefix))
    if messages.isStreaming:
        return keyed.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([session, "prefix"])
    return keyed.dropDuplicates([session, "prefix"])


def documents_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files with their MD5 as they appear; hidden and other files aside."""
    held = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(held).option("pathGlobFilter", "*.{pdf,docx,md,markdown}").load(folder)
    return files.select("path", "modificationTime", "length", F.md5("content").alias("file_hash"), "content")


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is by now, once."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
