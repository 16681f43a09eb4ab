"""Extension: the study's incremental behaviours as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that has no result yet: resume by an anti join on the keys."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def once(results: DataFrame, keys: list[str], event_time: str, late: str = "1 hour") -> DataFrame:
    """Each result once: repeats within the watermark are dropped, and so state stays bounded."""
    return results.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def running_accuracy(results: DataFrame, keys: list[str]) -> DataFrame:
    """n and mean score by condition, for output mode update."""
    return results.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("score").alias("accuracy"))


def windowed_usage(log: DataFrame, event_time: str, window: str, late: str) -> DataFrame:
    """Calls, tokens and failures by event-time window; late rows are taken up to the watermark."""
    seen = log.withWatermark(event_time, late).groupBy(F.window(event_time, window).alias("w"))
    return seen.agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum((F.col("score") == 0).cast("long")).alias("failures")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls", "tokens", "failures")


def append_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet exactly once, and ends when all that is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
