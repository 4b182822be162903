"""Temporal constraints over streams: late or missing followers of an event, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late_followers(earlier: DataFrame, later: DataFrame, key: str, within: str, lateness: str = "1 day") -> DataFrame:
    """Pairs of a key whose later event comes before its earlier one, both within `within` of each other.

    earlier and later are streams (or tables) of key and ts. The bound on both sides lets Spark drop state behind the watermark.
    """
    a = earlier.select(F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("a")).withWatermark("a", lateness)
    b = later.select(F.col(key).alias("other"), F.col("ts").cast("timestamp").alias("b")).withWatermark("b", lateness)
    near = (F.col("b") < F.col("a")) & (F.col("b") >= F.col("a") - F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col("key") == F.col("other")) & near).select("key", "a", "b")


def windowed_counts(events: DataFrame, window: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Events per type and tumbling window; rows later than the watermark are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def missing_followers(earlier: DataFrame, later: DataFrame, key: str, within: str, lateness: str = "1 day") -> DataFrame:
    """key, a: earlier events of a key that no later event follows within `within` (both ends included).

    Over streams a row is told once the watermark has passed the end of its time, so that no follower can come any more; late
    rows beyond `lateness` are dropped. Over tables it is told at once. Null keys have no followers and are not told.
    """
    a = earlier.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("a")).withWatermark("a", lateness)
    b = later.select(F.col(key).alias("other"), F.col("ts").cast("timestamp").alias("b")).withWatermark("b", lateness)
    follows = (F.col("b") >= F.col("a")) & (F.col("b") <= F.col("a") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col("key") == F.col("other")) & follows, "left_outer").where("other IS NULL").select("key", "a")


def write_available(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Takes all input that is there, writes rows as Parquet, and stops; a later call goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
