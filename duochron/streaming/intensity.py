"""Streaming intensity sums per angle and time window; late events within the watermark still count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, glob: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").option("pathGlobFilter", glob).parquet(path)


def windowed_intensity(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window start, event_type, cents, n): tumbling windows, state dropped behind the watermark."""
    cents = F.round(F.col("value") * 100).cast("long")
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), "event_type", "cents", "n")
