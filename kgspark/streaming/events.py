"""An extension, not a capability of the batch engine: windowed counts of an event stream, late events included up to a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Events as they arrive as Parquet files in a folder."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) for tumbling windows; an event id counts once while it is within the watermark."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    g = once.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def visits(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n) of session windows."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
