"""Event figures per time window, on a stream or on a stored table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmart.schemas import AMOUNT


def window_totals(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Events and value per window and event type.

    On a stream, windows are final once the watermark has passed them; the state then
    holds one row per open window and type. Counts and sums combine before the shuffle.
    """
    if events.isStreaming:
        # A watermark needs a timestamp with a time zone.
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return (
        events.groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast(AMOUNT)).alias("value"))
        .select(F.col("window.start").alias("window_start"), "event_type", "events", "value")
    )
