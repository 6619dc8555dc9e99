"""An extension: form counts and event panels kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X


def event_windows(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of events by window and type; rows later than the watermark allows are left out."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by event_id once within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def form_counts(documents: DataFrame, script: X.Script = X.LATIN) -> DataFrame:
    """Running form frequencies."""
    return documents.select(F.explode(X.tokens(F.col("text"), script)).alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("n"))
