"""The long count table over a stream: late rows are taken up to a delay, then an hour is closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(trips: DataFrame, keys: list[str], delay: str = "2 hours") -> DataFrame:
    """trips: a streaming (or batch) DataFrame with event time ts. State is one count for each open key and hour."""
    rows = trips.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), *keys).agg(F.count("*").alias("count")).select(*keys, F.col("w.start").alias("hour_start"), "count")
