"""Long counts and the wide table (keys x hour_0..hour_23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOURS = [f"hour_{h}" for h in range(24)]


def counts(trips: DataFrame, keys: list[str]) -> DataFrame:
    """Rides by keys and hour; trips without a time are left out."""
    return trips.where("ts is not null").groupBy(*keys, F.hour("ts").alias("hour")).agg(F.count("*").alias("count"))


def wide(trips: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key, 24 counts: one aggregation, one shuffle of partial rows, no pivot pass."""
    hour = F.hour("ts")
    return trips.where("ts is not null").groupBy(*keys).agg(*[F.count_if(hour == h).alias(c) for h, c in enumerate(HOURS)])


def pivoted(long: DataFrame, keys: list[str], hour: str = "hour", count: str = "count") -> DataFrame:
    """Wide from rows that are counted already; hours that don't occur are 0."""
    return long.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col(hour) == h, F.col(count))), F.lit(0)).cast("bigint").alias(c) for h, c in enumerate(HOURS)])


def combine(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Wide tables summed by key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in HOURS])


def total() -> Column:
    out = F.col(HOURS[0])
    for c in HOURS[1:]:
        out = out + F.col(c)
    return out


def cleaned(table: DataFrame, min_rides: int = 50) -> DataFrame:
    """Rows of min_rides rides or more."""
    return table.where(total() >= min_rides)


def cleanup_stats(table: DataFrame, min_rides: int = 50) -> DataFrame:
    good = total() >= min_rides
    return table.agg(F.count("*").alias("rows_before"), F.count_if(good).alias("rows_after"), F.count_if(~good).alias("rows_removed"), F.coalesce(F.sum(F.when(~good, total())), F.lit(0)).alias("rides_dropped"))


def by_file(trips: DataFrame, keys: list[str], min_rides: int = 50) -> DataFrame:
    """Cleaned in each file before files are combined: a key that two files share is judged twice."""
    return combine([cleaned(wide(trips, [*keys, "path"]), min_rides).drop("path")], keys)


def proportions(table: DataFrame) -> DataFrame:
    """Hours as shares of the row; rows without rides are left out."""
    return table.withColumn("_n", total()).where("_n > 0").withColumns({c: F.col(c) / F.col("_n") for c in HOURS}).drop("_n")


def unpivoted(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.unpivot(keys, HOURS, "hour_name", "value").select(*keys, F.substring("hour_name", 6, 2).cast("int").alias("hour"), "value")
