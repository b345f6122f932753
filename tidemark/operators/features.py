"""Trip features, caps, samples and splits. Every draw is a hash of the row's key, so it repeats in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import draw, share
from tidemark.operators.quantiles import quantiles


def calendar(ts: str) -> dict[str, Column]:
    """hour, weekday (Monday 0), is_weekend, month, year."""
    return {"hour": F.hour(ts), "weekday": F.weekday(ts), "is_weekend": (F.weekday(ts) >= 5).cast("int"), "month": F.month(ts), "year": F.year(ts)}


def minutes_between(start: str, end: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / 6e7


def caps(df: DataFrame, columns: list[str], at: float = 0.99) -> dict[str, float]:
    """Exact upper quantiles."""
    return {c: q[0] for c, q in quantiles(df, columns, [at]).items()}


def capped(df: DataFrame, columns: list[str], at: float = 0.99) -> DataFrame:
    """Columns cut at their quantile, and whether each was."""
    limits = caps(df, columns, at)
    return df.withColumns({f"{c}_capped": (F.col(c) > limits[c]) for c in columns} | {c: F.least(c, F.lit(limits[c])) for c in columns})


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: those of the least draws."""
    return df.orderBy(draw(F.col(key), seed), key).limit(n)


def _by_draw(df: DataFrame, key: str, label: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """df with its draw (_u) and bucket (_b, its first four digits); and by class (_l) and bucket (_c) the rows of the class
    before the bucket (_before) and in all (_n)."""
    u = draw(F.col(key), seed)
    df = df.withColumn("_u", u).withColumn("_b", F.substring(u, 1, 4))
    sums = df.groupBy(label, "_b").count()
    counted = F.sum("count").over(Window.partitionBy(label).orderBy("_b")) - F.col("count")
    return df, sums.select(F.col(label).alias("_l"), F.col("_b").alias("_c"), counted.alias("_before"), F.sum("count").over(Window.partitionBy(label)).alias("_n"))


def _ranked(df: DataFrame, before: DataFrame, key: str, label: str) -> DataFrame:
    """With _k: the row's rank by draw in its class, as its rank in the bucket after the rows of the buckets before. A class
    of any size is 65,536 buckets."""
    joined = df.join(before, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_c")))
    return joined.withColumn("_k", F.col("_before") + F.row_number().over(Window.partitionBy(label, "_b").orderBy("_u", key)))


def cap_per_class(df: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows a class, those of the least draws. Only buckets that begin within the first n rows of a class are ranked."""
    rows, before = _by_draw(df, key, label, seed)
    return _ranked(rows, before.where(F.col("_before") < n), key, label).where(F.col("_k") <= n).select(*df.columns)


def split(df: DataFrame, key: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    return df.withColumn("part", F.when(draw(F.col(key), seed) < share(train), "train").otherwise("test"))


def stratified_split(df: DataFrame, key: str, label: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """In every class the exact share trains, those of the least draws."""
    part = F.when(F.col("_k") <= F.floor(F.col("_n") * train), "train").otherwise("test")
    return _ranked(*_by_draw(df, key, label, seed), key, label).select(*df.columns, part.alias("part"))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Codes of the distinct values in alphabetical order: (value, code), as many rows as classes."""
    values = df.select(F.col(column).alias("value")).distinct()
    return values.select("value", (F.dense_rank().over(Window.orderBy("value")) - 1).alias("code"))


def place_features(place: str = "pickup_place", legacy: bool = False) -> dict[str, Column]:
    """Whether a place is 'lon_lat', its parts, its zone number; legacy: zone numbers also show up as longitudes."""
    is_pair = F.contains(F.col(place), F.lit("_"))
    left, right = F.split_part(F.col(place), F.lit("_"), F.lit(1)).try_cast("double"), F.regexp_extract(place, "(?s)^[^_]*_(.*)$", 1).try_cast("double")
    lon = left if legacy else F.when(is_pair, left)
    return {"pickup_is_lonlat": is_pair.cast("int"), "pickup_lon": F.coalesce(lon, F.lit(0.0)), "pickup_lat": F.coalesce(right, F.lit(0.0)), "pickup_zone_id": F.coalesce(F.col(place).try_cast("double"), F.lit(-1.0))}


def centred(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the mean, and the mean is taken off."""
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(row[c])) - F.lit(row[c]) for c in columns})
