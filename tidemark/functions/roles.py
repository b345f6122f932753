"""Which column plays which role: resolved from names, before a plan exists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

# Column names by role, in order of preference.
DATETIME_NAMES = ("tpep_pickup_datetime", "lpep_pickup_datetime", "pickup_datetime", "pickupdatetime", "pick_up_datetime", "trip_pickup_datetime", "start_datetime", "pickup_date", "pickup_date_time", "request_datetime")
LOCATION_NAMES = ("pulocationid", "pickup_location_id", "pu_location_id", "pickup_location", "pulocation")
LONGITUDE_NAMES = ("pickup_longitude", "pickup_long", "start_lon", "start_longitude")
LATITUDE_NAMES = ("pickup_latitude", "pickup_lat", "start_lat", "start_latitude")
ZONE_ID_NAMES = ("pickup_place", "pulocationid", "locationid", "zone_id", "zoneid")
ZONE_LAT_NAMES = ("lat", "latitude", "y", "centroid_lat", "center_lat")
ZONE_LON_NAMES = ("lon", "lng", "longitude", "x", "centroid_lon", "centroid_lng", "center_lon", "center_lng")
COUNT_NAMES = ("count", "rides", "n")
TYPE_NAMES = ("taxi_type", "taxi", "cab_type", "service_type", "taxitype")
# Canonical trip columns and what they are called.
TRIP_NAMES = {
    "pickup_datetime": ("tpep_pickup_datetime", "lpep_pickup_datetime", "trip_pickup_datetime", "pickup_datetime"),
    "dropoff_datetime": ("tpep_dropoff_datetime", "lpep_dropoff_datetime", "trip_dropoff_datetime", "dropoff_datetime"),
    "trip_distance": ("trip_distance", "trip_miles"),
    "passenger_count": ("passenger_count",),
    "fare_amount": ("fare_amount", "fare_amt"),
}


def named(columns: Iterable[str], names: Iterable[str]) -> str | None:
    """The first column, by order of names, that is called so; case and outer blanks don't matter."""
    own: dict[str, str] = {}
    for c in columns:
        own.setdefault((c or "").strip().lower(), c)
    return next((own[n] for n in names if n in own), None)


def holding(columns: Iterable[str], every: Iterable[str], some: Iterable[str]) -> str | None:
    """The first column whose name holds all of `every` and one of `some`."""
    every, some = tuple(every), tuple(some)
    return next((c for c in columns if all(x in c.strip().lower() for x in every) and any(x in c.strip().lower() for x in some)), None)


def pickup_datetime(columns: list[str]) -> str | None:
    return named(columns, DATETIME_NAMES) or holding(columns, ["pickup"], ["datetime", "date", "time"])


def pickup_location(columns: list[str]) -> str | None:
    return named(columns, LOCATION_NAMES) or holding(columns, ["pickup"], ["location", "zone", "borough"])


def pickup_lon_lat(columns: list[str]) -> tuple[str, str] | None:
    lon = named(columns, LONGITUDE_NAMES) or holding(columns, ["pickup"], ["long"])
    lat = named(columns, LATITUDE_NAMES) or holding(columns, ["pickup"], ["lat"])
    return (lon, lat) if lon and lat else None


def zone_columns(columns: list[str]) -> tuple[str | None, str | None, str | None]:
    return named(columns, ZONE_ID_NAMES), named(columns, ZONE_LAT_NAMES), named(columns, ZONE_LON_NAMES)


def count_column(df: DataFrame) -> str | None:
    """Of rows that are counted already: the count, or else the last numeric column."""
    numeric = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
    return named(df.columns, COUNT_NAMES) or (numeric[-1] if numeric else None)


def canonical_trips(df: DataFrame, needed: Iterable[str] = tuple(TRIP_NAMES)) -> DataFrame:
    """Columns lower-cased, known ones renamed; KeyError names what is missing."""
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    found = {k: named(df.columns, v) for k, v in TRIP_NAMES.items()}
    if missing := sorted(set(needed) - {k for k, v in found.items() if v}):
        raise KeyError(f"missing columns: {missing}")
    return df.withColumnsRenamed({v: k for k, v in found.items() if v})


def repaired_keys(df: DataFrame) -> DataFrame:
    """Names that an index was saved under (__index_level_N__), or other names of the type, to the three keys."""
    levels = sorted((c for c in df.columns if c.startswith("__index_level_")), key=lambda c: int("".join(filter(str.isdigit, c)) or 0))
    df = df.withColumnsRenamed(dict(zip(levels, ("taxi_type", "date", "pickup_place"), strict=False)))
    kind = named(df.columns, TYPE_NAMES)
    return df.withColumnRenamed(kind, "taxi_type") if kind and "taxi_type" not in df.columns else df
