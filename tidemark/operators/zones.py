"""Scores by place, joins with zone coordinates, file pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import linalg
from tidemark.operators.wide import HOURS


def means(table: DataFrame, place: str = "pickup_place") -> DataFrame:
    return table.groupBy(place).agg(*[F.avg(c).alias(c) for c in HOURS])


def scores(table: DataFrame, k: int = 2, place: str = "pickup_place") -> DataFrame:
    """pc1..pck of each place: means first, projection after, which is the same and reads fewer rows."""
    components, _, centre = linalg.fit(table, HOURS)
    return linalg.project(means(table, place), HOURS, components, centre, k).select(place, *[f"pc{i + 1}" for i in range(k)])


def scores_of(table: DataFrame, loadings: DataFrame, k: int = 2, place: str = "pickup_place") -> DataFrame:
    """Like scores, on a stored basis (pc, hour, loading: 24 x 24 rows)."""
    basis = np.zeros((len(HOURS), len(HOURS)))
    for r in loadings.collect():
        basis[r["hour"], r["pc"] - 1] = r["loading"]
    row = table.agg(*[F.avg(c).alias(c) for c in HOURS]).first()
    return linalg.project(means(table, place), HOURS, basis, np.array([row[c] or 0.0 for c in HOURS]), k).select(place, *[f"pc{i + 1}" for i in range(k)])


def markers(scored: DataFrame, zones: DataFrame, most: int = 100_000) -> DataFrame:
    """Map markers: colour position on a symmetric scale of pc1, radius 3 + 9 |pc2| / max. Broadcasts zones up to `most` rows."""
    small = zones.limit(most + 1).count() <= most
    df = scored.join(F.broadcast(zones) if small else zones, "pickup_place")
    top = df.agg(F.max(F.abs("pc1")), F.max(F.abs("pc2"))).first()
    if top[0] is None:
        raise ValueError("no place has coordinates")
    return df.select("pickup_place", "lat", "lon", "pc1", "pc2", (0.5 + F.col("pc1") / (2 * (top[0] or 1.0))).alias("colour"), (3 + 9 * F.abs("pc2") / (top[1] or 1.0)).alias("radius"))


def matched_pair(files: DataFrame, a: str = "yellow", b: str = "green") -> DataFrame:
    """The earliest month that both types have, else the pair whose years are nearest (the first, in path order)."""
    left = files.where((F.col("taxi_type") == a) & F.col("year").isNotNull()).select("year", "month", F.col("path").alias("path_a"))
    right = files.where((F.col("taxi_type") == b) & F.col("year").isNotNull()).select("year", "month", F.col("path").alias("path_b"))
    same = left.join(right, ["year", "month"]).orderBy("year", "month", "path_a", "path_b").limit(1)
    if not same.isEmpty():
        return same.select("path_a", "path_b")
    return nearest_pair(left, right)


def nearest_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nearest years. Years are few: the closest one of `right` is found for each year of `left`, files follow by equality."""
    years = sorted(r[0] for r in right.select("year").distinct().collect())
    mine = sorted(r[0] for r in left.select("year").distinct().collect())
    if not years or not mine:
        return left.sparkSession.createDataFrame([], "path_a string, path_b string")
    gap = min(abs(x - y) for x in mine for y in years)
    pairs = left.sparkSession.createDataFrame([(x, y) for x in mine for y in years if abs(x - y) == gap], "ya int, yb int")
    rows = left.join(F.broadcast(pairs), F.col("year") == F.col("ya")).select("path_a", "yb").join(right.select(F.col("year").alias("yb"), "path_b"), "yb")
    return rows.orderBy("path_a", "path_b").limit(1).select("path_a", "path_b")
