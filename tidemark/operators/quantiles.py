"""Exact quantiles of columns of any size, by narrowing brackets around the wanted ranks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.sinks import kept

#: Up to so many rows a quantile is one aggregate, whose state holds every distinct value; beyond, brackets are narrowed first.
MOST = 2_000_000


def select_rank(x: DataFrame, n: int, rank: int, most: int = MOST) -> float:
    """The value in x (column x, n rows without null) that `rank` rows precede in order. Each pass keeps what lies strictly
    between two approximate quantiles around it; a value that many rows share is an end of the bracket and is found by counting."""
    wide = 1e-3
    while n > most:
        at = [max(0.0, rank / n - wide), min(1.0, rank / n + wide)]
        lo, hi = x.agg(F.percentile_approx("x", at, 10_000)).first()[0]
        c = F.col("x")
        less, upto_lo, less_hi, upto = x.agg(F.count_if(c < lo), F.count_if(c <= lo), F.count_if(c < hi), F.count_if(c <= hi)).first()
        if not less <= rank < upto:
            wide *= 4
        elif rank < upto_lo:
            return lo
        elif rank >= less_hi:
            return hi
        else:
            x, n, rank = x.where((c > lo) & (c < hi)), less_hi - upto_lo, rank - upto_lo
    return x.orderBy("x").offset(rank).first()[0]


def quantiles(df: DataFrame, columns: list[str], at: list[float], most: int = MOST) -> dict[str, list]:
    """Exact quantiles of each column, interpolated between neighbours; None for a column without values."""
    n = df.agg(*[F.count(c) for c in columns]).first()
    few = [c for c, k in zip(columns, n, strict=True) if k <= most]
    out = {}
    if few:
        row = df.agg(*[F.percentile(c, F.array(*[F.lit(float(p)) for p in at])).alias(f"_{i}") for i, c in enumerate(few)]).first()
        out = {c: list(row[i]) if row[i] is not None else [None] * len(at) for i, c in enumerate(few)}
    for c, k in zip(columns, n, strict=True):
        if c in out:
            continue
        x = df.select(F.col(c).cast("double").alias("x")).where("x is not null")
        places = [p * (k - 1) for p in at]
        value = {r: select_rank(x, k, r, most) for r in {f(p) for p in places for f in (math.floor, math.ceil)}}
        out[c] = [value[math.floor(p)] + (p - math.floor(p)) * (value[math.ceil(p)] - value[math.floor(p)]) for p in places]
    return {c: out[c] for c in columns}


def quantiles_by(df: DataFrame, value: str, by: list[str], at: list[float], most: int = MOST) -> DataFrame:
    """By group: n, and q (array) of exact quantiles of the values that aren't null, interpolated between neighbours.

    Up to `most` rows it is one aggregate. Beyond, values are counted, so that a frequent one is one row, and cut into ranges
    of (group, value); a value's rank is its place in its range, offset by the group's counts before. No task holds a group.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    n = rows.count()
    if n <= most:
        return rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("_x", F.array(*[F.lit(float(p)) for p in at])).alias("q"))
    counted = rows.groupBy(*by, "_x").agg(F.count("*").alias("_c"))
    placed = kept(counted.repartitionByRange(-(-n // most), *by, "_x").withColumn("_p", F.spark_partition_id()), "quantiles")
    sums = placed.groupBy("_p", *by).agg(F.sum("_c").alias("_s"))
    before = sums.select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], (F.sum("_s").over(Window.partitionBy(*by).orderBy("_p")) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy(*by)).alias("n"))
    same = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    ranks = placed.withColumn("_upto", F.sum("_c").over(Window.partitionBy("_p", *by).orderBy("_x"))).join(before, same)
    ranks = ranks.withColumn("_upto", F.col("_upto") + F.col("_before"))

    def at_rank(rank):
        return F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank), F.col("_x")))

    places = [F.lit(float(p)) * (F.col("n") - 1) for p in at]
    ends = ranks.groupBy(*by).agg(F.max("n").alias("n"), *[at_rank(f(x)).alias(f"_{e}{i}") for i, x in enumerate(places) for e, f in (("l", F.floor), ("h", F.ceil))])
    return ends.select(*by, "n", F.array(*[F.col(f"_l{i}") + (x - F.floor(x)) * (F.col(f"_h{i}") - F.col(f"_l{i}")) for i, x in enumerate(places)]).alias("q"))
