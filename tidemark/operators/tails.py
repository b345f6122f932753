"""Tail statistics. Ordered statistics of large columns go through ranks that no single task computes."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.features import sample_n
from tidemark.operators.quantiles import quantiles, quantiles_by
from tidemark.sources.sinks import kept


#: Rows of a range, on average.
RANGE_ROWS = 2_000_000


def ranked(df: DataFrame, value: str, key: str, rows_a_range: int = RANGE_ROWS) -> DataFrame:
    """x, key, rank (1 is the least) and n. Rows are cut into ranges of (x, key), so that equal values spread too, and sorted
    within them; a row's place in its range is offset by the counts of the ranges before it. No window runs over the rows."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"), F.col(key).alias("key"))
    ranges = max(1, -(-rows.count() // rows_a_range))
    placed = rows.repartitionByRange(ranges, "x", "key").sortWithinPartitions("x", "key").withColumn("id", F.monotonically_increasing_id())
    placed = kept(placed, "ranked").select("x", "key", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("place"))
    sums = placed.groupBy("part").count()
    before = sums.select("part", F.coalesce(F.sum("count").over(Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy()).alias("n"))
    return placed.join(F.broadcast(before), "part").select("x", "key", (F.col("before") + F.col("place") + 1).alias("rank"), "n")  # a row for RANGE_ROWS


def survival(df: DataFrame, value: str, key: str) -> DataFrame:
    """P(X >= x) by rank: equal values each have their own."""
    return ranked(df, value, key).select("key", "x", ((F.col("n") - F.col("rank") + 1) / F.col("n")).alias("p"))


def tail_alpha(df: DataFrame, value: str, key: str, percentile: float = 0.9) -> DataFrame:
    """Exponent and R2 of log P against log x over the tail: above the percentile, or the 80th where that leaves under 10; none under 5."""
    x = df.where((F.col(value) > 0) & ~F.isnan(F.col(value).cast("double")))
    q = quantiles(x, [value], [percentile, 0.8])[value]
    if q[0] is None:
        return df.sparkSession.createDataFrame([(0, None, None)], "n_tail long, alpha double, r2 double")
    high = x.agg(F.count_if(F.col(value) >= q[0])).first()[0]
    tail = survival(x.where(F.col(value) >= (q[0] if high >= 10 else q[1])), value, key)
    fit = tail.agg(F.count("*").alias("n_tail"), F.regr_slope(F.ln("p"), F.ln("x")).alias("slope"), F.regr_r2(F.ln("p"), F.ln("x")).alias("r2"))
    enough = F.col("n_tail") >= 5
    return fit.select("n_tail", F.when(enough, -F.col("slope")).alias("alpha"), F.when(enough, F.col("r2")).alias("r2"))


def hill(df: DataFrame, value: str, key: str, low: int = 10, high: int | None = None) -> DataFrame:
    """(k, alpha) for k from low to high: reciprocal of the mean log excess over the (k+1)-th largest. Only the k + 1 largest rows are sorted."""
    x = df.where(F.col(value) > 0)
    n = x.count()
    high = min(n // 2, 200) if high is None else high
    top = x.orderBy(F.desc(value), key).limit(high + 1).select(F.ln(F.col(value).cast("double")).alias("l"), F.col(key).alias("key"))
    w = Window.partitionBy().orderBy(F.desc("l"), "key")
    rows = top.select(F.row_number().over(w).alias("k"), F.avg("l").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("m"), F.lead("l").over(w).alias("next"))
    return rows.where((F.col("k") >= low) & (F.col("k") <= high) & F.col("next").isNotNull()).select("k", F.when(F.col("m") > F.col("next"), 1 / (F.col("m") - F.col("next"))).alias("alpha"))


def hill_plateau(curve: DataFrame) -> DataFrame:
    """Median and quartiles of the middle half of the curve; the curve has at most a few hundred rows."""
    w = Window.partitionBy()
    rows = curve.withColumn("i", F.row_number().over(w.orderBy("k")) - 1).withColumn("n", F.count("*").over(w))
    middle = rows.where((F.col("i") >= F.floor(F.col("n") / 4)) & (F.col("i") < F.floor(3 * F.col("n") / 4)))
    return middle.agg(F.percentile("alpha", 0.5).alias("median"), F.percentile("alpha", 0.25).alias("q25"), F.percentile("alpha", 0.75).alias("q75"))


def describe(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.lit(quantiles(df, [value], [0.5])[value][0]).cast("double").alias("median"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("excess_kurtosis"))


SUMMARY = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "ci_lower": 0.025, "ci_upper": 0.975}


def summary(df: DataFrame, value: str, by: list[str] | None = None, listed: bool = False) -> DataFrame:
    """Mean, spread and percentiles of finite values. listed: with the sorted values themselves, for figures of a few replicates."""
    x, by = F.col(value), by or []
    finite = df.where(x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) != float("inf")))
    named = finite.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), *([F.sort_array(F.collect_list(value)).alias("values")] if listed else []))
    if by:
        q = quantiles_by(finite, value, by, list(SUMMARY.values())).select(*[F.col(c).alias(f"_{c}") for c in by], "q")
        same = F.lit(True)
        for c in by:
            same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        named = named.join(q, same)
        found = {c: F.col("q")[i] for i, c in enumerate(SUMMARY)}
    else:
        found = {c: F.lit(v).cast("double") for c, v in zip(SUMMARY, quantiles(finite, [value], list(SUMMARY.values()))[value], strict=True)}
    return named.select(*by, "mean", "std", "min", "max", *[c.alias(n) for n, c in found.items()], *(["values"] if listed else []))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Density by bin over the range; the largest value is in the last bin."""
    lo, hi, n = df.agg(F.min(value), F.max(value), F.count(value)).first()
    if not n:
        return df.sparkSession.createDataFrame([], "bin long, n long, density double")
    width = (hi - lo) / bins or 1.0
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1))
    return df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).withColumn("density", F.col("n") / F.lit(n * width))


def boxplot(df: DataFrame, value: str, by: str) -> DataFrame:
    rows = quantiles_by(df, value, [by], [0.25, 0.5, 0.75])
    return rows.select(by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def qq_points(df: DataFrame, value: str, key: str) -> DataFrame:
    """x against normal quantiles at Filliben's positions."""
    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        inv = NormalDist().inv_cdf
        return p.map(inv)

    rows = ranked(df, value, key)
    edge = F.pow(F.lit(0.5), 1 / F.col("n"))
    p = F.when(F.col("rank") == F.col("n"), edge).when(F.col("rank") == 1, 1 - edge).otherwise((F.col("rank") - 0.3175) / (F.col("n") + 0.365))
    return rows.select("key", "x", quantile(p).alias("theoretical"))


def qq_fit(points: DataFrame) -> DataFrame:
    """Slope, intercept and correlation of the line through the points of `qq_points`."""
    return points.agg(F.regr_slope("x", "theoretical").alias("slope"), F.regr_intercept("x", "theoretical").alias("intercept"), F.corr("x", "theoretical").alias("r"))


#: Royston's form holds for so many values; of more, a sample of this size is tested.
SHAPIRO_ROWS = 5000


def shapiro_of(df: DataFrame, value: str, key: str, seed: int = 42) -> tuple[float, float]:
    """W and p of a column: of all values up to SHAPIRO_ROWS, of a seeded sample without replacement beyond."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"), F.col(key).alias("key"))
    return shapiro(np.array([r["x"] for r in sample_n(rows, "key", SHAPIRO_ROWS, seed).select("x").collect()]))


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """W and p by Royston (1995), for 12 to 5000 values (4 to 11 values: his small-sample form)."""
    x = np.sort(np.asarray(x, float))
    n, inv = len(x), NormalDist().inv_cdf
    if n < 4 or x[0] == x[-1]:
        return (1.0, 1.0)
    m = np.array([inv((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, c = 1 / np.sqrt(n), m / np.sqrt(m @ m)
    last = c[-1] + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0], u)
    a = np.empty(n)
    if n > 5:
        second = c[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
        phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a[2:-2] = m[2:-2] / np.sqrt(phi)
        a[1], a[-2] = -second, second
    else:
        phi = (m @ m - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a[1:-1] = m[1:-1] / np.sqrt(phi)
    a[0], a[-1] = -last, last
    w = float((a @ x) ** 2 / np.square(x - x.mean()).sum())
    w, ln = min(w, 1.0), np.log(n)
    if n <= 11:
        g = -2.273 + 0.459 * n
        y = -np.log(max(g - np.log(max(1 - w, 1e-300)), 1e-300))
        mu, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), np.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y = np.log(max(1 - w, 1e-300))
        mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), np.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, float(1 - NormalDist().cdf((y - mu) / sd))


#: heavy: a power law fits, and the values aren't normal by kurtosis or test; light otherwise.
TAIL = "case when not coalesce(r2 >= 0.9 and alpha > 0, false) then 'light' when excess_kurtosis > 0 then 'heavy' when shapiro_p < 0.05 then 'heavy' else 'light' end"


def tail_class(report: DataFrame) -> DataFrame:
    """The report (alpha, r2, excess_kurtosis, shapiro_p; nulls speak for light) with the class of its tail."""
    return report.withColumn("tail", F.expr(TAIL))


REPORT = "shapiro_w double, shapiro_p double, alpha double, r2 double, excess_kurtosis double"


def tail_report(spark: SparkSession, x: np.ndarray) -> DataFrame:
    """Normality, exponent and class of a few hundred numbers, by their absolute values: one row."""
    x = np.asarray(x, float).reshape(-1)
    w, p = shapiro(x)
    fit = tail_alpha(spark.createDataFrame([(i, float(abs(v))) for i, v in enumerate(x)], "i long, v double"), "v", "i").first()
    spread = x.std()
    kurtosis = float((((x - x.mean()) / spread) ** 4).mean() - 3) if spread else 0.0
    return tail_class(spark.createDataFrame([(w, p, fit["alpha"], fit["r2"], kurtosis)], REPORT))
