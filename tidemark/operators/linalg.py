"""Principal components from one distributed pass of moments, and what is read off the spectrum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def moments(df: DataFrame, columns: list[str], weights: Column | None = None) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """By replicate: n, sums and the matrix of sums of products, in one pass. weights: an array of a weight for each
    replicate; without it there is one replicate, 0. Every task sends its sums alone, which Spark adds up."""
    d = len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: np.ndarray | None = None
        for batch in batches:
            z = np.concatenate([np.ones((len(batch), 1)), batch[columns].to_numpy(float)], axis=1)
            if len(batch):
                w = np.stack(batch["_w"].to_numpy()).astype(float)
                new = np.stack([z.T @ (z * w[:, [b]]) for b in range(w.shape[1])])
                total = new if total is None else total + new
        if total is not None:
            flat = total.reshape(len(total), -1)
            yield pd.DataFrame({"b": np.repeat(np.arange(len(flat)), flat.shape[1]), "k": np.tile(np.arange(flat.shape[1]), len(flat)), "v": flat.reshape(-1)})

    w = F.array(F.lit(1)) if weights is None else weights
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns], w.alias("_w")).mapInPandas(run, "b int, k int, v double")
    out: dict[int, np.ndarray] = {}
    for r in rows.groupBy("b", "k").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["b"], np.zeros((d + 1) ** 2))[r["k"]] = r["v"]
    return {b: (g[0], g[1 : d + 1], g.reshape(d + 1, d + 1)[1:, 1:]) for b, g in sorted(out.items())}


def covariance(n: float, s: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Population covariance (divided by n)."""
    return p / n - np.outer(s / n, s / n)


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components as columns and eigenvalues, largest first; in each component the largest loading is positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1, sign), values


def fit(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components, eigenvalues and means of a table: nulls count as the column's mean."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(means[c])).alias(c) for c in columns])
    # about the means, so that large means cost no precision
    shifted = filled.select(*[(F.col(c) - F.lit(means[c])).alias(c) for c in columns])
    components, values = eigen(covariance(*moments(shifted, columns)[0]))
    return components, values, np.array([means[c] for c in columns], float)


def covariance_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, value) of the population covariance."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.covar_pop(columns[i], columns[j]).alias(f"c_{i}_{j}") for i, j in pairs])
    both = row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c_{i}_{j}").alias("value")) for i, j in pairs])).alias("x"))
    return both.select("x.i", "x.j", "x.value")


def model_tables(spark: SparkSession, components: np.ndarray, values: np.ndarray) -> tuple[DataFrame, DataFrame]:
    rows = [(k + 1, h, float(components[h, k])) for k in range(components.shape[1]) for h in range(components.shape[0])]
    return spark.createDataFrame(rows, "pc int, hour int, loading double"), spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(values)], "pc int, eigenvalue double")


def spectrum(values: DataFrame) -> DataFrame:
    """Ratios, cumulative ratios, gaps, sensitivities (1 / gap, the first five) and broken-stick shares, by component."""
    down, whole = Window.partitionBy().orderBy("pc"), Window.partitionBy()
    df = values.withColumn("ratio", F.col("eigenvalue") / F.sum("eigenvalue").over(whole)).withColumn("cumulative", F.sum("ratio").over(down))
    df = df.withColumn("gap", F.col("eigenvalue") - F.lead("eigenvalue").over(down)).withColumn("relative_gap", F.col("gap") / F.nullif(F.col("eigenvalue"), F.lit(0.0)))
    df = df.withColumn("sensitivity", F.when((F.col("pc") <= 5) & F.col("gap").isNotNull(), F.when(F.col("gap") == 0, F.lit(float("inf"))).otherwise(1 / F.col("gap"))))
    up = Window.partitionBy().orderBy(F.desc("pc"))
    df = df.withColumn("broken_stick", F.sum(1.0 / F.col("pc")).over(up) / F.count("*").over(whole))
    return df.withColumn("significant", F.col("ratio") > F.col("broken_stick"))


def significant_count(values: DataFrame) -> DataFrame:
    """Leading components over the broken stick."""
    first = Window.partitionBy().orderBy("pc")
    return spectrum(values).withColumn("lost", F.sum(F.when(F.col("significant"), 0).otherwise(1)).over(first)).agg(F.count_if(F.col("lost") == 0).alias("n_significant"))


def loading_stats(loadings: DataFrame) -> DataFrame:
    """By component: spread, skewness, kurtosis, the hour of the largest loading, hours of clear positive and negative loadings."""
    top = F.max(F.abs("loading")).over(Window.partitionBy("pc"))
    df = loadings.withColumn("_top", top)
    up, down = F.col("loading") > 0.05 * F.col("_top"), F.col("loading") < -0.05 * F.col("_top")
    return df.groupBy("pc").agg(F.avg("loading").alias("mean"), F.stddev_pop("loading").alias("std"), F.skewness("loading").alias("skew"), F.kurtosis("loading").alias("excess_kurtosis"), F.max_by("hour", F.abs("loading")).alias("peak_hour"), F.min(F.when(up, F.col("hour"))).alias("first_up"), F.max(F.when(up, F.col("hour"))).alias("last_up"), F.min(F.when(down, F.col("hour"))).alias("first_down"), F.max(F.when(down, F.col("hour"))).alias("last_down"))


def project(df: DataFrame, columns: list[str], components: np.ndarray, means: np.ndarray, k: int) -> DataFrame:
    """Scores pc1..pck as linear expressions over the centred columns."""
    def score(j: int):
        out = F.lit(0.0)
        for c, m, w in zip(columns, means, components[:, j], strict=True):
            out = out + (F.coalesce(F.col(c).cast("double"), F.lit(float(m))) - F.lit(float(m))) * F.lit(float(w))
        return out

    return df.withColumns({f"pc{j + 1}": score(j) for j in range(k)})


def affinity(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a subspace that another holds: 1 if they are the same."""
    return float(np.square(a.T @ b).sum() / a.shape[1])


def procrustes(a: np.ndarray, b: np.ndarray) -> float:
    """Distance of orthonormal bases after the best rotation."""
    return float(np.sqrt(max(0.0, 2 * a.shape[1] - 2 * np.linalg.svd(b.T @ a, compute_uv=False).sum())))


def correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = a - a.mean(0), b - b.mean(0)
    return np.abs((x * y).sum(0) / np.sqrt(np.square(x).sum(0) * np.square(y).sum(0)))
