"""Bootstrap by hash draws: the same replicates in every run and engine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.draws import dealt, gathered, poisson_weights, prefix
from tidemark.functions.scalars import draw_int, poisson
from tidemark.operators import linalg


def drawn(df: DataFrame, key: str, value: str, replicates: int, seed: int = 42) -> DataFrame:
    """(b, value): exact resampling with replacement. Row ids come from a rank over the key; for small tables (rows x replicates)."""
    from tidemark.operators.tails import ranked

    n = df.count()
    rows = ranked(df.select(F.col(key).cast("double").alias("_x"), F.col(value).alias(value)), "_x", value).select((F.col("rank") - 1).alias("i"), F.col("key").alias("value"))
    spark = df.sparkSession
    draws = spark.range(replicates * n).select(F.floor(F.col("id") / n).alias("b"), F.pmod(F.col("id"), F.lit(n)).alias("d"))
    return draws.withColumn("i", F.pmod(draw_int(F.col("b").cast("string"), F.col("d").cast("string"), seed), F.lit(n))).join(rows, "i").select("b", "value")


def mean_ci(df: DataFrame, key: str, value: str, replicates: int = 100, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean over replicates with Poisson(1) weights. A task sends a pair of sums a replicate."""
    suffixes = [f"{b}:{seed}" for b in range(replicates)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights, rows, known = np.zeros(replicates), np.zeros(replicates, np.int64), 0, 0
        for t in gathered(batches):
            x, w = t.column(1), poisson_weights(t.column(0), suffixes)
            rows, known = rows + len(x), known + len(x) - x.null_count
            x = x.fill_null(0.0).to_numpy()
            for b in range(replicates):
                sums[b] += w[b].astype(float) @ x
                weights[b] += w[b].sum(dtype=np.int64)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(replicates), pa.int32()), pa.array(sums if known else [None] * replicates, pa.float64()), pa.array(weights)], ["b", "s", "w"])

    rows = dealt(df.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"))).select(prefix("_k").alias("_p"), "_v")
    means = rows.mapInArrow(run, "b int, s double, w bigint").groupBy("b").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    return means.agg(F.count("*").alias("replicates"), F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("ci_lower"), F.percentile("m", 0.975).alias("ci_upper"))


def pca_stability(df: DataFrame, columns: list[str], key: str, replicates: int = 100, k: int = 2, seed: int = 42) -> tuple[pd.DataFrame, np.ndarray]:
    """By replicate: affinity, procrustes, corr_1..corr_k against the whole table's components; and the replicates' first two, sign-aligned.

    One aggregation makes the moments of all replicates; each is a few hundred numbers.
    """
    base, _, means = linalg.fit(df, columns)
    shifted = df.select(key, *[(F.coalesce(F.col(c).cast("double"), F.lit(float(m))) - F.lit(float(m))).alias(c) for c, m in zip(columns, means, strict=True)])
    weights = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda b: poisson(F.col(key).cast("string"), b.cast("string"), seed))
    out, kept = [], []
    for b, sums in linalg.moments(shifted, columns, weights).items():
        comp, _ = linalg.eigen(linalg.covariance(*sums))
        comp = comp[:, :k] * np.where((comp[:, :k] * base[:, :k]).sum(0) < 0, -1, 1)
        out.append((b, linalg.affinity(base[:, :k], comp), linalg.procrustes(base[:, :k], comp), *linalg.correlations(base[:, :k], comp)))
        kept.append(comp)
    return pd.DataFrame(out, columns=["b", "affinity", "procrustes", *[f"corr_{i + 1}" for i in range(k)]]), np.array(kept)


# Thresholds and ratings, best first.
AFFINITY = ((0.99, "Excellent"), (0.95, "Good"), (0.90, "Moderate"))
CORRELATION = ((0.99, "Excellent"), (0.95, "Very good"), (0.90, "Good"), (0.80, "Moderate"))
DISTANCE = ((0.01, "Very stable"), (0.05, "Stable"), (0.10, "Moderate"))


def rating(x: float, steps: tuple, low: str = "Low", up: bool = True) -> str:
    return next((name for limit, name in steps if (x > limit if up else x < limit)), low)


def interpretation(report: pd.DataFrame, k: int = 2) -> dict[str, str]:
    """Ratings of mean affinity, distance, each component and the whole."""
    corr = [report[f"corr_{i + 1}"].mean() for i in range(k)]
    aff, mean = report["affinity"].mean(), float(np.mean(corr))
    whole = "highly stable" if mean > 0.95 and aff > 0.99 else "good stability" if mean > 0.90 and aff > 0.95 else "moderate to low stability"
    return {"subspace_affinity": rating(aff, AFFINITY), "procrustes_distance": rating(report["procrustes"].mean(), DISTANCE, "Unstable", up=False)} | {f"PC{i + 1}": rating(c, CORRELATION) for i, c in enumerate(corr)} | {"overall_summary": whole}


def interpretation_texts(report: pd.DataFrame, k: int = 2) -> list[tuple]:
    """(metric, rating, mean, std, ci_lower, ci_upper, text): each rating with the figures that it rests on."""
    rated, out = interpretation(report, k), []
    names = {"subspace_affinity": "affinity", "procrustes_distance": "procrustes"} | {f"PC{i + 1}": f"corr_{i + 1}" for i in range(k)}
    for metric, column in names.items():
        x = report[column].to_numpy(float)
        lo, hi = np.percentile(x, [2.5, 97.5])
        text = f"{metric}: {rated[metric]} (mean {x.mean():.4f}, sd {x.std():.4f}; 95% of {len(x)} replicates from {lo:.4f} to {hi:.4f})"
        out.append((metric, rated[metric], float(x.mean()), float(x.std()), float(lo), float(hi), text))
    return [*out, ("overall_summary", rated["overall_summary"], None, None, None, None, f"all {k} components: {rated['overall_summary']}")]


def stability_table(spark: SparkSession, report: pd.DataFrame) -> DataFrame:
    return spark.createDataFrame(report)
