"""Two-class models: boosted trees on counts by cell (`boost`) or, with too many cells, on Spark ML; metrics in SQL aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.draws import dealt, gathered, poisson_weights, prefix
from tidemark.functions.scalars import poisson
from tidemark.operators import boost
from tidemark.operators.quantiles import quantiles_by

#: (depth, rate) of the sweep.
SWEEP = ((4, 0.05), (4, 0.10), (6, 0.05), (6, 0.10), (8, 0.10))


def booster(features: list[str], label: str = "label", depth: int = 6, rate: float = 0.3, trees: int = 20, weight: str | None = None) -> Pipeline:
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxDepth=depth, stepSize=rate, maxIter=trees, seed=42)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), gbt])


def latent_booster(hours: list[str], extra: list[str] | None = None, k: int = 5, **how) -> Pipeline:
    """PCA of the hour profile, fitted on what the pipeline is fitted on, with further features if given."""
    stages = [VectorAssembler(inputCols=hours, outputCol="profile", handleInvalid="skip"), PCA(k=k, inputCol="profile", outputCol="latent")]
    return Pipeline(stages=[*stages, *booster(["latent", *(extra or [])], **how).getStages()])


def scored(model, df: DataFrame) -> DataFrame:
    """df with p (probability of class 1) and prediction."""
    out = model.transform(df)
    return out.withColumn("p", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "features", "profile", "latent")


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """label, support, precision, recall, f1; from the few rows of the confusion counts."""
    return report_of(confusion(df, label, prediction))


def report_of(c: DataFrame) -> DataFrame:
    """`class_report` from confusion counts."""
    real = c.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    said = c.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("said"))
    rows = real.join(said, "label", "left").na.fill(0, ["said"])
    p, r = F.coalesce(F.col("hit") / F.nullif(F.col("said"), F.lit(0)), F.lit(0.0)), F.col("hit") / F.col("support")
    return rows.select("label", "support", p.alias("precision"), r.alias("recall")).withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def overall(df: DataFrame, label: str = "label", prediction: str = "prediction", average: str = "macro") -> DataFrame:
    """accuracy and f1, macro or weighted by support."""
    return overall_of(class_report(df, label, prediction), average)


def overall_of(report: DataFrame, average: str = "macro") -> DataFrame:
    """`overall` from the report by class."""
    f1 = F.avg("f1") if average == "macro" else F.sum(F.col("f1") * F.col("support")) / F.sum("support")
    return report.agg((F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), f1.alias("f1"))


def bootstrap_metrics(df: DataFrame, key: str, replicates: int = 200, label: str = "label", prediction: str = "prediction", average: str = "macro") -> DataFrame:
    """accuracy and f1 by replicate from weighted confusion counts: a task sends one count a replicate and pair of classes."""
    suffixes = [f"{b}:42" for b in range(replicates)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, np.ndarray] = {}
        for t in gathered(batches):
            w = poisson_weights(t.column(0), suffixes)
            codes = [t.column(i).combine_chunks().dictionary_encode("encode") for i in (1, 2)]
            q = codes[1].indices.to_numpy()
            pairs, at = np.unique(codes[0].indices.to_numpy().astype(np.int64) * len(codes[1].dictionary) + q, return_inverse=True)
            sums = np.stack([np.bincount(at, x, len(pairs)) for x in w]).astype(np.int64)
            for i, pair in enumerate(pairs.tolist()):
                k = tuple(c.dictionary[j].as_py() for c, j in zip(codes, divmod(pair, len(codes[1].dictionary)), strict=True))
                counts[k] = counts.get(k, 0) + sums[:, i]
        if counts:
            many = range(replicates)
            yield pa.RecordBatch.from_arrays([pa.array([b for _ in counts for b in many], pa.int32()), *[pa.array([k[i] for k in counts for _ in many], pa.int32()) for i in (0, 1)], pa.array(np.concatenate(list(counts.values())))], ["b", "y", "q", "n"])

    rows = dealt(df.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("q"))).select(prefix("_k").alias("_p"), "y", "q")
    c = rows.mapInArrow(run, "b int, y int, q int, n bigint").groupBy("b", "y", "q").agg(F.sum("n").alias("n"))
    sides = c.select("b", F.explode(F.array(F.struct(F.col("y").alias("k"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said"), F.when(F.col("y") == F.col("q"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("q").alias("k"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("b", "s.*")
    per = sides.groupBy("b", "k").agg(F.sum("real").alias("real"), F.sum("said").alias("said"), F.sum("hit").alias("hit")).where("real > 0")
    f1 = F.coalesce(2.0 * F.col("hit") / F.nullif(F.col("real") + F.col("said"), F.lit(0)), F.lit(0.0))
    agg = F.avg(f1) if average == "macro" else F.sum(f1 * F.col("real")) / F.sum("real")
    return per.groupBy("b").agg((F.sum("hit") / F.sum("real")).alias("accuracy"), agg.alias("f1"))


def _cells(train: DataFrame, features: list[str]) -> tuple[DataFrame, list[np.ndarray] | None]:
    """Complete training rows, and thresholds; none where they make too many cells to count."""
    rows = boost.whole(train, features)
    cut = boost.thresholds(rows, features)
    return rows, cut if boost.cell_count(cut) <= boost.CELLS else None


def boosted(train: DataFrame, test: DataFrame, features: list[str], depth: int = 6, rate: float = 0.3, trees: int = 20) -> tuple[DataFrame, list[float]]:
    """label, p and prediction of test's complete rows by a model of train; and the features' importances."""
    rows, cut = _cells(train, features)
    if cut is None:
        model = booster(features, depth=depth, rate=rate, trees=trees).fit(train)
        return scored(model, test).select("label", "p", "prediction"), model.stages[-1].featureImportances.toArray().tolist()
    own = boost.fit(boost.counted(rows, features, cut, "label")[0], cut, depth, rate, trees)
    return boost.scored(boost.whole(test, features), features, cut, own.p, own.prediction, ["label"]), own.importance.tolist()


def sweep(train: DataFrame, test: DataFrame, features: list[str], grid: tuple = SWEEP, trees: int = 10) -> list[tuple]:
    """(depth, rate, accuracy, f1). Rows are read once for thresholds and once for the counts that all models share."""
    rows, cut = _cells(train, features)
    known, asked = (boost.counted(x, features, cut, "label")[0] for x in (rows, boost.whole(test, features))) if cut else (None, None)
    out = []
    for depth, rate in grid:
        if cut is None:
            row = overall(scored(booster(features, depth=depth, rate=rate, trees=trees).fit(train), test)).first()
        else:
            said = boost.fit(known, cut, depth, rate, trees).prediction
            told = [(y, q, int(asked[said == q, y].sum())) for y in (0, 1) for q in (0, 1)]
            row = overall_of(report_of(train.sparkSession.createDataFrame([t for t in told if t[2]], "label int, prediction int, n bigint"))).first()
        out.append((depth, rate, row["accuracy"], row["f1"]))
    return out


def bagged(train: DataFrame, test: DataFrame, features: list[str], key: str, replicates: int = 30, trees: int = 10, depth: int = 4) -> DataFrame:
    """key, label, mean probability, prediction and confidence of models fitted on Poisson-weighted rows. One pass counts all
    replicates."""
    rows, cut = _cells(train, features)
    if cut is None:
        parts = None
        for b in range(replicates):
            own = train.withColumn("_w", poisson(F.col(key).cast("string"), b).cast("double")).where("_w > 0")
            one = scored(booster(features, depth=depth, trees=trees, weight="_w").fit(own), test).select(key, "label", "p")
            parts = one if parts is None else parts.union(one)
    else:
        counts = boost.counted(rows, features, cut, "label", key, [str(b) for b in range(replicates)])
        p = np.mean([boost.fit(c, cut, depth, 0.3, trees).p for c in counts], axis=0)
        parts = boost.scored(boost.whole(test, features), features, cut, p, p > 0.5, [key, "label"]).select(key, "label", "p")
    out = parts.groupBy(key, "label").agg(F.avg("p").alias("p"))
    return out.withColumn("prediction", (F.col("p") > 0.5).cast("double")).withColumn("confidence", F.greatest("p", 1 - F.col("p")))


def confidence_stats(df: DataFrame) -> DataFrame:
    """Confidence (largest class probability) by whether the prediction is right."""
    rows = df.select((F.col("label") == F.col("prediction")).alias("correct"), F.greatest("p", 1 - F.col("p")).alias("_c"))
    half = quantiles_by(rows, "_c", ["correct"], [0.5]).select(F.col("correct").alias("_correct"), F.col("q")[0].alias("median"))
    told = rows.groupBy("correct").agg(F.count("*").alias("n"), F.avg("_c").alias("mean"), F.min("_c").alias("min"), F.max("_c").alias("max"))
    return told.join(half, F.col("correct").eqNullSafe(F.col("_correct")), "left").select("correct", "n", "mean", "median", "min", "max")


def importances(own: list[float], features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, own, strict=True), key=lambda x: -x[1])
