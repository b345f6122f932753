"""Boosted trees on counts: rows that fall into the same bins of all features are one cell, and a model sees cells only.

The algorithm is Spark ML's GBTClassifier (logistic loss, variance impurity, midpoints between values as thresholds), so where
Spark takes the same thresholds the models are the same; its own thresholds come from a sample of rows, these from all rows. One
pass over the rows counts the cells of any number of models; fitting then costs the same for any number of rows. Thresholds
are those of the whole training set, for weighted replicates too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.draws import dealt, gathered, poisson_weights, prefix
from tidemark.operators.quantiles import quantiles_by

BINS = 32
#: Cells up to so many are counted densely by each task and fitted on the driver.
CELLS = 1 << 17
#: Distinct values of a feature up to so many are counted on the driver; beyond, thresholds are exact quantiles.
VALUES = 200_000


def whole(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows with all features: neither null nor NaN."""
    return df.withColumns({c: F.col(c).cast("double") for c in features}).dropna(subset=features)


def cuts(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Spark's thresholds for sorted distinct values: all midpoints, or those nearest to equal shares."""
    middle = (values[1:] + values[:-1]) / 2
    if len(middle) < bins:
        return middle
    stride = counts.sum() / bins
    target, upto, out = stride, np.cumsum(counts), []
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def thresholds(rows: DataFrame, features: list[str]) -> list[np.ndarray]:
    """By feature, from all rows: values are counted, so that only distinct ones are moved."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), (F.col(c) + 0.0).alias("x")) for i, c in enumerate(features)]))
    counted = rows.select(pairs.alias("s")).groupBy("s.f", "s.x").agg(F.count("*").alias("n")).cache()
    many = {r["f"] for r in counted.groupBy("f").count().where(F.col("count") > VALUES).collect()}
    few = counted.where(~F.col("f").isin(*many)) if many else counted
    told = few.toArrow().to_pandas().sort_values(["f", "x"])
    counted.unpersist()
    out = []
    for i, c in enumerate(features):
        if i in many:
            at = quantiles_by(rows.select(F.lit(0).alias("_g"), c), c, ["_g"], [k / BINS for k in range(1, BINS)]).first()["q"]
            out.append(np.unique(at))
        else:
            own = told[told["f"] == i]
            out.append(cuts(own["x"].to_numpy(float), own["n"].to_numpy()))
    return out


def cell_count(cut: list[np.ndarray]) -> int:
    return int(np.prod([len(t) + 1 for t in cut], dtype=float))


def _codes(t: pa.Table, features: list[str], cut: list[np.ndarray]) -> np.ndarray:
    code = np.zeros(len(t), np.int64)
    for c, at in zip(features, cut, strict=True):
        code = code * (len(at) + 1) + np.searchsorted(at, t.column(c).to_numpy())
    return code


def _bins(cut: list[np.ndarray]) -> np.ndarray:
    """Every cell's bins, in the order of codes."""
    return np.stack(np.unravel_index(np.arange(cell_count(cut)), [len(t) + 1 for t in cut]), axis=1)


def counted(rows: DataFrame, features: list[str], cut: list[np.ndarray], label: str, key: str | None = None, suffixes: list[str] | None = None) -> np.ndarray:
    """(replicates, cells, 2): rows by cell and label, weighted by each suffix's draw of the key; without suffixes, one unweighted
    replicate. rows: see `whole`."""
    many, size = len(suffixes or [""]), cell_count(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((many, 2 * size))
        for t in gathered(batches):
            y = t.column("_y").to_numpy()
            if y.min() < 0 or y.max() > 1:
                raise ValueError("labels must be 0 or 1")
            at = 2 * _codes(t, features, cut) + y
            for b, w in enumerate(poisson_weights(t.column("_p"), suffixes) if suffixes else [None]):
                total[b] += np.bincount(at, w, 2 * size)
        seen = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), *[pa.array(x[seen].astype(np.int64)) for x in total]], ["c", *[f"w{b}" for b in range(many)]])

    names = [f"w{b}" for b in range(many)]
    part = rows.select(*features, F.col(label).cast("int").alias("_y"), *([F.col(key).alias("_k")] if suffixes else []))
    if suffixes:
        part = dealt(part).withColumn("_p", prefix("_k")).drop("_k")
    sums = part.mapInArrow(run, "c bigint, " + ", ".join(f"{w} bigint" for w in names)).groupBy("c").agg(*[F.sum(w).alias(w) for w in names]).toArrow()
    out = np.zeros((many, 2 * size))
    for b, w in enumerate(names):
        out[b, sums.column("c").to_numpy()] = sums.column(w).to_numpy()
    return out.reshape(many, size, 2)


@dataclass
class Booster:
    """Margins by cell; importances by feature."""

    cut: list[np.ndarray]
    margin: np.ndarray
    importance: np.ndarray

    @property
    def p(self) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * self.margin))

    @property
    def prediction(self) -> np.ndarray:
        return (self.margin > 0).astype(int)


def _tree(bins: np.ndarray, sizes: list[int], use: np.ndarray, w: np.ndarray, s: np.ndarray, q: np.ndarray, depth: int, importance: np.ndarray) -> np.ndarray:
    """The regression tree's value in every cell, given sums of weights, targets and their squares in the cells `use`."""
    node, n, open_ = np.zeros(len(bins), np.int64), 1, np.ones(1, bool)
    value = np.array([s.sum() / w.sum()])
    for _ in range(depth):
        if not open_.any():
            break
        best, where = np.zeros(n), np.full((n, 2), -1)
        for f, size in enumerate(sizes):
            if size < 2:
                continue
            at = node[use] * size + bins[use, f]
            cw, cs, cq = (np.cumsum(np.bincount(at, x, n * size).reshape(n, size), axis=1) for x in (w, s, q))
            tw, ts, tq = cw[:, -1:], cs[:, -1:], cq[:, -1:]
            lw, ls, lq = cw[:, :-1], cs[:, :-1], cq[:, :-1]
            rw, rs, rq = tw - lw, ts - ls, tq - lq
            with np.errstate(all="ignore"):
                def spread(q, s, w):
                    return np.maximum(q - s * s / w, 0)

                gain = np.where((lw > 0) & (rw > 0), (spread(tq, ts, tw) - spread(lq, ls, lw) - spread(rq, rs, rw)) / tw, -1.0)
            at = gain.argmax(1)
            top = gain[np.arange(n), at]
            # features that part the rows alike differ by rounding alone; the first one counts
            better = open_ & (top > best * (1 + 1e-9) + 1e-15)
            best[better], where[better, 0], where[better, 1] = top[better], f, at[better]
        split = where[:, 0] >= 0
        if not split.any():
            break
        total = np.bincount(node[use], w, n)
        np.add.at(importance, where[split, 0], best[split] * total[split])
        # a node that isn't split keeps its rows on the left, closed
        mine = where[node]
        right = (mine[:, 0] >= 0) & (bins[np.arange(len(bins)), np.maximum(mine[:, 0], 0)] > mine[:, 1])
        node, n = 2 * node + right, 2 * n
        cw, cs = np.bincount(node[use], w, n), np.bincount(node[use], s, n)
        value = np.where(np.repeat(split, 2) & (cw > 0), cs / np.maximum(cw, 1e-300), np.repeat(value, 2))
        open_ = np.repeat(split, 2)
    return value[node]


def fit(counts: np.ndarray, cut: list[np.ndarray], depth: int, rate: float, trees: int) -> Booster:
    """Spark's boosting over counts (cells, 2) of labels 0 and 1; the first tree weighs 1, the others the rate."""
    bins, sizes = _bins(cut), [len(t) + 1 for t in cut]
    use = np.flatnonzero(counts.any(1))
    if not len(use):
        raise ValueError("no rows to fit")
    no, yes = counts[use, 0], counts[use, 1]
    margin, importance = np.zeros(len(bins)), np.zeros(len(cut))
    for m in range(trees):
        if m:
            down, up = -4 / (1 + np.exp(-2 * margin[use])), 4 / (1 + np.exp(2 * margin[use]))
        else:
            down, up = -np.ones(len(use)), np.ones(len(use))
        tree = _tree(bins, sizes, use, no + yes, no * down + yes * up, no * down**2 + yes * up**2, depth, importance)
        margin = margin + (rate if m else 1.0) * tree
    return Booster(cut, margin, importance / importance.sum() if importance.sum() > 0 else importance)


def scored(rows: DataFrame, features: list[str], cut: list[np.ndarray], p: np.ndarray, prediction: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns `keep` of rows (see `whole`), p and prediction by cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _codes(pa.Table.from_batches([batch]), features, cut)
            yield pa.RecordBatch.from_arrays([*[batch.column(f"_{i}") for i in range(len(keep))], pa.array(p[code]), pa.array(prediction[code].astype(float))], [*keep, "p", "prediction"])

    kept = [F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.select(*kept, *features).mapInArrow(run, types + ", p double, prediction double")
