"""Additive regression by penalised splines: one distributed pass for the Gram matrix, every smoothing value solved from it.

Each smooth term has a cubic B-spline basis on equal knots and a second-order difference penalty (Eilers and Marx, 1996).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import quantiles

LAMBDAS = tuple(10.0 ** np.linspace(-3, 3, 11))


@dataclass(frozen=True)
class Term:
    column: str
    splines: int = 20
    linear: bool = False


@dataclass
class Model:
    terms: list[Term]
    ranges: dict[str, tuple[float, float]]
    centre: np.ndarray
    beta: np.ndarray
    cov: np.ndarray
    lam: float
    edof: float
    gcv: float
    names: list[str] = field(default_factory=list)


def basis(x: np.ndarray, lo: float, hi: float, n: int) -> np.ndarray:
    """Cubic B-splines on equal knots; values beyond the range count as its ends."""
    width = (hi - lo) / (n - 3) or 1.0
    u = np.clip((np.asarray(x, float) - lo) / width, 0, n - 3 - 1e-9)
    i = u.astype(int)
    t = u - i
    out = np.zeros((len(u), n))
    rows = np.arange(len(u))
    for k, v in enumerate(((1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6)):
        out[rows, i + k] = v
    return out


def design(pdf: pd.DataFrame, terms: list[Term], ranges: dict) -> np.ndarray:
    parts = [np.ones((len(pdf), 1))]
    for t in terms:
        x = pdf[t.column].to_numpy(float)
        parts.append(x[:, None] if t.linear else basis(x, *ranges[t.column], t.splines))
    return np.concatenate(parts, axis=1)


def gram(df: DataFrame, terms: list[Term], targets: list[str], ranges: dict, weight: str | None = None) -> dict[str, np.ndarray]:
    """By target: [X y]'[X y] over its finite rows. Every task makes one matrix a target; Spark adds them up by place."""
    columns = [t.column for t in terms]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            x = design(batch, terms, ranges)
            w = batch[weight].to_numpy(float) if weight else np.ones(len(batch))
            for t in targets:
                y = batch[t].to_numpy(float)
                good = np.isfinite(y) & np.isfinite(x).all(1)
                z = np.concatenate([x[good], y[good, None], np.ones((good.sum(), 1))], axis=1)
                total[t] = total.get(t, 0) + z.T @ (z * w[good, None])
        if total:  # a task without rows sends nothing
            yield pd.DataFrame({"target": list(total), "g": [g.reshape(-1) for g in total.values()]})

    rows = df.select(*{*columns, *targets, *([weight] if weight else [])}).mapInPandas(run, "target string, g array<double>")
    sums = rows.select("target", F.posexplode("g").alias("i", "v")).groupBy("target", "i").agg(F.sum("v").alias("v"))
    out: dict[str, dict[int, float]] = {}
    for r in sums.collect():  # a matrix for each target
        out.setdefault(r["target"], {})[r["i"]] = r["v"]
    return {t: np.array([g[i] for i in range(len(g))]).reshape(int(len(g) ** 0.5), -1) for t, g in out.items()}


def penalty(terms: list[Term]) -> np.ndarray:
    size = 1 + sum(1 if t.linear else t.splines for t in terms)
    p, at = np.zeros((size, size)), 1
    for t in terms:
        if t.linear:
            at += 1
            continue
        d = np.diff(np.eye(t.splines), 2, axis=0)
        p[at : at + t.splines, at : at + t.splines] = d.T @ d
        at += t.splines
    return p


def _inverse(a: np.ndarray) -> np.ndarray:
    """Of a symmetric positive definite matrix, by sweeps. It stays off threaded LAPACK, which can stall beside a busy JVM."""
    a = a.copy()
    for k in range(len(a)):
        pivot, row = a[k, k], a[k].copy()
        col = a[:, k].copy()
        a -= col[:, None] * row / pivot
        a[k], a[:, k] = row / pivot, -col / pivot
        a[k, k] = 1 / pivot
    return a


def solve(g: np.ndarray, terms: list[Term], ranges: dict, lambdas=LAMBDAS) -> Model:
    """The smoothing value of least generalised cross-validation; a small ridge makes intercept and bases identifiable."""
    k = g.shape[0] - 2
    xx, xy, yy, n = g[:k, :k], g[:k, k], g[k, k], g[k + 1, k + 1]
    ridge = 1e-6 * max(n, 1) * np.eye(k)
    ridge[0, 0] = 0
    best = None
    for lam in lambdas:
        inv = _inverse(xx + lam * penalty(terms) + ridge)
        beta = inv @ xy
        rss = max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0)
        edof = float((inv * xx).sum())
        gcv = n * rss / max(n - edof, 1e-9) ** 2
        if best is None or gcv < best.gcv:
            best = Model(terms, ranges, xx[0] / max(n, 1), beta, np.einsum("ij,jk->ik", np.einsum("ij,jk->ik", inv, xx), inv) * rss / max(n - edof, 1.0), float(lam), edof, float(gcv))
    return best


def fit(df: DataFrame, terms: list[Term], target: str, lambdas=LAMBDAS) -> Model:
    return fit_many(df, terms, [target], lambdas, least=0)[target]


def ranges_of(df: DataFrame, terms: list[Term]) -> dict[str, tuple[float, float]]:
    smooth = [t.column for t in terms if not t.linear]
    row = df.agg(*[f(c) for c in smooth for f in (F.min, F.max)]).first() if smooth else []
    return {c: (float(row[2 * i] or 0), float(row[2 * i + 1] or 0)) for i, c in enumerate(smooth)}


def fit_many(df: DataFrame, terms: list[Term], targets: list[str], lambdas=LAMBDAS, least: int = 100) -> dict[str, Model]:
    """One pass for all targets; those with under `least` finite rows are left out."""
    ranges = ranges_of(df, terms)
    return {t: solve(g, terms, ranges, lambdas) for t, g in gram(df, terms, targets, ranges).items() if g[-1, -1] >= least}


def predict(df: DataFrame, model: Model, name: str = "prediction") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: design(batch, model.terms, model.ranges) @ model.beta})

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {name} double")


def partial_dependence(model: Model, points: int = 100) -> pd.DataFrame:
    """(term, x, effect, lo, hi): each smooth about its mean, with 95 % bands from the posterior covariance."""
    out, at = [], 1
    for t in model.terms:
        size = 1 if t.linear else t.splines
        if not t.linear:
            lo, hi = model.ranges[t.column]
            x = np.linspace(lo, hi, points)
            b = basis(x, lo, hi, t.splines) - model.centre[at : at + size]
            effect = b @ model.beta[at : at + size]
            se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", b, model.cov[at : at + size, at : at + size], b), 0))
            out.append(pd.DataFrame({"term": t.column, "x": x, "effect": effect, "lo": effect - 1.96 * se, "hi": effect + 1.96 * se}))
        at += size
    return pd.concat(out, ignore_index=True)


def bootstrap_grams(df: DataFrame, terms: list[Term], target: str, key: str, replicates: int, ranges: dict) -> list[np.ndarray]:
    """The Gram matrix of every replicate with Poisson weights, from one pass: a task sends one matrix a replicate."""
    from tidemark.functions.scalars import poisson

    weights = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda b: poisson(F.col(key).cast("string"), b.cast("string")).cast("double"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x, y = design(batch, terms, ranges), batch[target].to_numpy(float)
            good = np.isfinite(y) & np.isfinite(x).all(1)
            if good.any():
                z, w = np.concatenate([x[good], y[good, None], np.ones((good.sum(), 1))], axis=1), np.stack(batch["_w"].to_numpy()[good])
                sums = np.stack([z.T @ (z * w[:, b, None]) for b in range(replicates)])
                total = sums if total is None else total + sums
        if total is not None:
            yield pd.DataFrame({"b": range(replicates), "g": [g.reshape(-1) for g in total]})

    rows = df.select(*{*[t.column for t in terms], target}, weights.alias("_w")).mapInPandas(run, "b int, g array<double>")
    sums = rows.select("b", F.posexplode("g").alias("i", "v")).groupBy("b", "i").agg(F.sum("v").alias("v"))
    size = 2 + sum(1 if t.linear else t.splines for t in terms) + 1
    out = np.zeros((replicates, size * size))
    for r in sums.collect():  # a matrix for each replicate
        out[r["b"], r["i"]] = r["v"]
    return list(out.reshape(replicates, size, size))


def bootstrap_bands(df: DataFrame, terms: list[Term], target: str, key: str, replicates: int = 50, lam: str = "fitted") -> pd.DataFrame:
    """Pointwise percentile bands over replicates with Poisson weights, and width_ratio: by term, their mean width over that of
    the posterior's bands. lam: the fitted smoothing value, or chosen anew ('default')."""
    model = fit(df, terms, target)
    lambdas = (model.lam,) if lam == "fitted" else LAMBDAS
    grams = bootstrap_grams(df, terms, target, key, replicates, model.ranges)
    curves = [partial_dependence(solve(g, terms, model.ranges, lambdas))["effect"].to_numpy() for g in grams]
    out = partial_dependence(model)
    out["boot_lo"], out["boot_hi"] = np.percentile(np.array(curves), [2.5, 97.5], axis=0)
    widths = out.assign(own=out["hi"] - out["lo"], boot=out["boot_hi"] - out["boot_lo"]).groupby("term")[["own", "boot"]].transform("mean")
    out["width_ratio"] = widths["boot"] / widths["own"].where(widths["own"] > 0)
    return out


def improvement(plain: dict, enhanced: dict) -> list[tuple]:
    """(metric, plain, enhanced, gain, percent) of rmse, mae and r2; a gain is an error that fell or an r2 that rose."""
    out = []
    for name, sign in (("rmse", -1), ("mae", -1), ("r2", 1)):
        a, b = plain[name], enhanced[name]
        gain = None if a is None or b is None else sign * (b - a)
        out.append((name, a, b, gain, 100 * gain / abs(a) if gain is not None and a else None))
    return out


def cost_breakdown(df: DataFrame, models: dict[str, Model], along: str, points: int = 200) -> pd.DataFrame:
    """Every component's prediction along one feature, others at their medians, not below 0; and its share."""
    terms = next(iter(models.values())).terms
    middle = quantiles(df, [t.column for t in terms], [0.5])
    grid = pd.DataFrame({t.column: np.full(points, middle[t.column][0], float) for t in terms})
    grid[along] = np.linspace(*df.agg(F.min(along), F.max(along)).first(), points)
    out = pd.DataFrame({along: grid[along]} | {name: np.maximum(design(grid, m.terms, m.ranges) @ m.beta, 0) for name, m in models.items()})
    total = out[list(models)].sum(axis=1)
    return out.assign(**{f"{n}_share": np.where(total > 0, out[n] / total, 0) for n in models})


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.nullif(F.count(y) * F.var_pop(y), F.lit(0.0))).alias("r2"))
