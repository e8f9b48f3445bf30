"""Negative binomial residuals of counts, feature by feature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import log_gamma, nb_log_pmf, nb_sf, nb_sf_col, normal_isf
from ..model import CELLS, CountMatrix
from ..sources.tables import settle
from .matrix import feature_moments, feature_moments_factors
from .scan import bh_fdr

# Where numbers are clipped.
_TAIL_LOW, _TAIL_HIGH = 1e-323, 1 - 6e-17
_ALPHA_LOW, _ALPHA_HIGH = 1e-5, 1e5
_VALID = (1e-3, 1e3)


def fit_mean(y: np.ndarray, exposure: np.ndarray, design: np.ndarray, alpha: float, rounds: int = 100, weight: np.ndarray | None = None) -> np.ndarray:
    """Fitted means of a negative binomial regression with log link, by iteratively reweighted least squares.

    weight: how often each row counts, once by default.
    """
    mu = np.maximum((y + np.average(y, weights=weight)) / 2, 1e-8) + 1e-8
    often = 1.0 if weight is None else weight
    eta, base, flat = np.log(mu), np.log(exposure), _constant(design)
    beta = None
    for _ in range(rounds):
        w = mu / (1 + alpha * mu)
        if beta is not None and flat:  # the same step, without logs: the linear predictor is one number
            new = beta + np.array([(often * (y - mu) / (1 + alpha * mu)).sum() / (often * w).sum()])
        else:
            z = eta - base + (y - mu) / mu
            xtw = design.T * (w * often)
            new = np.linalg.lstsq(xtw @ design, xtw @ z, rcond=None)[0]
        if flat and abs(new[0]) < 200:
            mu = np.exp(new[0]) * exposure
        else:
            eta = np.clip(design @ new + base, -300, 300)
            mu = np.exp(eta)
        if beta is not None and np.abs(new - beta).max() < 1e-12:
            break
        beta = new
    return mu


def _constant(design: np.ndarray) -> bool:
    """Whether a design is an intercept alone."""
    return design.shape[1] == 1 and bool((design == 1).all())


def _distinct(y: np.ndarray, exposure: np.ndarray, design: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(y, exposure, design, weight, back): rows that a fit cannot tell apart once, how many they are, and every row's place among them."""
    if not _constant(design):
        return y, exposure, design, np.ones(len(y)), np.arange(len(y))
    order = np.lexsort((y, exposure))
    new = np.append(True, (np.diff(y[order]) != 0) | (np.diff(exposure[order]) != 0))[: len(order)]
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    first = order[new]
    return y[first], exposure[first], np.ones((len(first), 1)), np.bincount(back, minlength=len(first)).astype(float), back


def fit_alpha(y: np.ndarray, exposure: np.ndarray, design: np.ndarray) -> tuple[float, bool]:
    """The dispersion of greatest likelihood, and whether it lies inside the searched range."""
    if y.sum() <= 0:
        return float("nan"), False
    y, exposure, design, weight, _ = _distinct(y, exposure, design)
    values, which = np.unique(y, return_inverse=True)

    def loglik(ln_alpha: float) -> float:
        alpha = float(np.exp(ln_alpha))
        mu = fit_mean(y, exposure, design, alpha, 30, weight)
        n = 1 / alpha
        return float((weight * (log_gamma(values + n)[which] - log_gamma(np.array([n]))[0] - n * np.log1p(alpha * mu) + y * np.log(mu / (n + mu)))).sum())

    low, high, ratio = np.log(_ALPHA_LOW), np.log(_ALPHA_HIGH), (5**0.5 - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = loglik(a), loglik(b)
    for _ in range(30):
        if fa > fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = loglik(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = loglik(b)
    alpha = float(np.exp((low + high) / 2))
    return alpha, _VALID[0] < alpha < _VALID[1]


def residual(y: np.ndarray, mu: np.ndarray, alpha: float, kind: str = "quantile", rng: np.random.Generator | None = None) -> np.ndarray:
    """Residuals of counts y with means mu: quantile (mid), rqr (randomised), deviance, anscombe or pearson."""
    alpha = float(np.clip(alpha, _ALPHA_LOW, _ALPHA_HIGH))
    if kind in ("quantile", "rqr"):
        a = np.full_like(mu, alpha)
        share = 0.5 if kind == "quantile" else (rng or np.random.default_rng(42)).random(len(y))
        tail = nb_sf(y - 1, mu, a) - share * np.exp(nb_log_pmf(y, mu, a))
        return normal_isf(np.clip(tail, _TAIL_LOW, _TAIL_HIGH))
    if kind == "deviance":
        part = np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mu), 0.0)
        dev = 2 * (part - (y + 1 / alpha) * np.log((1 + alpha * y) / (1 + alpha * mu)))
        return np.sign(y - mu) * np.sqrt(np.maximum(dev, 0))
    if kind == "anscombe":
        # the integral of V^(-1/3), normalised, by Gauss-Legendre between mean and count
        x, w = np.polynomial.legendre.leggauss(24)
        half, mid = (y - mu) / 2, (y + mu) / 2
        at = mid[:, None] + half[:, None] * x
        area = half * (w * np.maximum(at + alpha * at * at, 1e-12) ** (-1 / 3)).sum(1)
        return area / (mu + alpha * mu * mu) ** (1 / 6)
    return (y - mu) / np.sqrt(mu + alpha * mu * mu)


def _lowess(x: np.ndarray, y: np.ndarray, at: np.ndarray, frac: float = 0.05) -> np.ndarray:
    """Local linear fit with tricube weights over the nearest share of points; beyond the ends the end values hold."""
    k = max(3, min(len(x), int(np.ceil(frac * len(x)))))
    out = np.empty(len(at))
    for i, v in enumerate(np.clip(at, x[0], x[-1])):
        d = np.abs(x - v)
        near = np.argpartition(d, k - 1)[:k]
        w = (1 - np.minimum(d[near] / max(d[near].max(), 1e-12), 1) ** 3) ** 3 + 1e-9
        mx, my = np.average(x[near], weights=w), np.average(y[near], weights=w)
        sxx = (w * (x[near] - mx) ** 2).sum()
        slope = (w * (x[near] - mx) * (y[near] - my)).sum() / sxx if sxx > 1e-12 else 0.0
        out[i] = my + slope * (v - mx)
    return out


def regularised_alpha(features: DataFrame, exposure: np.ndarray, design: np.ndarray, sample: int = 2000, width: int = 200) -> DataFrame:
    """(var_id, mean_rank, reg_alpha): dispersion as a smooth function of the rank of a feature's mean.

    features: (var_id, ord, x array<double>, mean[, e array<double>]); e is a feature's own exposure, such as its rescaled
    control input, in place of the common one. Dispersions are fitted for `sample` features evenly spaced by
    rank: that bound on a fit is a parameter. A rolling median over the valid ones and a local fit of their logs give
    the value at every rank. All features get theirs.
    """
    spark, n = features.sparkSession, features.count()
    common = spark.sparkContext.broadcast(exposure)
    # ranks by two steps: a feature's tile of means, then its place in the tile
    from .scan import _tiled

    tiled = _tiled(features.select("var_id", "ord", "mean"), "mean")
    counts = tiled.groupBy("_tile").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_tile").orderBy("mean", "ord")) - 1
    ranked = tiled.withColumn("nth", place).join(F.broadcast(counts.select("_tile", "before")), "_tile").select("var_id", (F.col("nth") + F.col("before")).alias("mean_rank"))
    picks = np.unique(np.linspace(0, n - 1, min(sample, n)).astype(int))
    chosen = ranked.join(F.broadcast(spark.createDataFrame(pd.DataFrame({"mean_rank": picks.astype(np.int64)}))), "mean_rank")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = b["e"] if "e" in b.columns else [common.value] * len(b)
            got = [fit_alpha(np.asarray(x, float), np.asarray(e, float), design) for x, e in zip(b["x"], own, strict=True)]
            yield pd.DataFrame({"mean_rank": b["mean_rank"].to_numpy(np.int64), "alpha": [a if ok else np.nan for a, ok in got]})

    kept = ["x", "e"] if "e" in features.columns else ["x"]
    todo = features.select("var_id", *kept).join(F.broadcast(chosen), "var_id").select("mean_rank", *kept).repartition(max(8, len(picks) // 64))
    fits = todo.mapInPandas(fit, "mean_rank long, alpha double").toPandas().dropna().sort_values("mean_rank")  # `sample` rows at most
    if len(fits) < 3:
        level = float(fits["alpha"].median()) if len(fits) else 1.0
        return ranked.withColumn("reg_alpha", F.lit(level))
    x = fits["mean_rank"].to_numpy(float)
    smooth = np.log(fits["alpha"].rolling(width, center=True, min_periods=1).median().to_numpy())
    knots = np.unique(np.linspace(0, n - 1, min(n, 4096)).astype(int)).astype(float)
    values = spark.sparkContext.broadcast((knots, _lowess(x, smooth, knots)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(reg_alpha=np.exp(np.interp(b["mean_rank"].to_numpy(float), *values.value)))

    return ranked.mapInPandas(read, "var_id string, mean_rank long, reg_alpha double")


def residuals(features: DataFrame, alphas: DataFrame, obs_ids: list[str], exposure: np.ndarray, design: np.ndarray, kind: str = "quantile", centre: bool = True) -> DataFrame:
    """(obs_id, var_id, value): residuals of every cell. features: (var_id, x array<double>[, e array<double>]); e is a
    feature's own exposure in place of the common one."""
    own = "e" in features.columns
    joined = features.select("var_id", "x", *["e"] * own).join(alphas.select("var_id", "reg_alpha"), "var_id")
    spark, n = features.sparkSession, len(obs_ids)
    # by cells, as what is shuffled is mostly zeros and looks small
    joined = joined.repartition(int(min(4096, max(spark.sparkContext.defaultParallelism, features.count() * n // CELLS))))
    shared = spark.sparkContext.broadcast((pa.array(obs_ids, pa.string()), exposure))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, common = shared.value
        for b in batches:
            for i in range(b.num_rows):
                one = lambda c: b.column(c)[i].values.to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
                y, alpha = one("x"), float(b.column("reg_alpha")[i].as_py())
                if y.sum() > 0:
                    e = one("e") if own else common
                    y, e, x, weight, back = _distinct(y, e, design) if kind != "rqr" else (y, e, design, None, slice(None))
                    r = residual(y, fit_mean(y, e, x, alpha, weight=weight), alpha, kind)[back]
                else:
                    r = np.zeros(len(y))
                yield pa.RecordBatch.from_arrays([names, pa.repeat(b.column("var_id")[i], n), pa.array(r - r.mean() if centre else r)], names=["obs_id", "var_id", "value"])

    return joined.mapInArrow(fit, "obs_id string, var_id string, value double")


def finish(raw: DataFrame, clip: float | None = None) -> DataFrame:
    """Clip to +-clip, divide each observation by its length, and give the whole table its former deviation back.

    The residuals are written once and read twice; lengths and both deviations come from one row of sums for each observation.
    """
    r = settle(raw if clip is None else raw.withColumn("value", F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("value")))))
    length = settle(r.groupBy("obs_id").agg(F.count("*").alias("_k"), F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q")).withColumn("_l", F.sqrt("_q")))
    over = F.col("_l") > 0
    deviation = lambda s, q: F.sqrt(F.greatest(F.lit(0.0), F.sum(q) / F.sum("_k") - F.pow(F.sum(s) / F.sum("_k"), F.lit(2.0))))
    both = length.agg(deviation(F.col("_s"), F.col("_q")).alias("_s0"), deviation(F.when(over, F.col("_s") / F.col("_l")).otherwise(0.0), over.cast("double")).alias("_s1"))
    scale = F.when(F.col("_s1") > 0, F.col("_s0") / F.col("_s1")).otherwise(1.0)
    factor = length.join(F.broadcast(both)).select("obs_id", F.when(over, scale / F.col("_l")).otherwise(0.0).alias("_f"))
    return r.join(F.broadcast(factor), "obs_id").select("obs_id", "var_id", (F.col("value") * F.col("_f")).alias("value"))  # a row for each observation, which the driver holds too


def compute_residuals(m: CountMatrix, design: np.ndarray | None = None, kind: str = "quantile", clip: float | str | None = None, sample: int = 2000) -> CountMatrix:
    """m with var.mean, var.variance and var.reg_alpha and the layer residuals (obs_id, var_id, value).

    Exposures are obs.size_factor or, if m has the layer normalization_factors, that layer over its mean; a control input
    counts through such factors only, so a layer "input" without them is an error. Dispersions are fitted for `sample`
    features and smoothed over ranks of the mean (regularised_alpha); residuals are clipped at +-clip ("auto": the root of
    9 + observations / 4), observations scaled to one length and the table to its former deviation (finish).
    design: observations x covariates in the order of obs.ord, a column of ones by default.
    """
    own = "normalization_factors" in m.layers
    if "input" in m.layers and not own:
        raise KeyError("a control input needs normalization_factors: rescale it first")
    if not own and "size_factor" not in m.obs.columns:
        raise KeyError("obs has no size_factor: compute or set size factors first")
    held = m.obs.orderBy("ord").select("obs_id", *[] if own else ["size_factor"]).toPandas()  # a row for each observation
    n = len(held)
    design = np.ones((n, 1)) if design is None else np.asarray(design, float)
    if len(design) != n:
        raise ValueError(f"a design of {len(design)} rows for {n} observations")
    features = m.feature_major()
    if own:
        factors = settle(m.layers["normalization_factors"])
        moments = feature_moments_factors(m.dense(), factors)
        mean = factors.agg(F.avg("factor").alias("_mean"))
        scaled = factors.join(F.broadcast(mean)).select("obs_id", "var_id", (F.col("factor") / F.col("_mean")).alias("value"))
        features = features.join(m.feature_major(scaled).select("var_id", F.col("x").alias("e")), "var_id")
        exposure = np.ones(n)
    else:
        moments = feature_moments(m.counts, m.obs, n)
        exposure = held["size_factor"].to_numpy(float)
    features = settle(features.join(moments, "var_id", "left").na.fill(0.0, ["mean", "variance"]))  # counted, ranked, fitted and read again
    alphas = settle(regularised_alpha(features, exposure, design, sample))
    raw = residuals(features, alphas, held["obs_id"].tolist(), exposure, design, kind)
    done = finish(raw, float(np.sqrt(9 + n / 4)) if clip == "auto" else clip)
    var = m.var.drop("mean", "variance", "reg_alpha").join(features.select("var_id", "mean", "variance"), "var_id").join(alphas.select("var_id", "reg_alpha"), "var_id", "left")
    return replace(m, var=var, layers=m.layers | {"residuals": done})


def pseudo_peaks(cells: DataFrame, lfc: DataFrame, alphas: DataFrame, alpha: float = 0.05, min_fc: float = 0.5, min_exp: int = 2) -> DataFrame:
    """(var_id, n): features whose signal is over their input in min_exp observations.

    cells: (obs_id, var_id, value, input). The mean is the input, at least 1, times exp(lfc); tail probabilities are
    adjusted within each observation; a hit is under alpha with a fold change over min_fc.
    """
    mean = F.greatest(F.col("input").cast("double"), F.lit(1.0)) * F.exp("lfc")
    tested = cells.join(lfc.select("obs_id", "lfc"), "obs_id").join(alphas.select("var_id", "reg_alpha"), "var_id").withColumn("mu", mean)
    tested = tested.withColumn("p", nb_sf_col(F.col("value") - 1, F.col("mu"), F.col("reg_alpha")))
    hits = bh_fdr(tested.select("obs_id", "var_id", "value", "mu", "p"), "p", "q", ["obs_id"]).where((F.col("q") < alpha) & (F.col("value") / F.col("mu") > min_fc))
    return hits.groupBy("var_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_exp)
