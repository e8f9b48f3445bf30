"""Distribution tails and quantiles on numpy arrays, and the same as Arrow-batched column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series after shifting the argument above 10."""
    x = np.asarray(x, float)
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(10):
        low = y < 10
        if not low.any():
            break
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    lead = np.exp(np.where(x > 0, -x + a * np.log(np.maximum(x, _TINY)) - log_gamma(a), -np.inf))
    by_series = (x > 0) & (x < a + 1)
    if by_series.any():
        aa, xx = a[by_series], x[by_series]
        term = total = 1 / aa
        n = aa.copy()
        for _ in range(5000):
            n = n + 1
            term = term * xx / n
            total = total + term
            if (np.abs(term) < np.abs(total) * 1e-16).all():
                break
        out[by_series] = 1 - total * lead[by_series]
    rest = (x > 0) & ~by_series
    if rest.any():
        aa, xx = a[rest], x[rest]
        b = xx + 1 - aa
        c, d = np.full_like(b, 1 / _TINY), 1 / np.where(b == 0, _TINY, b)
        h = d.copy()
        for i in range(1, 5000):
            an = -i * (i - aa)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = d * c
            h = h * step
            if (np.abs(step - 1) < 1e-15).all():
                break
        out[rest] = h * lead[rest]
    return out


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), by its continued fraction on the side where that converges fast."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        lead = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
    flip = x >= (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    h = np.ones(p.shape)
    on = np.flatnonzero(np.ones(p.shape).ravel())  # places whose fraction has not converged
    p_, q_, y_ = p.ravel(), q.ravel(), y.ravel()
    c, d = np.ones(len(on)), 1 - (p_ + q_) * y_ / (p_ + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    now = d.copy()
    for m in range(1, 10000):
        for top in (m * (q_ - m) * y_ / ((p_ + 2 * m - 1) * (p_ + 2 * m)), -(p_ + m) * (p_ + q_ + m) * y_ / ((p_ + 2 * m) * (p_ + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = d * c
            now = now * step
        if m % 8 == 0 or len(on) < 64:
            left = ~(np.abs(step - 1) < 1e-15)
            if not left.all():
                h.ravel()[on] = now
                on, p_, q_, y_, c, d, now = (v[left] for v in (on, p_, q_, y_, c, d, now))
                if not len(on):
                    break
    h.ravel()[on] = now
    part = np.where((y <= 0) | (lead == 0), 0.0, lead * h / p)
    return np.where(flip, 1 - part, part)


def normal_sf(z: np.ndarray) -> np.ndarray:
    """Upper tail of the standard normal."""
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in np.atleast_1d(np.asarray(z, float)).ravel()]).reshape(np.shape(z) or (1,))


def normal_isf(p: np.ndarray) -> np.ndarray:
    """Inverse of normal_sf: a rational start and Newton steps on the log of the tail."""
    p = np.asarray(p, float)
    q = np.minimum(p, 1 - p)
    q = np.maximum(q, 5e-324)
    t = np.sqrt(-2 * np.log(q))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    for _ in range(4):
        tail = np.maximum(normal_sf(z), 5e-324)
        density = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
        z = z + np.where(density > 0, tail * (np.log(tail) - np.log(q)) / np.maximum(density, 5e-324), 0)
    return np.where(p <= 0.5, z, -z)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def chi2_sf(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tail of chi-square."""
    return gamma_upper(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def nb_log_pmf(x: np.ndarray, mean: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Log-probability of a negative binomial with variance mean + alpha mean^2."""
    n = 1 / np.asarray(alpha, float)
    return log_gamma(x + n) - log_gamma(n) - log_gamma(x + 1.0) + n * np.log(n / (n + mean)) + x * np.log(mean / (n + mean))


def nb_sf(x: np.ndarray, mean: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """P(X > x): an incomplete beta, exact in both tails."""
    x, mean, n = np.asarray(x, float), np.asarray(mean, float), 1 / np.asarray(alpha, float)
    p = mean / (n + mean)
    return np.where(x < 0, 1.0, beta_inc(np.maximum(x + 1, 1.0), n, p))


def hypergeometric_sf(k: np.ndarray, total: np.ndarray, good: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """P(X >= k) when `drawn` of `total` are drawn without replacement and `good` count; 1 where k <= 0."""
    asked, back = np.unique(np.stack([np.asarray(x, np.int64) for x in np.broadcast_arrays(k, total, good, drawn)]), axis=1, return_inverse=True)
    out = np.ones(asked.shape[1])
    for i, (x, m, g, n) in enumerate(asked.T.tolist()):
        low, high = max(0, n + g - m), min(g, n)
        if x <= low:
            continue
        if x > high:
            out[i] = 0.0
            continue
        j = np.arange(x, high + 1, dtype=float)
        out[i] = min(1.0, float(np.exp(_log_choose(g, j) + _log_choose(m - g, n - j) - _log_choose(m, np.array([float(n)]))).sum()))
    return out[back.ravel()]


def _log_choose(n: float, k: np.ndarray) -> np.ndarray:
    return log_gamma(np.full_like(k, n + 1.0)) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def _column(kernel, *columns: Column) -> Column:
    """A numpy kernel over double columns, a batch at a time; null in, null out."""

    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        values = [s.to_numpy(float, na_value=np.nan) for s in series]
        ok = ~np.isnan(np.stack(values)).any(0)
        out = np.full(len(series[0]), np.nan)
        if ok.any():
            out[ok] = kernel(*(v[ok] for v in values))
        return pd.Series(out).where(ok)

    # the batches arrive as a variable number of columns
    run.__annotations__ = {}
    return run(*[c.cast("double") for c in columns])


def chi2_sf_col(x: Column, df: Column) -> Column:
    return _column(chi2_sf, x, df)


def t_two_sided_col(t: Column, df: Column) -> Column:
    return _column(t_two_sided, t, df)


def nb_sf_col(x: Column, mean: Column, alpha: Column) -> Column:
    return _column(nb_sf, x, mean, alpha)


def normal_sf_col(z: Column) -> Column:
    return _column(normal_sf, z)


def hypergeometric_sf_col(k: Column, total: Column, good: Column, drawn: Column) -> Column:
    return _column(hypergeometric_sf, k, total, good, drawn)
