"""Gamma and beta functions on NumPy arrays, and the Arrow UDFs built on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def lgamma(x) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    return _lgamma(x) if x.size else x


def betaln(a, b) -> np.ndarray:
    return lgamma(a) + lgamma(b) - lgamma(np.asarray(a, float) + np.asarray(b, float))


def digamma(x) -> np.ndarray:
    """Recurrence up to 6, then the asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out = np.where(low, out - 1 / x, out)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x) -> np.ndarray:
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out = np.where(low, out + 1 / (x * x), out)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))


def _fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz).

    It needs steps in proportion to the root of the larger parameter. Values that
    have converged leave the loop, so that none waits for the slowest.
    """
    steps = 400 + int(20 * np.sqrt(np.max(np.maximum(a, b), initial=1.0)))
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    out, at = np.empty_like(x), np.arange(len(x))
    c = np.ones_like(x)
    d = 1 / guard(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, steps):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / guard(1 + top * d)
            c = guard(1 + top / c)
            h = h * d * c
        moving = np.abs(d * c - 1) >= 1e-15  # not so for NaN, which stays
        left = np.count_nonzero(moving)
        if not left:
            break
        # Copying what is left pays when a part is done.
        if left <= 0.75 * len(at):
            out[at[~moving]] = h[~moving]
            a, b, x, c, d, h, at = (v[moving] for v in (a, b, x, c, d, h, at))
    if np.any(np.abs(d * c - 1) > 1e-9):
        raise ArithmeticError("the continued fraction of the incomplete beta function did not converge")
    out[at] = h
    return out


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inside = (x > 0) & (x < 1)
    z = np.where(inside, x, 0.5)
    front = np.exp(a * np.log(z) + b * np.log1p(-z) - betaln(a, b))
    flip = z > (a + 1) / (a + b + 2)
    p, q, u = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - z, z)
    part = front * _fraction(p.ravel(), q.ravel(), u.ravel()).reshape(u.shape) / p
    value = np.where(flip, 1 - part, part)
    return np.where(inside, value, (x >= 1).astype(float))


def betaincinv(a, b, q) -> np.ndarray:
    """Quantile of the beta distribution: Newton steps kept inside a shrinking bracket.

    A value stops when its step is lost in the rounding of the distribution
    function, which grows with the parameters, and leaves the loop.
    """
    shape = np.broadcast_shapes(*(np.shape(v) for v in (a, b, q)))
    a, b, q = (np.broadcast_to(np.asarray(v, float), shape).ravel() for v in (a, b, q))
    found, at = a / (a + b), np.arange(len(q))
    every = q
    low, high = np.zeros_like(q), np.ones_like(q)
    x = found.copy()
    norm = betaln(a, b)
    for _ in range(100):
        f = betainc(a, b, x) - q
        high, low = np.where(f > 0, x, high), np.where(f > 0, low, x)
        with np.errstate(all="ignore"):
            slope = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - norm)
            step = x - f / slope
            noise = 1e-15 * (a + b) * q / slope
        good = np.isfinite(step) & (step > low) & (step < high)
        new = np.where(good, step, (low + high) / 2)
        least = 1e-300 + 1e-14 * np.abs(x)
        done = np.abs(new - x) <= np.where(good, np.fmax(least, np.fmin(noise, 1e-9 * np.abs(x))), least)
        found[at] = x = new
        if np.all(done):
            break
        a, b, q, norm, low, high, x, at = (v[~done] for v in (a, b, q, norm, low, high, x, at))
    return np.where(every <= 0, 0.0, np.where(every >= 1, 1.0, found)).reshape(shape)


def students_p(t, df) -> np.ndarray:
    """Two-sided p-value of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def beta_pdf(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Beta density; infinite where the density is (x at 0 or 1 with a parameter under 1)."""
    x, a, b = (np.asarray(v, float) for v in (x, a, b))
    with np.errstate(all="ignore"):
        log = lambda p, z: np.where(p == 1, 0.0, (p - 1) * np.log(z))
        dens = np.exp(log(a, x) + log(b, 1 - x) - betaln(a, b))
    return pd.Series(dens)


@F.pandas_udf(T.DoubleType())
def beta_ppf(q: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(betaincinv(np.asarray(a, float), np.asarray(b, float), np.asarray(q, float)))


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a standard normal statistic."""
    return pd.Series(_erfc(np.abs(np.asarray(z, float)) / math.sqrt(2))) if len(z) else pd.Series([], dtype=float)


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(students_p(t, df))
