"""Special functions: as Column expressions, which stay in generated code, and
as numpy functions for the kernels of grouped operators.

Spark has no gamma functions and scipy is not assumed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients for g = 7 and nine terms (published constants).
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
LOG_2PI = math.log(2 * math.pi)


# -- Column expressions ----------------------------------------------------------


def lgamma(x: Column) -> Column:
    """Logarithm of gamma, for positive x."""
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:]):
        total = total + F.lit(c) / (x + F.lit(float(k)))
    t = x + F.lit(LANCZOS_G - 0.5)
    return F.lit(0.5 * LOG_2PI) + (x - 0.5) * F.log(t) - t + F.log(total)


def betaln(a: Column, b: Column) -> Column:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def beta_logpdf(x: Column, a: Column, b: Column) -> Column:
    """Of x strictly between 0 and 1; null elsewhere."""
    return F.when((x > 0) & (x < 1), (a - 1) * F.log(x) + (b - 1) * F.log(1 - x) - betaln(a, b))


def normal_logpdf(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return -0.5 * z * z - F.log(sd) - F.lit(0.5 * LOG_2PI)


def poisson_logpmf(k: Column, rate: Column) -> Column:
    return k * F.log(rate) - rate - lgamma(k + 1)


# -- numpy ------------------------------------------------------------------------


def np_lgamma(x):
    x = np.asarray(x, dtype=float)
    total = np.full_like(x, LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:]):
        total = total + c / (x + k)
    t = x + LANCZOS_G - 0.5
    return 0.5 * LOG_2PI + (x - 0.5) * np.log(t) - t + np.log(total)


def np_betaln(a, b):
    return np_lgamma(a) + np_lgamma(b) - np_lgamma(np.asarray(a, dtype=float) + b)


def _beta_fraction(x, a, b, rounds: int = 300):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, rounds):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return out


def beta_logcdf(x, a, b):
    """Logarithm of the regularised incomplete beta function."""
    x, a, b = np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in (x, a, b)])
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    swap = inner > (a + 1) / (a + b + 2)
    xs, p, q = np.where(swap, 1 - inner, inner), np.where(swap, b, a), np.where(swap, a, b)
    part = p * np.log(xs) + q * np.log1p(-xs) - np_betaln(p, q) - np.log(p) + np.log(_beta_fraction(xs, p, q))
    out = np.where(swap, np.log1p(-np.minimum(np.exp(np.minimum(part, 0)), 1 - 1e-16)), part)
    return np.where(x <= 0, -np.inf, np.where(x >= 1, 0.0, np.minimum(out, 0)))


def beta_cdf(x, a, b):
    return np.exp(beta_logcdf(x, a, b))


def beta_logsf(x, a, b):
    return beta_logcdf(1 - np.asarray(x, dtype=float), b, a)


def beta_ppf(q, a, b, rounds: int = 80):
    """Quantile of Beta(a, b), by bisection."""
    q, a, b = np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in (q, a, b)])
    low, high = np.zeros(q.shape), np.ones(q.shape)
    for _ in range(rounds):
        middle = (low + high) / 2
        under = beta_cdf(middle, a, b) < q
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def wright_omega(z, rounds: int = 40):
    """The w > 0 with w + log w = z."""
    z = np.asarray(z, dtype=float)
    w = np.where(z > 1, np.maximum(z - np.log(np.maximum(z, 1.0)), 0.5), np.exp(np.minimum(z, 1)))
    w = np.maximum(w, 1e-300)
    for _ in range(rounds):
        # Newton on log w keeps w positive
        step = (w + np.log(w) - z) / (1 + w)
        w = w * np.exp(-np.clip(step, -20, 20))
        if np.all(np.abs(step) < 1e-15):
            break
    return w


def normal_cdf(x):
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(np.asarray(x, dtype=float) / math.sqrt(2)))


def logsumexp(x, axis=None):
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    out = np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True)) + top
    return out.item() if axis is None else np.squeeze(out, axis=axis)


def legendre(nodes: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(nodes)
