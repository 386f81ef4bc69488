"""Tail probabilities. Every UDF here runs on already aggregated rows, one per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t."""
    if math.isinf(t):
        return 0.0
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def t_critical(df: float, alpha: float) -> float:
    """The t with two-sided tail ``alpha``, by bisection."""
    low, high = 0.0, 2.0
    while t_two_sided(high, df) > alpha:
        high *= 2.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        if t_two_sided(mid, df) > alpha:
            low = mid
        else:
            high = mid
    return 0.5 * (low + high)


def t_power(d: float, nobs1: float, ratio: float, alpha: float) -> float:
    """Power of the two-sided two-sample t test with pooled variance.

    P(|T'| > t_crit) for a noncentral T': the normal tail integrated over the
    distribution of the scale estimate s = sqrt(chi2 / df) by Gauss-Legendre.
    """
    nobs2 = nobs1 * ratio
    df = nobs1 + nobs2 - 2.0
    if df <= 0:
        return float("nan")
    shift = d * math.sqrt(nobs1 * nobs2 / (nobs1 + nobs2))
    crit = t_critical(df, alpha)
    spread = 12.0 / math.sqrt(2.0 * df)
    low, high = max(0.0, 1.0 - spread), 1.0 + spread + 2.0 / df
    nodes, weights = np.polynomial.legendre.leggauss(400)
    s = 0.5 * (high - low) * nodes + 0.5 * (high + low)
    log_density = (
        math.log(2.0) + (df / 2.0) * math.log(df / 2.0) - math.lgamma(df / 2.0)
        + (df - 1.0) * np.log(s) - df * s * s / 2.0
    )
    tail = np.array([normal_sf(crit * v - shift) + normal_sf(crit * v + shift) for v in s])
    return float(min(1.0, 0.5 * (high - low) * np.sum(weights * np.exp(log_density) * tail)))


def rank_sum_exact(u: float, nx: int, ny: int) -> float:
    """Two-sided exact p of the larger U, no ties: P(U >= u) doubled, at most 1.

    The counts are the coefficients of the Gaussian binomial (nx + ny over nx), up to the one that
    is needed. Where they would be more than ``MOST_COEFFICIENTS``, ranks lie so close that U is, up
    to scale, a sum of ``small`` uniform numbers of its mean and variance (Irwin-Hall) if ``small`` is
    at most 40, else normal with a term for its kurtosis; they differ by less than 1e-5 there.
    """
    small, large = min(nx, ny), max(nx, ny)
    size = int(nx * ny - u) + 1
    if size > MOST_COEFFICIENTS and small > 40:
        n = float(small + large)
        z = (u - nx * ny / 2.0 - 0.5) / math.sqrt(nx * ny * (n + 1.0) / 12.0)
        excess = -1.2 * (float(nx) ** 2 + float(ny) ** 2 + float(nx) * ny + n) / (float(nx) * ny * (n + 1.0))
        density = math.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
        return min(1.0, max(0.0, 2.0 * (normal_sf(z) + density * excess / 24.0 * (z**3 - 3.0 * z))))
    if size > MOST_COEFFICIENTS:
        x = small / 2.0 + (nx * ny / 2.0 - u + 0.5) / math.sqrt(large * (large + small + 1.0))
        x = min(max(x, 0.0), float(small))
        scale = math.lgamma(small + 1.0)
        terms = (
            (-1) ** j * math.exp(math.log(math.comb(small, j)) + small * math.log(x - j) - scale)
            for j in range(int(min(x, small)) + 1) if x > j
        )
        return min(1.0, max(0.0, 2.0 * math.fsum(terms)))
    ways = np.zeros(size)
    ways[0] = 1.0
    for i in range(1, small + 1):
        step = large + i
        if step < size:
            ways[step:] = ways[step:] - ways[: size - step].copy()
        for start in range(i):
            ways[start::i] = np.cumsum(ways[start::i])
    total = math.comb(nx + ny, small)
    return min(1.0, 2.0 * float(ways.sum()) / total)


#: Doubles that one exact rank-sum p may hold in memory.
MOST_COEFFICIENTS = 4_000_000


def rank_sum_p(u: float, nx: int, ny: int, ties: float, method: str = "auto") -> float:
    """Two-sided Mann-Whitney p.

    ``exact`` counts arrangements (no ties), ``asymptotic`` is the normal approximation with tie
    and continuity correction; ``auto`` is exact for a sample of at most 8 without ties.
    """
    high = max(u, nx * ny - u)
    if method == "exact" or method == "auto" and ties == 0 and min(nx, ny) <= 8:
        return rank_sum_exact(high, nx, ny)
    n = float(nx) + float(ny)
    variance = nx * ny / 12.0 * ((n + 1.0) - ties / (n * (n - 1.0)))
    if variance <= 0:
        return 1.0
    z = (high - nx * ny / 2.0 - 0.5) / math.sqrt(variance)
    return min(1.0, 2.0 * normal_sf(z))


def shapiro_p(w: float, n: int) -> float:
    """p of a Shapiro-Wilk W (Royston 1995)."""
    if w >= 1.0:
        return 1.0
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return min(1.0, max(0.0, p))
    y = math.log(1.0 - w)
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return 1e-99
        y = -math.log(gamma - y)
        mu = 0.544 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sigma = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        ln = math.log(n)
        mu = -1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3
        sigma = math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
    return normal_sf((y - mu) / sigma)


def _rows(fn, *series: pd.Series) -> pd.Series:
    """Apply ``fn`` where every input is present."""
    out = []
    for values in zip(*series):
        if any(v is None or v != v for v in values):
            out.append(None)
        else:
            result = fn(*values)
            out.append(None if result != result else result)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_two_sided_udf(z: pd.Series) -> pd.Series:
    return _rows(lambda v: 2.0 * normal_sf(abs(v)), z)


@F.pandas_udf(T.DoubleType())
def z_power_udf(z: pd.Series, crit: pd.Series) -> pd.Series:
    return _rows(lambda v, c: normal_sf(c - abs(v)) + normal_sf(c + abs(v)), z, crit)


@F.pandas_udf(T.DoubleType())
def t_two_sided_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rows(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def t_power_udf(d: pd.Series, nobs1: pd.Series, ratio: pd.Series, alpha: pd.Series) -> pd.Series:
    return _rows(t_power, d, nobs1, ratio, alpha)


@F.pandas_udf(T.DoubleType())
def rank_sum_p_udf(u: pd.Series, nx: pd.Series, ny: pd.Series, ties: pd.Series) -> pd.Series:
    return _rows(lambda a, b, c, d: rank_sum_p(a, int(b), int(c), d), u, nx, ny, ties)


@F.pandas_udf(T.DoubleType())
def shapiro_p_udf(w: pd.Series, n: pd.Series) -> pd.Series:
    return _rows(lambda a, b: shapiro_p(a, int(b)), w, n)
