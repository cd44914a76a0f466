"""Tail probabilities of F, t and the studentized range, as vectorised columns.

They are applied to tables with one row per tested metric or pair of models.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def f_tail(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * max(f, 0.0)))


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


_erf = np.vectorize(math.erf, otypes=[float])
_RANGE_NODES = np.polynomial.legendre.leggauss(200)
_SCALE_NODES = np.polynomial.legendre.leggauss(200)


def _normal_range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals <= w), by quadrature over the smallest one."""
    z = 8.5 * _RANGE_NODES[0]
    weight = 8.5 * _RANGE_NODES[1] * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    low = 0.5 * (1 + _erf(z / math.sqrt(2)))
    high = 0.5 * (1 + _erf((z[None, :] + np.asarray(w)[:, None]) / math.sqrt(2)))
    return np.clip(k * ((high - low[None, :]) ** (k - 1) @ weight), 0.0, 1.0)


def studentized_range_tail(q: float, k: int, df: float) -> float:
    """P(Q > q) for k groups, by quadrature over the scale's chi distribution."""
    if not q > 0:
        return 1.0
    spread = 10.0 / math.sqrt(2 * df)
    lo, hi = max(1e-8, 1 - spread), 1 + spread
    if df < 60:
        lo, hi = 1e-8, 1 + max(spread, 4.0)
    s = (hi + lo) / 2 + (hi - lo) / 2 * _SCALE_NODES[0]
    weight = (hi - lo) / 2 * _SCALE_NODES[1]
    log_density = (
        math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2)
        + (df - 1) * np.log(s) - df * s * s / 2
    )
    cdf = float(np.sum(weight * np.exp(log_density) * _normal_range_cdf(q * s, k)))
    return min(max(1.0 - cdf, 0.0), 1.0)


def studentized_range_critical(alpha: float, k: int, df: float) -> float:
    """q with tail probability alpha, by bisection."""
    lo, hi = 0.0, 4.0
    while studentized_range_tail(hi, k, df) > alpha and hi < 1e6:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if studentized_range_tail(mid, k, df) > alpha else (lo, mid)
    return (lo + hi) / 2


def _each(fn, *columns: pd.Series) -> pd.Series:
    rows = zip(*columns)
    return pd.Series([None if any(pd.isna(v) for v in r) else fn(*r) for r in rows], dtype=float)


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _each(f_tail, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_tail, t, df)


@F.pandas_udf(T.DoubleType())
def range_pvalue(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda a, b, c: studentized_range_tail(a, int(b), c), q, k, df)


@F.pandas_udf(T.DoubleType())
def range_critical(alpha: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    # Studies share few (groups, degrees of freedom) pairs: solve each once.
    known: dict = {}

    def one(a, b, c):
        if (a, b, c) not in known:
            known[a, b, c] = studentized_range_critical(a, int(b), c)
        return known[a, b, c]

    return _each(one, alpha, k, df)
