"""Tail probabilities and the noncentral t, for the few statistics rows that need them.

The inputs are aggregated statistics (one row per comparison), so these are
small vectorised helpers on already reduced data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * front
    # modified Lentz continued fraction
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return h * front


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / d
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + num * d)
            c = 1.0 + num / c
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def student_two_sided(t: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + t * t))


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def nct_cdf(t: float, df: float, delta: float) -> float:
    """CDF of the noncentral t distribution as a Poisson-weighted beta series."""
    if t < 0:
        return 1.0 - nct_cdf(-t, df, -delta)
    total = normal_cdf(-delta)
    x = t * t / (t * t + df)
    if x <= 0:
        return total
    half = delta * delta / 2
    centre = int(half)
    acc = 0.0
    # terms fall off on both sides of the Poisson mode
    for direction in (1, -1):
        j = centre if direction == 1 else centre - 1
        while j >= 0:
            # log weights keep large delta from underflowing; delta = 0 leaves j = 0 only
            log_pois = -half + (j * math.log(half) if half > 0 else (0.0 if j == 0 else -math.inf))
            p = math.exp(log_pois - math.lgamma(j + 1))
            q = 0.0
            if half > 0:
                q = math.copysign(math.exp(-half + (j + 0.5) * math.log(half) - math.lgamma(j + 1.5)), delta)
            term = p * beta_i(j + 0.5, df / 2, x) + q * beta_i(j + 1.0, df / 2, x)
            acc += term
            if abs(p) + abs(q) < 1e-17:
                break
            j += direction
    return min(1.0, max(0.0, total + 0.5 * acc))


def nct_noncentrality(t: float, df: float, p: float) -> float:
    """The noncentrality at which the CDF at ``t`` equals ``p`` (decreasing in it)."""
    lo, hi = t - 4.0, t + 4.0
    while nct_cdf(t, df, lo) < p:
        lo -= 4.0
    while nct_cdf(t, df, hi) > p:
        hi += 4.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if nct_cdf(t, df, mid) > p else (lo, mid)
    return 0.5 * (lo + hi)


def _vectorise(fn, *series: pd.Series) -> pd.Series:
    rows = np.column_stack([s.to_numpy(dtype=float) for s in series])
    return pd.Series([fn(*r) if np.isfinite(r).all() else None for r in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return _vectorise(lambda v, d: gamma_q(d / 2, v / 2), x, df)


@F.pandas_udf(T.DoubleType())
def _t2(t: pd.Series, df: pd.Series) -> pd.Series:
    return _vectorise(student_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def _delta(t: pd.Series, df: pd.Series, p: pd.Series) -> pd.Series:
    return _vectorise(nct_noncentrality, t, df, p)


def _d(value: Column | str | float) -> Column:
    if isinstance(value, str):
        return F.col(value).cast("double")
    return value.cast("double") if isinstance(value, Column) else F.lit(float(value))


def chi2_sf(x, df) -> Column:
    """Upper tail of the chi-square distribution."""
    return _chi2(_d(x), _d(df))


def t_two_sided(t, df) -> Column:
    """Two-sided Student t probability."""
    return _t2(_d(t), _d(df))


def nct_delta(t, df, p) -> Column:
    """Noncentrality parameter with CDF value ``p`` at ``t``."""
    return _delta(_d(t), _d(df), _d(p))
