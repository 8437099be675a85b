"""Special functions in numpy: psi functions, incomplete beta, tail probabilities; and UDFs for the two tails."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Distance of the standard normal's quartiles.
QUARTILE_SPAN = 1.3489795003921634


def _shifted(x: float, term, series) -> float:
    total = 0.0
    while x < 10:
        total += term(x)
        x += 1
    return total + series(x)


def digamma(x: float) -> float:
    return _shifted(x, lambda v: -1 / v, lambda v: math.log(v) - 1 / (2 * v) - 1 / (12 * v**2) + 1 / (120 * v**4) - 1 / (252 * v**6) + 1 / (240 * v**8) - 5 / (660 * v**10))


def trigamma(x: float) -> float:
    return _shifted(x, lambda v: 1 / v**2, lambda v: 1 / v + 1 / (2 * v**2) + 1 / (6 * v**3) - 1 / (30 * v**5) + 1 / (42 * v**7) - 1 / (30 * v**9) + 5 / (66 * v**11))


def tetragamma(x: float) -> float:
    return _shifted(x, lambda v: -2 / v**3, lambda v: -1 / v**2 - 1 / v**3 - 1 / (2 * v**4) + 1 / (6 * v**6) - 1 / (6 * v**8) + 3 / (10 * v**10) - 5 / (6 * v**12))


def trigamma_inverse(x: float, tol: float = 1e-8, iter_limit: int = 50) -> float:
    """y with trigamma(y) = x, by Newton steps on 1/trigamma, which is nearly linear."""
    y = 0.5 + 1 / x
    for _ in range(iter_limit):
        t = trigamma(y)
        step = t * (1 - t / x) / tetragamma(y)
        y += step
        if -step / y < tol:
            break
    return y


def log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def _fraction(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def betainc(a: float, b: float, x) -> np.ndarray:
    """Regularised incomplete beta function for scalars a, b and an array x."""
    x = np.clip(np.asarray(x, float), 0, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) - log_beta(a, b))
    low = x < (a + 1) / (a + b + 2)
    out = np.where(low, front * _fraction(a, b, np.where(low, x, 0.0)) / a, 1 - front * _fraction(b, a, np.where(low, 0.0, 1 - x)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t, df: float) -> np.ndarray:
    """Two-sided p-value of Student's t; infinite degrees of freedom give the normal's."""
    t = np.abs(np.asarray(t, float))
    if not math.isfinite(df):
        return np.array([math.erfc(v / math.sqrt(2)) for v in np.ravel(t)]).reshape(t.shape)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.where(np.isinf(t), 0.0, df / (df + t * t))
    return np.where(np.isnan(t), np.nan, betainc(df / 2, 0.5, x))


def chi2_tail(stat) -> np.ndarray:
    """Tail probability of chi-square with one degree of freedom."""
    stat = np.asarray(stat, float)
    return np.array([math.erfc(math.sqrt(v / 2)) for v in np.ravel(stat)]).reshape(stat.shape)


def normal_tail(z) -> np.ndarray:
    z = np.asarray(z, float)
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in np.ravel(z)]).reshape(z.shape)


def t_p_value(t: Column, df: Column) -> Column:
    @pandas_udf(DoubleType())
    def p(t_: pd.Series, df_: pd.Series) -> pd.Series:
        out = np.empty(len(t_))
        for d in df_.unique():
            at = (df_ == d).to_numpy()
            out[at] = t_two_sided(t_.to_numpy()[at], float(d))
        return pd.Series(out)

    return p(t, df)


def chi2_p_value(stat: Column) -> Column:
    @pandas_udf(DoubleType())
    def p(s: pd.Series) -> pd.Series:
        return pd.Series(chi2_tail(s.to_numpy()))

    return p(stat)
