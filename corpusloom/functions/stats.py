"""Student's t tail probability, vectorised over already aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    value = d.copy()
    for m in range(1, 500):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            value = value * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return value


def student_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) for ``df`` degrees of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    a, b = df / 2.0, np.full_like(df, 0.5)
    x = df / (df + t * t)
    swap = x >= (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(
            log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z)
        )
    beta = front * _beta_fraction(p, q, z) / p
    beta = np.where(z <= 0, 0.0, beta)
    two_sided = np.where(swap, 1.0 - beta, beta)
    return np.where(t > 0, two_sided / 2.0, 1.0 - two_sided / 2.0)


def t_tail(t: Column, df: Column) -> Column:
    """Column form of :func:`student_tail`; null where there is no spread to test."""

    @F.pandas_udf("double")
    def run(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        ok = ts.notna() & (dfs > 0)
        out = pd.Series(np.nan, index=ts.index)
        if ok.any():
            out[ok] = student_tail(ts[ok].to_numpy(float), dfs[ok].to_numpy(float))
        return out.astype(object).where(ok, None)

    return run(t.cast("double"), df.cast("double"))


def t_tail_closed(t: Column, df: Column) -> Column:
    """Closed forms for 1, 2 and 3 degrees of freedom; null beyond."""
    pi = F.lit(math.pi)
    one = F.lit(0.5) - F.atan(t) / pi
    two = F.lit(0.5) - t / (F.lit(2.0) * F.sqrt(F.lit(2.0) + t * t))
    u = t / F.sqrt(F.lit(3.0))
    three = F.lit(0.5) - (u / (F.lit(1.0) + u * u) + F.atan(u)) / pi
    return F.when(df == 1, one).when(df == 2, two).when(df == 3, three)
