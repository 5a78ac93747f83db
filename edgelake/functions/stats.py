"""Statistics of returns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def student_p(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p-values of Student's t with n - 1 degrees of freedom, by the continued fraction of the incomplete beta function; NaN for fewer than two values."""
    t, n = np.broadcast_arrays(np.asarray(t, float), np.asarray(n, float))
    ok = np.isfinite(t) & (n >= 2)
    df = np.where(ok, n - 1, 1.0)
    x = df / (df + np.where(ok, t, 0.0) ** 2)
    inside = (x > 0) & (x < 1)
    x0 = np.where(inside, x, 0.5)
    a, b = df / 2, np.full(df.shape, 0.5)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    distinct, at = np.unique(df, return_inverse=True)  # few
    constant = (gamma((distinct + 1) / 2) - gamma(distinct / 2) - math.lgamma(0.5))[at].reshape(df.shape)
    front = np.exp(constant + a * np.log(x0) + b * np.log1p(-x0))
    swap = x0 >= (a + 1) / (a + b + 2)
    a, b, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x0, x0)
    c, d = np.ones(df.shape), 1 / (1 - (a + b) * z / (a + 1))
    total = d.copy()
    for m in range(1, 500):
        for step in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d)
            c = 1 + step / c
            total *= c * d
        if not (np.abs(c * d - 1) >= 1e-15).any():
            break
    tail = front * total / a
    return np.where(ok, np.where(inside, np.where(swap, 1 - tail, tail), (x >= 1).astype(float)), np.nan)


@F.pandas_udf(T.DoubleType())
def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(student_p(t.to_numpy(float), n.to_numpy(float)), dtype="float64")  # NaN becomes null


def t_statistic(x: Column) -> Column:
    """One-sample t of the mean against zero; null for one value or none, and without variance."""
    return F.try_divide(F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0)) / F.sqrt(F.count(x).cast("double")))


def win_rate(x: Column) -> Column:
    """Share of positive values; null counts as no win."""
    return F.avg(F.coalesce(x > 0, F.lit(False)).cast("double"))


def profit_factor(x: Column) -> Column:
    """Gains over losses; infinite without a loss."""
    gains, losses = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.coalesce(F.sum(F.when(x < 0, -x)), F.lit(0.0))
    return F.when(losses > 0, F.try_divide(gains, losses)).otherwise(F.lit(float("inf")))


def sharpe(x: Column) -> Column:
    deviation = F.stddev_samp(x)
    return F.when(deviation > 0, F.try_divide(F.avg(x), deviation) * math.sqrt(252)).otherwise(0.0)


def floored(x: Column, floor: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(floor)))
