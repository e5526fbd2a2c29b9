"""Tails of the usual test statistics as columns; their inputs are one row for each test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    log_gamma = np.frompyfunc(math.lgamma, 1, 1)
    return (log_gamma(a) + log_gamma(b) - log_gamma(a + b)).astype(float)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's recurrence."""
    tiny = 1e-300
    nonzero = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1.0 / nonzero(1.0 - (a + b) * x / (a + 1.0))
    out = d.copy()
    for m in range(1, 2000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / nonzero(1.0 + step * d)
            c = nonzero(1.0 + step / c)
            change = c * d
            out = out * change
        if np.all(np.abs(change - 1.0) < 1e-15):
            break
    return out


def incomplete_beta_values(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, elementwise; nan where an input is nan or out of range."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)], out[ok & (x == 1)] = 0.0, 1.0
    inner = ok & (x > 0) & (x < 1)
    if inner.any():
        p, q, v = a[inner], b[inner], x[inner]
        swap = v > (p + 1) / (p + q + 2)
        p, q, v = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - v, v)
        front = np.exp(p * np.log(v) + q * np.log1p(-v) - _log_beta(p, q)) / p
        part = front * _fraction(p, q, v)
        out[inner] = np.where(swap, 1 - part, part)
    return out


def _incomplete_beta(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(incomplete_beta_values(a.to_numpy(dtype=float), b.to_numpy(dtype=float), x.to_numpy(dtype=float)))


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    return F.pandas_udf(_incomplete_beta, "double")(a.cast("double"), b.cast("double"), x.cast("double"))


def student_two_sided(t: Column, df: Column) -> Column:
    """Chance of a Student t at least this far from zero."""
    return incomplete_beta(df / 2.0, F.lit(0.5), df / (df + t * t))


def f_upper(f: Column, df1: Column, df2: Column) -> Column:
    """Chance of an F at least this large."""
    return F.when(f >= 0, incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f)))


def _normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([math.nan if v is None or v != v else math.erfc(abs(v) / math.sqrt(2.0)) for v in z])


def normal_two_sided(z: Column) -> Column:
    """Chance of a standard normal at least this far from zero, exact in the far tail too."""
    return F.pandas_udf(_normal_two_sided, "double")(z.cast("double"))


def fisher_two_sided_value(a: float, b: float, c: float, d: float) -> float:
    """Fisher's exact test of the table ((a, b), (c, d)): tables with the same margins that are at most as likely.

    Logs of probabilities come from those of the neighbouring tables, outward from the most likely one, and
    end where they no longer matter, so large tables cost about their standard deviation.
    """
    if any(v != v or v < 0 for v in (a, b, c, d)):
        return math.nan
    row, column, n = a + b, a + c, a + b + c + d
    if min(row, n - row, column, n - column) == 0:
        return 1.0
    low, high = max(0.0, row + column - n), min(row, column)
    mode = min(max(math.floor((row + 1) * (column + 1) / (n + 2)), low), high)

    def log_p(x: float) -> float:
        g = math.lgamma
        return g(row + 1) - g(x + 1) - g(row - x + 1) + g(n - row + 1) - g(column - x + 1) - g(n - row - column + x + 1) - g(n + 1) + g(column + 1) + g(n - column + 1)

    limit, total = log_p(a) + 1e-7, 0.0
    for step in (1, -1):
        x, p = (mode, log_p(mode)) if step == 1 else (mode - 1, log_p(mode - 1) if mode > low else -math.inf)
        while low <= x <= high and p > -745.0:
            if p <= limit:
                total += math.exp(p)
            # Odds of the next table over this one.
            up = (row - x) * (column - x), (x + 1) * (n - row - column + x + 1)
            down = x * (n - row - column + x), (row - x + 1) * (column - x + 1)
            over, under = up if step == 1 else down
            if over <= 0:
                break
            x, p = x + step, p + math.log(over / under)
    return min(1.0, total)


def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided_value(*map(float, v)) for v in zip(a, b, c, d, strict=True)])


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.pandas_udf(_fisher, "double")(*[v.cast("double") for v in (a, b, c, d)])
