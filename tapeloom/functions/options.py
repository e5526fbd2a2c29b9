"""Option columns: prices, implied volatility, greeks, surface forms, parity features, costs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SECONDS_PER_YEAR = 365.25 * 24.0 * 60.0 * 60.0
STRIKE_STEP = 50.0
CONSENSUS_OFFSETS = (-4, -3, -2, -1, 1, 2, 3, 4)
MIN_CONSENSUS_PAIRS = 5
_SQRT2 = math.sqrt(2.0)


_STEP, _EDGE = 1.0 / 64.0, 6.5
_GRID_ERF = np.array([math.erf(i * _STEP - _EDGE) for i in range(int(2 * _EDGE / _STEP) + 1)])


def _erf(x: np.ndarray) -> np.ndarray:
    """Error function of arrays: the exact value at the nearest grid point and seven Taylor terms from it."""
    inside = np.clip(np.nan_to_num(x), -_EDGE, _EDGE)
    i = np.rint((inside + _EDGE) / _STEP).astype(np.int64)
    at = i * _STEP - _EDGE
    h = inside - at
    before, slope = np.zeros_like(at), 2.0 / math.sqrt(math.pi) * np.exp(-at * at)
    total, power = _GRID_ERF[i], h.copy()
    for n in range(1, 8):
        total = total + slope * power
        before, slope = slope, -2.0 * at * slope - 2.0 * (n - 1) * before
        power = power * h / (n + 1)
    return np.where(np.isnan(x), np.nan, total)


def _cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + _erf(np.asarray(x, dtype=float) / _SQRT2))


def _price(fwd, strike, years, vol, rate, call):
    discount = np.exp(-rate * years)
    intrinsic = np.maximum(np.where(call, fwd - strike, strike - fwd), 0.0)
    root = np.maximum(vol, 1e-300) * np.sqrt(years)
    d1 = np.log(fwd / strike) / root + 0.5 * root
    d2 = d1 - root
    sign = np.where(call, 1.0, -1.0)
    value = discount * sign * (fwd * _cdf(sign * d1) - strike * _cdf(sign * d2))
    return np.where(vol == 0, discount * intrinsic, value)


def _arrays(*series: pd.Series) -> list[np.ndarray]:
    return [s.to_numpy(dtype=float) for s in series]


def _normal_cdf_batch(x: pd.Series) -> pd.Series:
    return pd.Series(_cdf(x.to_numpy(dtype=float)))


def _black76_batch(
    fwd: pd.Series, strike: pd.Series, years: pd.Series, vol: pd.Series, rate: pd.Series, call: pd.Series
) -> pd.Series:
    f, k, t, v, r = _arrays(fwd, strike, years, vol, rate)
    ok = (f > 0) & (k > 0) & (t > 0) & (v >= 0)
    out = np.full(len(f), np.nan)
    out[ok] = _price(f[ok], k[ok], t[ok], v[ok], r[ok], call.to_numpy(dtype=bool)[ok])
    return pd.Series(out).where(ok, None)


def _implied_vol_batch(
    price: pd.Series, fwd: pd.Series, strike: pd.Series, years: pd.Series, rate: pd.Series, call: pd.Series
) -> pd.Series:
    p, f, k, t, r = _arrays(price, fwd, strike, years, rate)
    c = call.to_numpy(dtype=bool)
    ok = (p > 0) & (f > 0) & (k > 0) & (t > 0)
    discount = np.exp(-r * t)
    intrinsic = discount * np.maximum(np.where(c, f - k, k - f), 0.0)
    ceiling = discount * np.where(c, f, k)
    tolerance = np.maximum(1e-10, ceiling * 1e-12)
    ok &= (p >= intrinsic - tolerance) & (p < ceiling)
    out = np.full(len(p), np.nan)
    idx = np.flatnonzero(ok)
    if len(idx):
        f, k, t, r, c, p = f[idx], k[idx], t[idx], r[idx], c[idx], p[idx]
        low, high = np.full(len(idx), 1e-8), np.full(len(idx), 5.0)
        reachable = _price(f, k, t, high, r, c) >= p
        vol = np.clip(np.sqrt(2.0 * math.pi / t) * p / (np.exp(-r * t) * f), 0.01, 2.0)
        # Newton steps inside a bracket that every price narrows; a step that leaves it is a bisection.
        for _ in range(100):
            gap = _price(f, k, t, vol, r, c) - p
            low, high = np.where(gap < 0, vol, low), np.where(gap < 0, high, vol)
            root = vol * np.sqrt(t)
            d1 = np.log(f / k) / root + 0.5 * root
            vega = np.exp(-r * t - 0.5 * d1 * d1) * f * np.sqrt(t) / math.sqrt(2.0 * math.pi)
            step = vol - gap / np.maximum(vega, 1e-300)
            new = np.where((step > low) & (step < high), step, 0.5 * (low + high))
            moved, vol = np.abs(new - vol).max(), new
            if moved < 1e-13:
                break
        out[idx] = np.where(reachable, vol, np.nan)
    return pd.Series(out).where(~np.isnan(out), None)


def _as_udf(batch):
    return F.pandas_udf(batch, "double")


def normal_cdf(x: Column) -> Column:
    return _as_udf(_normal_cdf_batch)(x)


def black76(fwd: Column, strike: Column, years: Column, vol: Column, rate: Column, call: Column) -> Column:
    """Discounted Black-76 value."""
    return _as_udf(_black76_batch)(fwd, strike, years, vol, rate, call)


def implied_vol(price: Column, fwd: Column, strike: Column, years: Column, rate: Column, call: Column) -> Column:
    """Black-76 volatility by bracketed Newton steps; null outside the no-arbitrage bounds."""
    return _as_udf(_implied_vol_batch)(price, fwd, strike, years, rate, call)


def gamma(spot: Column, strike: Column, years: Column, rate: Column, vol: Column) -> Column:
    """Black-Scholes gamma in plain columns; null unless every input is positive."""
    root = vol * F.sqrt(years)
    d1 = (F.log(spot / strike) + (rate + 0.5 * vol * vol) * years) / root
    return F.when(
        (spot > 0) & (strike > 0) & (vol > 0) & (years > 0),
        F.exp(-0.5 * d1 * d1) / F.lit(math.sqrt(2.0 * math.pi)) / (spot * root),
    )


def delta76(fwd: Column, strike: Column, years: Column, vol: Column, rate: Column, call: Column) -> Column:
    root = vol * F.sqrt(years)
    n = normal_cdf(F.log(fwd / strike) / root + 0.5 * root)
    return F.exp(-rate * years) * F.when(call, n).otherwise(n - 1.0)


def nearest_strike(x: Column, step: float = STRIKE_STEP) -> Column:
    """Nearest strike, ties up."""
    return F.floor(x / F.lit(step) + 0.5) * F.lit(step)


def total_variance(k: Column, theta: Column, rho: Column, psi: Column) -> Column:
    """Three-parameter surface slice: total variance at log-moneyness k."""
    core = F.sqrt((psi * k + theta * rho) ** 2 + theta * theta * (1.0 - rho * rho))
    return F.when((theta > 0) & (psi > 0) & F.abs(rho).between(0, 0.999), 0.5 * (theta + rho * psi * k + core))


def slice_is_arbitrage_free(theta: Column, rho: Column, psi: Column) -> Column:
    """Sufficient butterfly conditions of a slice."""
    wide = 1.0 + F.abs(rho)
    return (
        (theta > 0) & F.abs(rho).between(0, 0.999) & (psi > 0) & (psi * wide <= 4.0) & (psi * psi * wide <= 4.0 * theta)
    )


def atm_shape(theta: Column, rho: Column, psi: Column, years: Column) -> dict[str, Column]:
    """At-the-money level, skew and curvature of implied volatility from a slice."""
    sigma = F.sqrt(theta / years)
    w1 = rho * psi
    w2 = psi * psi * (1.0 - rho * rho) / (2.0 * theta)
    return {
        "level": sigma,
        "skew": w1 / (2.0 * sigma * years),
        "curvature": (w2 - w1 * w1 / (2.0 * theta)) / (2.0 * sigma * years),
    }


def butterfly_density(k: Column, w: Column, w1: Column, w2: Column) -> Column:
    """Risk-neutral density factor g(k); negative means butterfly arbitrage."""
    return (1 - k * w1 / (2 * w)) ** 2 - w1 * w1 / 4 * (1 / w + 0.25) + w2 / 2


def basis(future: Column, forward: Column) -> Column:
    return future - forward


def parity_pressure(raw: Column, slow: Column) -> Column:
    return -(raw - slow)


def fair_quality(pressure: Column, dispersion: Column) -> Column:
    return pressure / (dispersion + 0.25)


def sign_agreement(left: Column, right: Column, require_nonzero: bool = False) -> Column:
    same = F.when(F.signum(left) == F.signum(right), 1.0).otherwise(0.0)
    if require_nonzero:
        same = F.when((left == 0) | (right == 0), 0.0).otherwise(same)
    return F.when(left.isNotNull() & right.isNotNull(), same)


def convergence(pressure: Column, move: Column) -> Column:
    return F.signum(pressure) * move


def direction_alignment(buys: Column, call: Column) -> Column:
    return F.when(buys, 1.0).otherwise(-1.0) * F.when(call, 1.0).otherwise(-1.0)


def hedged_markout(option0: Column, option1: Column, beta: Column, future0: Column, future1: Column) -> Column:
    return (option1 - option0) - beta * (future1 - future0)


def basis_points(left: Column, right: Column) -> Column:
    return 10_000.0 * (left - right)


def leg_cost(premium: Column, quantity: Column, brokerage: float, exchange_rate: float, stt_rate: float, sell: Column) -> Column:
    """Round cost of one option leg: flat brokerage, exchange charge and a sell-side tax."""
    turnover = premium * quantity
    return F.lit(brokerage) + turnover * exchange_rate + F.when(sell, turnover * stt_rate).otherwise(0.0)


def cost_fraction(cost: Column, premium: Column, quantity: Column) -> Column:
    return F.when(premium * quantity > 0, 100.0 * cost / (premium * quantity))
