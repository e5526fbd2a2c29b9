"""Option-chain operators over a minute panel: date, clock, side (CALL|PUT), strike, close, iv, oi, spot, volume."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.options import CONSENSUS_OFFSETS, MIN_CONSENSUS_PAIRS, STRIKE_STEP, gamma, nearest_strike
from .slices import Slices, ordered_scan, run_sum, total


def best_quote_per_minute(df: DataFrame, keys: Sequence[str], volume: str, keep: Sequence[str]) -> DataFrame:
    """Highest-volume row per contract-minute; equal volumes fall to the larger remaining fields."""
    return df.groupBy(*keys).agg(F.max(F.struct(volume, *[k for k in keep if k != volume])).alias("__b")).select(*keys, "__b.*")


def sides(panel: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per (keys, strike) with call_* and put_* fields."""
    def pick(side: str, f: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(f))).alias(f"{'call' if side == 'CALL' else 'put'}_{f}")

    return panel.groupBy(*keys, "strike").agg(*[pick(s, f) for s in ("CALL", "PUT") for f in fields])


def nearest_listed_strike(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strike nearest the spot with both sides quoted; the lower strike on a tie."""
    paired = sides(panel, [*keys, "spot"], ["close"]).where(F.col("call_close").isNotNull() & F.col("put_close").isNotNull())
    return paired.groupBy(*keys).agg(
        F.min_by("strike", F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("strike"))).alias("atm_strike")
    )


def contract_price(at: DataFrame, panel: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Attach the close of the same contract (side, strike) at other instants by equi-join."""
    return at.join(panel.select(*on, F.col("close").alias(name)), list(on), "left")


def straddle_pnl(panel: DataFrame, entry_clock: str, exit_clock: str) -> DataFrame:
    """At-the-money straddle bought at one clock and valued at another on the same date."""
    entry = panel.where(F.col("clock") == entry_clock)
    atm = nearest_listed_strike(entry, ["date"])
    legs = panel.where(F.col("clock").isin(entry_clock, exit_clock)).join(
        atm.withColumnRenamed("atm_strike", "strike"), ["date", "strike"], "left_semi"
    )
    wide = legs.groupBy("date", F.col("strike").alias("atm_strike")).agg(
        *[
            F.max(F.when((F.col("clock") == c) & (F.col("side") == s), F.col("close"))).alias(f"{n}_{s}")
            for n, c in (("entry", entry_clock), ("exit", exit_clock))
            for s in ("CALL", "PUT")
        ]
    )
    a, b = F.col("entry_CALL") + F.col("entry_PUT"), F.col("exit_CALL") + F.col("exit_PUT")
    return wide.where(a.isNotNull() & b.isNotNull()).select(
        "date", "atm_strike", a.alias("entry_premium"), b.alias("exit_premium"),
        (b - a).alias("buyer_pnl"), (100 * (b - a) / a).alias("buyer_return_pct"),
    )


def put_call_ratio(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    c = F.sum(F.when(F.col("side") == "CALL", F.col("oi")))
    p = F.sum(F.when(F.col("side") == "PUT", F.col("oi")))
    agg = panel.groupBy(*keys).agg(c.alias("call_oi"), p.alias("put_oi"))
    return agg.where((F.col("call_oi") > 0) & (F.col("put_oi") > 0)).withColumn("pcr", F.col("put_oi") / F.col("call_oi"))


def max_pain(panel: DataFrame, keys: Sequence[str], slices: Slices) -> DataFrame:
    """Strike with the least holder payout at settlement.

    The payout at every strike is a difference of running sums over strikes, so no strike is ever
    paired with another.
    """
    k = F.col("strike")
    oi = panel.groupBy(*keys, "strike").agg(
        F.coalesce(F.sum(F.when(F.col("side") == "CALL", F.col("oi"))), F.lit(0.0)).alias("c"),
        F.coalesce(F.sum(F.when(F.col("side") == "PUT", F.col("oi"))), F.lit(0.0)).alias("p"),
    )
    run = ordered_scan(
        oi, keys, ["strike"], slices,
        {
            "c_n": run_sum("c"), "c_k": run_sum(F.col("c") * k), "p_n": run_sum("p"), "p_k": run_sum(F.col("p") * k),
            "pt_n": total("p"), "pt_k": total(F.col("p") * k),
        },
    )
    loss = (k * F.col("c_n") - F.col("c_k")) + ((F.col("pt_k") - F.col("p_k")) - k * (F.col("pt_n") - F.col("p_n")))
    return run.withColumn("loss", loss).groupBy(*keys).agg(
        F.min_by("strike", F.struct(F.round("loss", 6), F.col("strike"))).alias("max_pain"), F.round(F.min("loss"), 4).alias("payout")
    )


def forward_consensus(paired: DataFrame, keys: Sequence[str], spot: str) -> DataFrame:
    """Median parity forward over the fixed strike offsets around the money (the money itself out)."""
    centre = nearest_strike(F.col(spot))
    offset = (F.col("strike") - centre) / F.lit(STRIKE_STEP)
    fwd = F.col("strike") + F.col("call_close") - F.col("put_close")
    rows = paired.where(offset.isin(*[float(o) for o in CONSENSUS_OFFSETS]) & fwd.isNotNull())
    # At most eight strikes survive per key, so the exact median buffer is fixed in size.
    agg = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.percentile(fwd, 0.5).alias("m"), (F.max(fwd) - F.min(fwd)).alias("d"))
    ok = F.col("pairs") >= MIN_CONSENSUS_PAIRS
    return agg.select(
        *keys, "pairs", F.when(ok, F.col("m")).alias("forward"), F.when(ok, F.col("d")).alias("dispersion"),
        F.when(~ok, F.lit("fewer_than_five_fresh_exatm_pairs")).alias("reason"),
    )


def select_forward(futures: DataFrame, paired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Traded future first, else the parity forward at the least call-put difference."""
    parity = paired.where(F.col("call_close").isNotNull() & F.col("put_close").isNotNull()).groupBy(*keys).agg(
        F.min_by(
            F.col("strike") + F.col("call_close") - F.col("put_close"),
            F.struct(F.abs(F.col("call_close") - F.col("put_close")), F.col("strike")),
        ).alias("parity_forward")
    )
    both = futures.join(parity, list(keys), "full")
    return both.select(
        *keys, F.coalesce("future", "parity_forward").alias("forward"),
        F.when(F.col("future").isNotNull(), "future").when(F.col("parity_forward").isNotNull(), "parity").otherwise("unresolved").alias("source"),
    )


def gamma_exposure(panel: DataFrame, keys: Sequence[str], years: float, rate: float, widths: Sequence[int]) -> DataFrame:
    """Gamma-weighted open interest by chain width: calls, puts and their imbalance."""
    g = gamma(F.col("spot"), F.col("strike"), F.lit(years), F.lit(rate), F.col("iv") / 100.0)
    dollars = g * F.col("oi") * F.col("spot") * F.col("spot") * 0.01
    offset = F.abs(F.round((F.col("strike") - nearest_strike(F.col("spot"))) / STRIKE_STEP))
    rows = panel.withColumn("g", dollars).withColumn("o", offset)

    def part(side: str, w: int) -> Column:
        return F.coalesce(F.sum(F.when((F.col("side") == side) & (F.col("o") <= w), F.col("g"))), F.lit(0.0))

    agg = rows.groupBy(*keys).agg(*[part(s, w).alias(f"{s}_{w}") for s in ("CALL", "PUT") for w in widths])
    cells = F.array(
        *[
            F.struct(F.lit(w).alias("width"), F.col(f"CALL_{w}").alias("gamma_call"), F.col(f"PUT_{w}").alias("gamma_put"))
            for w in widths
        ]
    )
    out = agg.select(*keys, F.inline(cells))
    c, p = F.col("gamma_call"), F.col("gamma_put")
    return out.withColumn("net", c - p).withColumn("imbalance", F.when(c + p > 0, (c - p) / (c + p)))


def concentration(df: DataFrame, keys: Sequence[str], item: Sequence[str], amount: str) -> DataFrame:
    """Herfindahl concentration of an amount over items."""
    per = df.groupBy(*keys, *item).agg(F.sum(amount).alias("a"))
    s, q = F.sum("a"), F.sum(F.col("a") * F.col("a"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), F.when(s > 0, q / (s * s)).alias("herfindahl"))


def eligibility(rules: Sequence[tuple[str, Column]]) -> Column:
    """Ordered refusal ladder: the first failing rule names the reason."""
    out = F.lit(None).cast("string")
    for name, failing in reversed(list(rules)):
        out = F.when(F.coalesce(failing, F.lit(True)), F.lit(name)).otherwise(out)
    return out


def _slice_model(z: np.ndarray, k: np.ndarray) -> np.ndarray:
    theta, rho, psi = np.exp(z[0]), 0.999 * np.tanh(z[1]), np.exp(z[2])
    core = np.sqrt((psi * k + theta * rho) ** 2 + theta**2 * (1 - rho**2))
    return 0.5 * (theta + rho * psi * k + core)


def _fit(k: np.ndarray, w: np.ndarray) -> tuple[float, float, float, float]:
    """Damped least squares for one slice, from a few fixed starting points."""
    middle = max(float(np.median(w)), 1e-6)
    best, loss = None, np.inf
    for rho0 in (-0.3, -0.7, 0.2):
        z = np.array([np.log(middle), np.arctanh(rho0 / 0.999), np.log(min(0.1, np.sqrt(2 * middle)))])
        damp, err = 1e-3, w - _slice_model(z, k)
        for _ in range(200):
            base = _slice_model(z, k)
            jac = np.stack([(_slice_model(z + np.eye(3)[i] * 1e-6, k) - base) / 1e-6 for i in range(3)], axis=1)
            normal, push = jac.T @ jac, jac.T @ err
            step = np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-18), push, rcond=None)[0]
            trial = np.clip(z + step, [-23, -4, -23], [1.6, 4, 1.38])
            new = w - _slice_model(trial, k)
            if new @ new < err @ err:
                done = err @ err - new @ new < 1e-22
                z, err, damp = trial, new, max(damp * 0.3, 1e-12)
                if done:
                    break
            else:
                damp *= 4
                if damp > 1e12:
                    break
        if err @ err < loss:
            best, loss = z, float(err @ err)
    return float(np.exp(best[0])), float(0.999 * np.tanh(best[1])), float(np.exp(best[2])), loss / len(k)


def fit_slices(points: DataFrame, keys: Sequence[str], k: str, w: str, minimum: int = MIN_CONSENSUS_PAIRS) -> DataFrame:
    """Surface slice per key from (log-moneyness, total variance) points, with a refusal reason.

    A slice holds one point per listed strike, so a group is small whatever the tape size.
    """
    schema = T.StructType(
        [
            *[points.schema[c] for c in keys],
            *[T.StructField(n, T.DoubleType()) for n in ("theta", "rho", "psi", "loss")],
            T.StructField("points", T.LongType()),
            T.StructField("reason", T.StringType()),
        ]
    )
    heads = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {c: pdf[c].iloc[0] for c in heads} | {"theta": None, "rho": None, "psi": None, "loss": None, "points": len(pdf), "reason": None}
        x, y = pdf[k].to_numpy(dtype=float), pdf[w].to_numpy(dtype=float)
        if len(pdf) < minimum:
            row["reason"] = "fewer_than_five_usable_strikes"
        elif not (np.isfinite(x).all() and np.isfinite(y).all() and (y > 0).all()):
            row["reason"] = "invalid_total_variance_inputs"
        else:
            theta, rho, psi, loss = _fit(x, y)
            if psi * (1 + abs(rho)) <= 4.0 and psi**2 * (1 + abs(rho)) <= 4.0 * theta:
                row |= {"theta": theta, "rho": rho, "psi": psi, "loss": loss}
            else:
                row["reason"] = "static_arbitrage_failed"
        return pd.DataFrame([row])

    return points.select(*keys, k, w).groupBy(*keys).applyInPandas(run, schema)
