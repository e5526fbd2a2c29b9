"""Feature tables: quality gates, interactions, policies and walk-forward bookkeeping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slices import Slices, sliding


def unpivot_features(df: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Wide features to (ids, feature, value)."""
    return df.unpivot(list(ids), list(names), "feature", "value")


def quality_gates(
    long: DataFrame, *, low: float, high: float, minimum_coverage: float, minimum_sd: float
) -> DataFrame:
    """Per-feature verdict on training rows: range, coverage, near-constant; first failure wins."""
    v = F.col("value")
    inside = v.between(low, high)
    agg = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("present"), F.count(F.when(~inside, 1)).alias("out_of_range"),
        F.stddev_pop(F.when(inside, v)).alias("sd"),
    )
    reason = (
        F.when(F.col("present") < minimum_coverage * F.col("rows"), "low_coverage")
        .when(F.col("out_of_range") > 0, "out_of_range")
        .when(F.coalesce(F.col("sd"), F.lit(0.0)) < minimum_sd, "near_constant")
    )
    return agg.withColumn("reason", reason)


def interaction(left: Column, right: Column, left_at: Column, right_at: Column) -> tuple[Column, Column]:
    """Product feature and its availability: the later of its parents'."""
    return left * right, F.greatest(left_at, right_at)


def failing_rules(rules: Mapping[str, Column]) -> Column:
    """Names of all failing rules of an acceptance policy, in policy order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(n)) for n, bad in rules.items()]))


def winsorise(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def sign_word(values: Sequence[Column]) -> Column:
    """``+-0`` word of several moves; null when one is missing."""
    return F.concat(*[F.when(v > 0, "+").when(v < 0, "-").when(v == 0, "0") for v in values])


def signed_magnitude(kind: Column, side: Column, magnitude: Column) -> Column:
    """Additions lean with their side, removals against it."""
    lean = F.when(kind.isin("addition", "quantity_increase", "order_count_increase"), 1.0).otherwise(-1.0)
    return lean * F.when(side == "bid", 1.0).otherwise(-1.0) * magnitude


def rolling_fit(
    df: DataFrame, keys: Sequence[str], ts: str, x: str, y: str, matured: int, window: int, slices: Slices
) -> DataFrame:
    """Slope and support at each row from rows whose label matured before it.

    A label at time u is known at ``u + matured``, so the training frame is
    ``[t - window, t - matured]``.
    """
    frames = {
        "train_rows": lambda f: F.count(y).over(f(-window, -matured)),
        "slope": lambda f: F.regr_slope(y, x).over(f(-window, -matured)),
    }
    return sliding(df, keys, ts, slices, frames, back=window)


def frozen_variance_forecast(coefficients: Sequence[float], terms: Sequence[Column]) -> Column:
    """``exp(b0 + sum b_i log term_i)``; null unless every term is positive."""
    total, ok = F.lit(coefficients[0]), F.lit(True)
    for b, term in zip(coefficients[1:], terms, strict=True):
        total, ok = total + F.lit(b) * F.log(F.when(term > 0, term)), ok & (term > 0)
    return F.when(ok, F.exp(total))
