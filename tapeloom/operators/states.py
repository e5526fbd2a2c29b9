"""Collapsed book states, revealed touches, ladder comparison and rolling state labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slices import Slices, sliding


def collapse_bursts(
    df: DataFrame, keys: Sequence[str], seq: str, keep: Sequence[str], flags: str
) -> DataFrame:
    """One state per burst: the last row's fields, the union of flags, the burst size."""
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("rows_in_burst"),
            F.max_by(F.struct(seq, *keep), seq).alias("__last"),
            # Flags come from a fixed vocabulary, so this set stays small in any burst.
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(flags)))).alias(flags),
        )
        .select(*keys, "rows_in_burst", "__last.*", flags)
    )


def effective_touch(
    anchors: DataFrame, prints: DataFrame, keys: Sequence[str], slices: Slices, *, window: int, ts: str = "ts_us"
) -> DataFrame:
    """Touch revealed by signed prints strictly inside ``(t - window, t)``; crossed is undefined."""
    rows = prints.select(*keys, ts, F.col("price").alias("__p"), F.col("side").alias("__s"))
    axis = anchors.withColumn("__a", F.lit(True)).unionByName(rows, allowMissingColumns=True)
    buy, sell = F.col("__s") == "buy", F.col("__s") == "sell"

    def over(agg):
        return lambda fr: agg.over(fr(-window + 1, -1))

    out = sliding(
        axis, keys, ts, slices,
        {
            "effective_ask": over(F.min(F.when(buy, F.col("__p")))),
            "effective_bid": over(F.max(F.when(sell, F.col("__p")))),
            "buy_prints": over(F.count(F.when(buy, 1))),
            "sell_prints": over(F.count(F.when(sell, 1))),
            "newest": over(F.max(F.when(F.col("__s").isNotNull(), F.col(ts)))),
        },
        back=window,
    ).where(F.col("__a"))
    bid, ask = F.col("effective_bid"), F.col("effective_ask")
    return (
        out.drop("__a", "__p", "__s")
        .withColumn("crossed", F.coalesce(bid >= ask, F.lit(False)))
        .withColumn("mid", F.when(bid < ask, (bid + ask) / 2.0))
    )


def compare_ladders(bids: str, asks: str, other_bids: str, other_asks: str, levels: int) -> dict[str, Column]:
    """Agreement of two books at four granularities over ``levels`` levels."""

    def equal(i: int, field: str) -> Column:
        pairs = ((bids, other_bids), (asks, other_asks))
        a, b = (F.get(F.col(x), i)[field] == F.get(F.col(y), i)[field] for x, y in pairs)
        return a & b

    price = [equal(i, "price") for i in range(levels)]
    fields = [price[i] & equal(i, "quantity") & equal(i, "orders") for i in range(levels)]

    def every(parts: list[Column]) -> Column:
        out = parts[0]
        for part in parts[1:]:
            out = out & part
        return out

    return {
        "level1_price_equal": price[0],
        "level1_all_fields_equal": fields[0],
        "all_levels_price_equal": every(price),
        "all_levels_all_fields_equal": every(fields),
    }


def tertile_state(value: Column, q_low: Column, q_high: Column) -> Column:
    """low below the lower edge, high above the upper one, mid between; null when undefined."""
    return F.when(value < q_low, "low").when(value > q_high, "high").when(
        value.isNotNull() & q_low.isNotNull() & q_high.isNotNull(), "mid"
    )


def trend_label(efficiency: Column) -> Column:
    return (
        F.when(efficiency <= 0.30, "choppy").when(efficiency >= 0.65, "trending").when(efficiency.isNotNull(), "mixed")
    )


# The named gates and the states each one requires.
GATES = {
    "parity_highvol_tightspread": (("volatility", "high"), ("spread", "low")),
    "order_count_large_midday": (("strength", "high"), ("bucket", "midday")),
    "l1_quantity_lowvol_middepth": (("volatility", "low"), ("depth", "mid")),
    "microprice_large_close": (("strength", "high"), ("bucket", "close")),
    "reversal_large_move_mid_parity_dispersion": (("strength", "high"), ("parity_noise", "mid")),
    "surface_diff_large_noisy_parity": (("strength", "high"), ("parity_noise", "high")),
    "own_ce_surface_noisy_choppy": (("parity_noise", "high"), ("trend", "choppy")),
    "own_pe_surface_noisy_midvol": (("parity_noise", "high"), ("volatility", "mid")),
    "fast_ofi_lowvol_trending": (("volatility", "low"), ("trend", "trending")),
    "atm_iv_reversal_mid_vov": (("vov", "mid"),),
}


def gate(name: str, states: dict[str, Column]) -> Column:
    """A named gate as a boolean, null when any state it reads is missing."""
    known, met = F.lit(True), F.lit(True)
    for state, wanted in GATES[name]:
        known = known & states[state].isNotNull()
        met = met & (states[state] == wanted)
    return F.when(known, met)
