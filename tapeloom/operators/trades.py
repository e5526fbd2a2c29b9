"""Prints: volume increments, prevailing quotes and trade direction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .slices import Slices, last, ordered_scan, prev

# Rule identities stored beside a classification.
CLASSIFIER_VERSION = "quote-mid-tick-v1"
ALIGNMENT_VERSION = "latest-complete-depth-before-print-v1"


def classify(
    price: Column,
    bid: Column,
    ask: Column,
    last_differing: Column,
    age_ms: Column,
    bound_ms: float,
    increment: Column,
    last_quantity: Column,
) -> Column:
    """Quote rule, then tick rule, as struct<side, reason, degraded, coalesced>.

    The midpoint comparison is made in decimals, so a print exactly at the midpoint is exact.
    """
    dec = "decimal(20,8)"
    twice, both = price.cast(dec) * 2, bid.cast(dec) + ask.cast(dec)
    absent = bid.isNull() | ask.isNull() | age_ms.isNull()
    broken = (bid <= 0) | (ask <= 0) | (bid >= ask)
    degraded = absent | broken | (age_ms > bound_ms)
    reason = (
        F.when(absent, "no_prevailing_quote")
        .when(broken, "invalid_quote")
        .when(age_ms > bound_ms, "stale_quote")
        .when(twice != both, "quote_rule")
        .when(last_differing.isNull(), "no_prior_differing_trade")
        .otherwise("tick_rule")
    )
    side = (
        F.when(degraded, "unclassified")
        .when(twice > both, "buy")
        .when(twice < both, "sell")
        .when(price > last_differing, "buy")
        .when(price < last_differing, "sell")
        .otherwise("unclassified")
    )
    return F.struct(
        side.alias("side"),
        reason.alias("reason"),
        degraded.alias("degraded"),
        (increment > last_quantity).alias("coalesced"),
    )


def complete_quotes(
    depth: DataFrame, keys: Sequence[str], slices: Slices, *, ts: str = "ts_us", seq: str = "seq"
) -> DataFrame:
    """State changes of each depth channel: complete quotes, and clears at a reconnect.

    Input rows carry ``channel, update_side, reconnect, bids, asks``. A channel is complete once
    both sides were received since its last reconnect.
    """
    stamp = F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"))
    seen = ordered_scan(
        depth,
        [*keys, "channel"],
        [ts, seq],
        slices,
        {
            "bid_at": last(F.when(F.col("update_side") == "bid", stamp)),
            "ask_at": last(F.when(F.col("update_side") == "ask", stamp)),
            "reset_at": last(F.when(F.col("reconnect"), stamp)),
        },
    )

    def alive(c: str) -> Column:
        return F.coalesce(
            F.col(c).isNotNull() & (F.col("reset_at").isNull() | (F.col(c) >= F.col("reset_at"))),
            F.lit(False),
        )

    complete = (
        F.col("update_side").isin("bid", "ask")
        & alive("bid_at")
        & alive("ask_at")
        & (F.size("bids") > 0)
        & (F.size("asks") > 0)
    )
    return seen.where(complete | F.col("reconnect")).select(
        *keys,
        "channel",
        ts,
        seq,
        F.when(
            complete,
            F.struct(
                F.get(F.col("bids"), 0)["price"].alias("bid"),
                F.get(F.col("asks"), 0)["price"].alias("ask"),
                F.col("bid_at.ts").alias("bid_ts"),
                F.col("ask_at.ts").alias("ask_ts"),
            ),
        ).alias("quote"),
    )


def classify_prints(
    prints: DataFrame,
    depth: DataFrame,
    keys: Sequence[str],
    slices: Slices,
    *,
    bound_ms: float,
    channels: Sequence[str],
    ts: str = "ts_us",
    seq: str = "seq",
) -> DataFrame:
    """Positive-volume prints with increment, prevailing quote, age and classified side.

    ``prints`` carry ``price, last_quantity, cumulative_volume``. The prevailing quote is the
    newest complete candidate over the channels, ties by channel name; its age is that of the
    older leg.
    """
    observed = prints.where(
        F.col("price").isNotNull()
        & F.col("last_quantity").isNotNull()
        & F.col("cumulative_volume").isNotNull()
    )
    stepped = ordered_scan(
        observed, keys, [ts, seq], slices, {"p0": prev("price"), "v0": prev("cumulative_volume")}
    ).withColumn("turn", F.when(F.col("price") != F.col("p0"), F.col("p0")))
    # Both inputs of the merge are read twice by it. Stored once they are narrow rows; left lazy,
    # the ladders would be scanned again each time.
    stepped = cut_lineage(stepped)
    quotes = cut_lineage(complete_quotes(depth, keys, slices, ts=ts, seq=seq))
    wrapped = F.struct(F.col("quote").alias("q"), F.col("channel").alias("ch"))
    left = stepped.select(*keys, ts, seq, F.struct(*[F.col(c) for c in stepped.columns]).alias("print"))
    right = quotes.select(
        *keys, ts, seq, *[F.when(F.col("channel") == c, wrapped).alias(f"q_{i}") for i, c in enumerate(channels)]
    )
    axis = left.unionByName(right, allowMissingColumns=True)
    outs = {f"s_{i}": last(f"q_{i}") for i in range(len(channels))}
    outs["differing"] = last("print.turn")
    merged = ordered_scan(axis, keys, [ts, seq], slices, outs).where(F.col("print").isNotNull())

    def newest(i: int) -> Column:
        q = F.col(f"s_{i}.q")
        return F.when(
            q.isNotNull(),
            F.struct(
                F.greatest(q["bid_ts"], q["ask_ts"]).alias("at"),
                F.col(f"s_{i}.ch").alias("channel"),
                q.alias("q"),
            ),
        )

    picks = [newest(i) for i in range(len(channels))]
    best = F.array_max(F.array(*picks)) if len(picks) > 1 else picks[0]
    age = (F.col(ts) - F.least(F.col("best.q.bid_ts"), F.col("best.q.ask_ts"))) / 1000.0
    rows = (
        merged.withColumn("best", best)
        .select(
            "print.*",
            "differing",
            F.col("best.channel").alias("quote_channel"),
            F.col("best.q.bid").alias("quote_bid"),
            F.col("best.q.ask").alias("quote_ask"),
            F.col("best.at").alias("quote_ts"),
            age.alias("quote_age_ms"),
            (F.col("print.cumulative_volume") - F.col("print.v0")).alias("volume_increment"),
        )
        .where(F.col("volume_increment") > 0)
    )
    call = classify(
        F.col("price"), F.col("quote_bid"), F.col("quote_ask"), F.col("differing"), F.col("quote_age_ms"),
        bound_ms, F.col("volume_increment"), F.col("last_quantity"),
    )
    return rows.withColumn("call", call).select(
        *[c for c in prints.columns],
        "volume_increment",
        "quote_channel",
        "quote_bid",
        "quote_ask",
        "quote_ts",
        "quote_age_ms",
        F.col("differing").alias("last_differing_price"),
        "call.*",
    )


def signed_eligibility(c=F.col, classifier: str = CLASSIFIER_VERSION) -> Column:
    """First reason a classified print is left out of the signed-trade series (null = usable)."""
    return (
        F.when(c("volume_increment").isNull() | (c("volume_increment") <= 0), "no_volume_increment")
        .when(c("classifier_version").isNull() | (c("classifier_version") != classifier), "wrong_classifier_version")
        .when(c("coalesced"), "coalesced")
        .when(c("degraded"), "degraded")
        .when(~c("side").isin("buy", "sell"), "unsigned_side")
        .when(c("last_quantity") <= 0, "unusable_quantity")
    )
