"""Forecast evaluation: scores, sign accuracy, costs, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slices import Slices, ordered_scan, prev

# Cost arms as (name, fee in ticks, charges the half spread each side).
COST_ARMS = (
    ("gross", 0.0, False),
    ("half_spread_only", 0.0, True),
)


def win_score(prediction: Column, actual: Column) -> Column:
    """+1 when the move reaches the forecast, -1 when it reaches its mirror, else 0."""
    return (
        F.when((prediction > 0) & (actual >= prediction), 1)
        .when((prediction > 0) & (actual <= -prediction), -1)
        .when((prediction < 0) & (actual <= prediction), 1)
        .when((prediction < 0) & (actual >= -prediction), -1)
        .otherwise(0)
    )


def sign_accuracy(df: DataFrame, groups: Sequence[str], predicted: str, realised: str) -> DataFrame:
    """Hit rate against a coin and against the majority class, on all and on non-zero moves."""
    rows = df.where(F.col(predicted).isNotNull() & F.col(realised).isNotNull())
    p, y = F.signum(predicted), F.signum(realised)
    flat = rows.select(*groups, p.alias("p"), y.alias("y"), F.explode(F.when(y != 0, F.array(F.lit("all_rows"), F.lit("non_zero_moves"))).otherwise(F.array(F.lit("all_rows")))).alias("panel"))
    n = F.count(F.lit(1))

    def share(cond: Column) -> Column:
        return F.count(F.when(cond, 1)) / n

    agg = flat.groupBy(*groups, "panel").agg(
        n.alias("n"),
        F.count(F.when(F.col("p") == F.col("y"), 1)).alias("hits"),
        share(F.col("y") > 0).alias("up_share"),
        share(F.col("y") < 0).alias("down_share"),
        share(F.col("y") == 0).alias("flat_share"),
    )
    rate = F.col("hits") / F.col("n")
    majority = F.greatest("up_share", "down_share", "flat_share")
    return (
        agg.withColumn("hit_rate", rate)
        .withColumn("majority_class_share", majority)
        .withColumn("excess_over_coin_flip", rate - 0.5)
        .withColumn("excess_over_majority_class", rate - majority)
        .withColumn("binomial_standard_error", F.sqrt(rate * (1 - rate) / F.col("n")))
    )


def net_of_cost_pnl(
    df: DataFrame, groups: Sequence[str], order_by: Sequence[str], predicted: str, realised: str, spread: str,
    slices: Slices, arms: Sequence[tuple[str, float, bool]] = COST_ARMS,
) -> DataFrame:
    """Unit position when |forecast| exceeds the spread, per cost arm, with turnover."""
    rows = df.where(
        F.col(predicted).isNotNull() & F.col(realised).isNotNull() & (F.col(spread) >= 0)
    ).withColumn("__pos", F.when(F.abs(predicted) > F.col(spread), F.signum(predicted)).otherwise(0.0))
    stepped = ordered_scan(rows, groups, order_by, slices, {"__before": prev("__pos")})
    turn = F.abs(F.col("__pos") - F.coalesce(F.col("__before"), F.lit(0.0)))
    traded = F.col("__pos") != 0
    options = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(f).alias("fee"), F.lit(h).alias("half")) for n, f, h in arms]
    )
    flat = stepped.withColumn("__arm", F.explode(options))
    charge = F.when(traded, F.col("__arm.fee") + F.when(F.col("__arm.half"), F.col(spread)).otherwise(0.0)).otherwise(0.0)
    net = F.col("__pos") * F.col(realised) - charge
    return (
        flat.withColumn("__net", net)
        .withColumn("__turn", turn)
        .groupBy(*groups, F.col("__arm.name").alias("cost_arm"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(F.when(traded, 1)).alias("trades"),
            F.sum("__turn").alias("turnover"),
            F.sum("__net").alias("total_pnl"),
            F.avg(F.when(traded, F.col("__net"))).alias("mean_pnl_per_trade"),
            (F.avg("__net") / F.when(F.stddev_samp("__net") > 0, F.stddev_samp("__net"))).alias("pnl_per_unit_risk"),
        )
    )


def past_mirror_verdict(future: Column, past: Column, two_sided: bool = False) -> Column:
    """Whether a headline survives its past mirror."""
    passes = F.abs(future) > F.abs(past) if two_sided else future > past
    return F.when(future.isNull() | past.isNull(), "unevaluable").when(passes, "passes").otherwise("fails_past_mirror")


def r_squared(df: DataFrame, groups: Sequence[str], y: str, prediction: str) -> DataFrame:
    """Out-of-sample R² against the mean of the scored rows."""
    rows = df.where(F.col(y).isNotNull() & F.col(prediction).isNotNull())
    e = F.col(y) - F.col(prediction)
    agg = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count(F.lit(1))).alias("sst"), F.avg(F.abs(e)).alias("mae")
    )
    return agg.select(*groups, "n", F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).alias("r2"), "mae")
