"""Rank and exact tests: mid-ranks come from counts of distinct values, so no group is sorted in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special as S
from .regression import fit, moments, solve_moments
from .slices import Slices, ordered_scan, run_sum


def _mid_ranks(counted: DataFrame, groups: Sequence[str], value: str, slices: Slices) -> DataFrame:
    """``counted(groups, value, __n, ...)`` with ``rank``, the mean place of the value's rows."""
    run = ordered_scan(counted, groups, [value], slices, {"__upto": run_sum("__n")})
    return run.withColumn("rank", F.col("__upto") - (F.col("__n") - 1) / 2.0)


def _ties() -> Column:
    t = F.col("__n").cast("double")
    return F.sum(t * t * t - t)


def wilcoxon_signed_rank(df: DataFrame, groups: Sequence[str], value: str, slices: Slices) -> DataFrame:
    """(groups, n, zeros, w_plus, w_minus, statistic, z, p_value) of values against zero.

    Zeros are left out, equal sizes share a mid-rank, and the variance is corrected for them; the p-value is
    that of the normal limit, two-sided. Nothing but zeros gives statistic 0 and p 1. ``slices`` cut the size
    of the value.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    plus = F.count(F.when(F.col(value) > 0, 1))
    sized = known.groupBy(*groups, F.abs(value).alias("__size")).agg(F.count(F.lit(1)).alias("__n"), plus.alias("__plus"))
    zeros = known.groupBy(*groups).agg(F.count(F.when(F.col(value) == 0, 1)).alias("zeros"))
    ranked = _mid_ranks(sized.where("__size > 0"), groups, "__size", slices)
    sums = ranked.groupBy(*groups).agg(
        F.sum("__n").alias("n"), F.sum(F.col("rank") * F.col("__plus")).alias("w_plus"),
        F.sum(F.col("rank") * (F.col("__n") - F.col("__plus"))).alias("w_minus"), _ties().alias("__ties"),
    )
    out = zeros.join(sums, list(groups), "left") if groups else zeros.crossJoin(F.broadcast(sums))
    n = F.coalesce(F.col("n"), F.lit(0))
    least = F.least("w_plus", "w_minus")
    variance = (n * (n + 1) * (2 * n + 1) - F.col("__ties") / 2.0) / 24.0
    z = F.when(variance > 0, (least - n * (n + 1) / 4.0) / F.sqrt(variance))
    out = out.select(
        *groups, n.cast("long").alias("n"), "zeros", F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce("w_minus", F.lit(0.0)).alias("w_minus"),
        F.coalesce(least, F.lit(0.0)).alias("statistic"), z.alias("z"),
    )
    return out.withColumn("p_value", F.when(F.col("z").isNull(), 1.0).otherwise(S.normal_two_sided(F.col("z"))))


def mann_whitney(df: DataFrame, groups: Sequence[str], value: str, flag: Column, slices: Slices) -> DataFrame:
    """(groups, n1, n2, u1, u2, z, p_value, superiority) of flagged rows against the others.

    Mid-ranks for equal values, their correction of the variance, half a step of continuity, two-sided normal
    limit. ``superiority`` is the chance that a flagged value is larger, ties counting half. Rows without a
    value or flag take no part; one empty side, or only one value, gives nulls.
    """
    known = df.where(F.col(value).isNotNull()).withColumn("__f", flag).where("__f IS NOT NULL")
    counted = known.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__n"), F.count(F.when(F.col("__f"), 1)).alias("__own"))
    ranked = _mid_ranks(counted, groups, value, slices)
    sums = ranked.groupBy(*groups).agg(
        F.sum("__own").alias("n1"), F.sum(F.col("__n") - F.col("__own")).alias("n2"), F.sum(F.col("rank") * F.col("__own")).alias("__r"), _ties().alias("__ties")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.when((n1 > 0) & (n2 > 0), F.col("__r") - n1 * (n1 + 1) / 2.0)
    variance = n1 * n2 / 12.0 * ((n + 1) - F.col("__ties") / (n * (n - 1)))
    z = F.when(u1.isNotNull() & (variance > 0), (F.greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5) / F.sqrt(variance))
    out = sums.select(*groups, "n1", "n2", u1.alias("u1"), (n1 * n2 - u1).alias("u2"), z.alias("z"), (u1 / (n1 * n2)).alias("superiority"))
    # The half step may pass the middle: no evidence at all.
    return out.withColumn("p_value", F.when(F.col("z").isNotNull(), F.when(F.col("z") <= 0, 1.0).otherwise(S.normal_two_sided(F.col("z")))))


def fisher_exact(df: DataFrame, groups: Sequence[str], row: Column, column: Column) -> DataFrame:
    """(groups, a, b, c, d, odds_ratio, p_value) of two yes-no conditions; rows with an unknown one take no part."""
    known = df.withColumn("__r", row).withColumn("__c", column).where("__r IS NOT NULL AND __c IS NOT NULL")
    r, c = F.col("__r"), F.col("__c")
    table = known.groupBy(*groups).agg(
        *[F.count(F.when(when, 1)).alias(name) for name, when in (("a", r & c), ("b", r & ~c), ("c", ~r & c), ("d", ~r & ~c))]
    )
    cross = (F.col("b") * F.col("c")).cast("double")
    odds = F.when(cross > 0, F.col("a") * F.col("d") / cross)
    return table.withColumn("odds_ratio", odds).withColumn("p_value", S.fisher_two_sided(F.col("a"), F.col("b"), F.col("c"), F.col("d")))


def joint_f_test(df: DataFrame, groups: Sequence[str], features: Sequence[str], tested: Sequence[str], target: str) -> DataFrame:
    """(groups, n, r2_full, r2_reduced, f, df1, df2, p_value): whether the ``tested`` features add to the others.

    Both fits come from the moments of the same rows, those with all features and the target.
    """
    rest = [f for f in features if f not in tested]
    table = moments(df, groups, features, target)
    full = solve_moments(table, features).select(*groups, "n", F.col("r2").alias("r2_full"))
    if rest:
        complete = df.dropna(subset=[*features, target])
        reduced = fit(complete, groups, rest, target).select(*groups, F.col("r2").alias("r2_reduced"))
        both = full.join(reduced, list(groups)) if groups else full.crossJoin(F.broadcast(reduced))
    else:
        both = full.withColumn("r2_reduced", F.lit(0.0))
    df1, df2 = float(len(tested)), F.col("n") - len(features) - 1
    f = F.when((df2 > 0) & (F.col("r2_full") < 1), (F.col("r2_full") - F.col("r2_reduced")) / df1 / ((1 - F.col("r2_full")) / df2))
    out = both.withColumn("f", f).withColumn("df1", F.lit(df1)).withColumn("df2", df2)
    return out.withColumn("p_value", S.f_upper(F.greatest("f", F.lit(0.0)), F.col("df1"), F.col("df2")))


def one_sample_t(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, n, mean, sd, t, p_value) against zero; all values equal and not zero give a null t."""
    out = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    t = F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt("n"))).when(F.col("mean") == 0, 0.0)
    out = out.withColumn("t", t)
    return out.withColumn("p_value", F.when((F.col("t") == 0) & ((F.col("n") < 2) | (F.col("sd") == 0)), 1.0).when(F.col("n") > 1, S.student_two_sided(F.col("t"), F.col("n") - 1)))
