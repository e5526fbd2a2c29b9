"""Exact ranks and quantiles without gathering a group into one task.

Values are first counted per (group, value), then a sliced running count gives every distinct
value its position; a quantile is the value whose position range holds the wanted rank.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slices import Slices, ordered_scan, run_sum, total

LINEAR, NEAREST_RANK, ROUNDED_INDEX = "linear", "nearest_rank", "rounded_index"


def positions(
    df: DataFrame, groups: Sequence[str], value: str, slices: Slices, weight: Column | None = None
) -> DataFrame:
    """One row per (group, value): multiplicity ``n``, inclusive running count ``cum``, ``size``.

    With ``weight`` the counts are sums of weights.
    """
    measure = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(measure.alias("n"))
    )
    return ordered_scan(counted, groups, [value], slices, {"cum": run_sum("n"), "size": total("n")})


def quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    slices: Slices,
    convention: str = LINEAR,
    weight: Column | None = None,
) -> DataFrame:
    """Named quantiles per group under one of the three conventions in use.

    ``linear`` interpolates at ``(n-1)p``; ``nearest_rank`` takes rank ``ceil(pn)``;
    ``rounded_index`` takes index ``round((n-1)p)`` with half-even rounding. A row counts ``weight``
    times (a whole number), so values that are counted already need no second reading.
    """
    pos = positions(df, groups, value, slices, weight)
    n, lo, hi = F.col("size"), F.col("cum") - F.col("n"), F.col("cum")

    def at(rank: Column) -> Column:
        return F.max(F.when((lo <= rank) & (rank < hi), F.col(value)))

    cells = [F.max("size").alias("n")]
    for name, p in probs.items():
        if convention == NEAREST_RANK:
            cells.append(at(F.greatest(F.ceil(n * F.lit(p)) - 1, F.lit(0))).alias(name))
        elif convention == ROUNDED_INDEX:
            cells.append(at(F.bround((n - 1) * F.lit(p)).cast("long")).alias(name))
        else:
            where = (n - 1) * F.lit(p)
            cells.append(at(F.floor(where)).alias(f"__lo_{name}"))
            cells.append(at(F.ceil(where)).alias(f"__hi_{name}"))
    picked = pos.groupBy(*groups).agg(*cells)
    if convention != LINEAR:
        return picked
    out = [F.col(g) for g in groups] + [F.col("n")]
    for name, p in probs.items():
        where = (F.col("n") - 1) * F.lit(p)
        w = where - F.floor(where)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        # A rank that is whole takes its value alone: an infinity times zero would be NaN.
        out.append(F.when(w == 0, low * 1.0).otherwise(low * (1.0 - w) + high * w).alias(name))
    return picked.select(*out)


def weighted_quantile(
    df: DataFrame, groups: Sequence[str], value: str, weight: str, fraction: float, slices: Slices
) -> DataFrame:
    """First value whose running weight reaches ``fraction`` of the total."""
    pos = positions(df, groups, value, slices, F.col(weight))
    return pos.where(F.col("cum") >= F.lit(fraction) * F.col("size")).groupBy(*groups).agg(
        F.min(value).alias("weighted_quantile")
    )


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, slices: Slices) -> DataFrame:
    """Average rank (ties shared) of each distinct value of a group."""
    return positions(df, groups, value, slices).select(
        *groups, value, (F.col("cum") - F.col("n") + (F.col("n") + 1) / 2.0).alias("rank")
    )


def rank_correlation(
    df: DataFrame, groups: Sequence[str], x: str, y: str, x_slices: Slices, y_slices: Slices
) -> DataFrame:
    """Spearman correlation per group, ties averaged, over rows where both values exist."""
    pairs = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*groups, x, y)
        .agg(F.count(F.lit(1)).alias("__m"))
    )
    def ranked(value: str, cuts: Slices, name: str) -> DataFrame:
        counted = pairs.groupBy(*groups, value).agg(F.sum("__m").alias("__n"))
        cum = ordered_scan(counted, groups, [value], cuts, {"cum": run_sum("__n")})
        return cum.select(*groups, value, (F.col("cum") - F.col("__n") + (F.col("__n") + 1) / 2.0).alias(name))

    both = pairs.join(ranked(x, x_slices, "rx"), [*groups, x]).join(ranked(y, y_slices, "ry"), [*groups, y])
    rx, ry, m = F.col("rx"), F.col("ry"), F.col("__m")
    sums = both.groupBy(*groups).agg(
        F.sum("__m").alias("n"),
        F.sum(m * rx).alias("sx"), F.sum(m * ry).alias("sy"),
        F.sum(m * rx * rx).alias("sxx"), F.sum(m * ry * ry).alias("syy"), F.sum(m * rx * ry).alias("sxy"),
    )
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") ** 2, n * F.col("syy") - F.col("sy") ** 2
    rho = F.when((vx > 0) & (vy > 0), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy))
    return sums.select(*groups, n, rho.alias("spearman"))


def auc_by_rank(df: DataFrame, groups: Sequence[str], score: str, tie: str, label: str, slices: Slices) -> DataFrame:
    """Area under the curve from the rank sum of positives; ordinal ranks, ties by ``tie``."""
    from .slices import row_no

    ranked = ordered_scan(df, groups, [score, tie], slices, {"r": row_no()})
    agg = ranked.groupBy(*groups).agg(
        F.sum(F.when(F.col(label) == 1, F.col("r"))).alias("rs"),
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
    )
    p, q = F.col("pos"), F.col("neg")
    return agg.select(
        *groups, p.alias("positives"), q.alias("negatives"),
        F.when((p > 0) & (q > 0), (F.col("rs") - p * (p + 1) / 2.0) / (p * q)).alias("auc"),
    )
