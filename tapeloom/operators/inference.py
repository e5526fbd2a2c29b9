"""Dependence-aware inference: Newey-West, blocks, bootstrap, multiplicity, placebo tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import Slices, ordered_scan, row_no, run_max, run_min, total


def lagged_products(
    df: DataFrame, groups: Sequence[str], order_by: Sequence[str], value: str, lags: int, slices: Slices
) -> DataFrame:
    """Per group: n, mean, variance and the lag-k sums of products of demeaned values, k <= lags.

    Rows are numbered, then each lag is an equi-join on position done as a halo copy: a row is sent
    to the positions it is a lag of, so the work is n x (lags + 1) whatever the group size.
    """
    numbered = ordered_scan(df.where(F.col(value).isNotNull()), groups, order_by, slices, {"__i": row_no()})
    means = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("gamma_0")
    )
    centred = numbered.join(means.select(*groups, "mean"), list(groups)) if groups else numbered.crossJoin(F.broadcast(means.select("mean")))
    rows = centred.select(*groups, "__i", (F.col(value) - F.col("mean")).alias("u"))
    copies = rows.select(
        *groups, "u", F.posexplode(F.sequence(F.col("__i"), F.col("__i") + lags)).alias("k", "at")
    )
    slots = copies.groupBy(*groups, "at").agg(
        *[F.max(F.when(F.col("k") == k, F.col("u"))).alias(f"u{k}") for k in range(lags + 1)]
    )
    sums = slots.groupBy(*groups).agg(
        *[F.coalesce(F.sum(F.col("u0") * F.col(f"u{k}")), F.lit(0.0)).alias(f"s_{k}") for k in range(1, lags + 1)]
    )
    return means.join(sums, list(groups)) if groups else means.crossJoin(F.broadcast(sums))


def newey_west_mean(
    df: DataFrame, groups: Sequence[str], order_by: Sequence[str], value: str, lags: int, slices: Slices
) -> DataFrame:
    """Mean, Bartlett long-run variance, standard error and t per group."""
    p = lagged_products(df, groups, order_by, value, lags, slices)
    n = F.col("n")
    long_run: Column = F.col("gamma_0")
    for k in range(1, lags + 1):
        weight = 2.0 * (1.0 - k / (lags + 1.0))
        long_run = long_run + F.when(F.lit(k) <= n - 1, weight * F.col(f"s_{k}") / n).otherwise(0.0)
    out = p.withColumn("long_run_variance", F.greatest(long_run, F.lit(0.0)))
    se = F.sqrt(F.col("long_run_variance") / n)
    return out.select(
        *groups, "n", "mean", "long_run_variance", se.alias("standard_error"), F.when(se > 0, F.col("mean") / se).alias("t_statistic")
    )


def effective_size(
    df: DataFrame, groups: Sequence[str], order_by: Sequence[str], value: str, lags: int, slices: Slices
) -> DataFrame:
    """``n / (1 + 2 sum w_k r_k)`` with lagged Pearson correlations and Bartlett weights."""
    numbered = ordered_scan(df, groups, order_by, slices, {"__i": row_no()}).select(*groups, "__i", F.col(value).alias("u"))
    copies = numbered.select(*groups, "u", F.posexplode(F.sequence(F.col("__i"), F.col("__i") + lags)).alias("k", "at"))
    slots = copies.groupBy(*groups, "at").agg(
        *[F.max(F.when(F.col("k") == k, F.col("u"))).alias(f"u{k}") for k in range(lags + 1)]
    )
    r = slots.groupBy(*groups).agg(
        F.count("u0").alias("n"), *[F.corr("u0", f"u{k}").alias(f"r{k}") for k in range(1, lags + 1)]
    )
    inflation = F.lit(1.0)
    for k in range(1, lags + 1):
        inflation = inflation + 2.0 * (1.0 - k / (lags + 1.0)) * F.coalesce(F.col(f"r{k}"), F.lit(0.0))
    return r.select(*groups, "n", (F.col("n") / F.greatest(inflation, 1.0 / F.col("n"))).alias("effective_n"))


def block_means(df: DataFrame, groups: Sequence[str], ts: str, value: str, width: int) -> DataFrame:
    """Mean, error and t from disjoint fixed-length time blocks counted from each group's start."""
    origin = df.groupBy(*groups).agg(F.min(ts).alias("__t0"))
    block = F.floor((F.col(ts) - F.col("__t0")) / F.lit(width))
    blocks = df.join(origin, list(groups)).groupBy(*groups, block.alias("block")).agg(F.avg(value).alias("m"))
    n, se = F.count(F.lit(1)), F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))
    return blocks.groupBy(*groups).agg(
        n.alias("blocks"), F.avg("m").alias("block_mean"), se.alias("block_se"),
        F.when(se > 0, F.avg("m") / se).alias("block_t"),
    )


def draw_weights(df: DataFrame, id_cols: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Block-bootstrap weights: each block appears in each replicate with a Poisson(1) count drawn
    from a seeded hash, so replicates are reproducible and no block leaves its task."""
    u = (F.pmod(F.xxhash64(*[F.col(c) for c in id_cols], "replicate", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # Steps of the distribution function, as far as the draws can tell them apart.
    weight, cumulative, term, k = F.lit(0), 0.0, 0.36787944117144233, 0
    while term > 0.25 / (1 << 30):
        cumulative += term
        weight = weight + (F.col("__u") >= cumulative).cast("int")
        k += 1
        term /= k
    return (
        df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        .withColumn("__u", u)
        .withColumn("weight", weight)
        .drop("__u")
    )


def block_bootstrap_mean(
    df: DataFrame, groups: Sequence[str], block: Sequence[str], value: str, replicates: int, seed: int
) -> DataFrame:
    """Bootstrap error and 95% interval of a mean from blocks resampled within each group.

    Rows are reduced to block sums before replicating, so the replicate table has
    blocks x replicates rows.
    """
    sums = df.groupBy(*groups, *block).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    drawn = draw_weights(sums, [*groups, *block], replicates, seed)
    reps = drawn.groupBy(*groups, "replicate").agg(
        (F.sum(F.col("weight") * F.col("s")) / F.sum(F.col("weight") * F.col("c"))).alias("m")
    )
    point = sums.groupBy(*groups).agg((F.sum("s") / F.sum("c")).alias("mean"), F.count(F.lit(1)).alias("blocks"))
    spread = reps.groupBy(*groups).agg(
        F.stddev_samp("m").alias("bootstrap_se"), F.percentile("m", 0.025).alias("lower"), F.percentile("m", 0.975).alias("upper")
    )
    return point.join(spread, list(groups)) if groups else point.crossJoin(F.broadcast(spread))


def adjust_p_values(df: DataFrame, families: Sequence[str], p: str, id_col: str, slices: Slices | None = None) -> DataFrame:
    """Holm, Bonferroni, Benjamini-Hochberg and Benjamini-Yekutieli within each family.

    Null p-values stay null and do not count. Ranks and running extremes go over slices of the p-value, so a
    family of any size is no single task; p-values lie in [0, 1], where 64 even cuts do without a plan.
    """
    cuts = slices or Slices(tuple(k / 64 for k in range(1, 64)))
    backward = Slices(tuple(sorted(-c for c in cuts.cuts)), cuts.between)
    valid = df.where(F.col(p).isNotNull()).select(*families, id_col, F.col(p).alias("__p"))
    one = F.lit(1).cast("long")
    placed = ordered_scan(valid, families, ["__p", id_col], cuts, {"__r": row_no(), "__m": total(one)})
    v, r, m = F.col("__p"), F.col("__r"), F.col("__m")
    up = ordered_scan(placed, families, ["__p", id_col], cuts, {"holm": run_max(F.least((m - r + 1) * v, F.lit(1.0))), "__h": total(1.0 / r)})
    # The running minimum from the largest value downward is one from the front on the negated axis.
    down = up.withColumn("__q", -v).withColumn("__s", -r)
    down = ordered_scan(down, families, ["__q", "__s"], backward, {"__bh": run_min(v * m / r), "__by": run_min(v * m * F.col("__h") / r)})
    adjusted = down.select(
        *families, id_col, F.least(v * m, F.lit(1.0)).alias("bonferroni"), "holm",
        F.least("__bh", F.lit(1.0)).alias("benjamini_hochberg"), F.least("__by", F.lit(1.0)).alias("benjamini_yekutieli"),
    )
    return df.join(adjusted, [*families, id_col], "left")


def step_down_max_t(
    observed: DataFrame, replicates: DataFrame, cell: str, t: str, replicate: str
) -> DataFrame:
    """Two-sided max-|t| step-down adjusted p-values over a cell family.

    ``observed`` has one row per cell, ``replicates`` one per (replicate, cell). Cells are ordered
    by |t|, over slices of it; within each replicate the running maximum from the smallest upward is what a
    cell must beat.
    """
    sized = observed.select(cell, t).withColumn("__minus", -F.abs(t))
    cuts = Slices.plan(sized, "__minus")
    ranked = ordered_scan(sized, [], ["__minus", cell], cuts, {"rank": row_no()})
    suffix = Window.partitionBy(replicate).orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    table = (
        replicates.select(replicate, cell, F.abs(t).alias("__a"))
        .join(ranked.withColumnRenamed(t, "__obs"), cell)
        .withColumn("__max", F.max("__a").over(suffix))
    )
    counts = table.groupBy(cell, "rank", "__minus").agg(
        F.count(F.when(F.col("__max") >= F.abs("__obs"), 1)).alias("exceed"), F.count(F.lit(1)).alias("reps")
    )
    stepped = counts.withColumn("__step", (F.col("exceed") + 1) / (F.col("reps") + 1))
    out = ordered_scan(stepped, [], ["__minus", "rank"], cuts, {"adjusted_p": run_max("__step")})
    return out.select(cell, F.col("rank").cast("int").alias("rank"), F.least("adjusted_p", F.lit(1.0)).alias("adjusted_p"))


def t_summary(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """One-sample t summary."""
    n, sd = F.count(value), F.stddev_samp(value)
    return df.groupBy(*groups).agg(
        n.alias("n"), F.avg(value).alias("mean"), sd.alias("sd"), F.when(sd > 0, F.avg(value) / (sd / F.sqrt(n))).alias("t")
    )


def welch_t(df: DataFrame, groups: Sequence[str], value: str, flag: Column) -> DataFrame:
    """Welch two-sample t and its degrees of freedom for flagged against unflagged rows."""
    a, b = F.when(flag, F.col(value)), F.when(~flag, F.col(value))
    agg = df.groupBy(*groups).agg(
        F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"),
        F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"),
    )
    q1, q2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    return agg.select(
        *groups, "n1", "n2", (F.col("m1") - F.col("m2")).alias("difference"),
        ((F.col("m1") - F.col("m2")) / F.sqrt(q1 + q2)).alias("t"),
        ((q1 + q2) ** 2 / (q1**2 / (F.col("n1") - 1) + q2**2 / (F.col("n2") - 1))).alias("df"),
    )


def minimum_detectable(sd: Column, n: Column, z_alpha: float = 1.959963985, z_power: float = 0.841621234) -> Column:
    """Smallest mean detectable at the stated size and power (standard normal quantiles)."""
    return (z_alpha + z_power) * sd / F.sqrt(n)


def required_sample(sd: Column, effect: Column, z_alpha: float = 1.959963985, z_power: float = 0.841621234) -> Column:
    return F.ceil(((z_alpha + z_power) * sd / effect) ** 2)
