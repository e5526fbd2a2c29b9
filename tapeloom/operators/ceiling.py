"""Upper bounds of exits: where paths peak, when they break even, and how peak times compare with the arcsine law."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import positions
from .slices import Slices


def path_ceilings(df: DataFrame, keys: Sequence[str], ts: str, tie: str, price: str, cost: float = 0.0) -> DataFrame:
    """One row for each path (``keys``): entry, close, peak and trough with their times, returns in percent.

    Entry is the first priced row and close the last. ``peak_u`` is the peak's share of the path's time, the
    earliest of equal peaks; ``giveback`` what the close lost of it. ``break_even_us`` is the first time after
    entry at which the running maximum covers ``cost`` percent, null if it never does. Extremes and the
    first passage are sums that combine before the shuffle, whatever the length of a path.
    """
    known = df.where(F.col(price).isNotNull())
    order = F.struct(ts, tie)
    up, down = F.struct(F.col(price).alias("p"), (-F.col(ts)).alias("t"), (-F.col(tie)).alias("o")), F.struct(F.col(price).alias("p"), F.col(ts).alias("t"), F.col(tie).alias("o"))
    ends = known.groupBy(*keys).agg(
        F.min(order).alias("__first"), F.min_by(price, order).alias("entry"), F.max_by(price, order).alias("close"),
        F.max(ts).alias("__to"), F.max(up).alias("__up"), F.min(down).alias("__down"), F.count(F.lit(1)).alias("rows"),
    )
    target = known.join(ends.select(*keys, F.col("__first").alias("__f"), F.col("entry").alias("__e")), list(keys))
    passed = (F.col(price) >= F.col("__e") * (1 + cost / 100)) & (F.struct(F.col(ts), F.col(tie)) > F.col("__f"))
    passage = target.where(passed).groupBy(*keys).agg(F.min(ts).alias("__at"))
    both = ends.join(passage, list(keys), "left")
    start = F.col(f"__first.{ts}")
    span = F.col("__to") - start
    back = lambda p: F.when(F.col("entry") != 0, (p - F.col("entry")) / F.col("entry") * 100)
    return both.select(
        *keys, "rows", "entry", "close", F.col("__up.p").alias("peak"), F.col("__down.p").alias("trough"), span.alias("span_us"),
        (-F.col("__up.t") - start).alias("peak_us"), F.when(span > 0, (-F.col("__up.t") - start) / span).alias("peak_u"),
        back(F.col("__up.p")).alias("peak_return"), back(F.col("close")).alias("close_return"), (back(F.col("__up.p")) - back(F.col("close"))).alias("giveback"),
        (F.col("__at") - start).alias("break_even_us"),
    )


def arcsine_cdf(x: Column) -> Column:
    return F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))) * (2.0 / pi)


def distribution_distance(df: DataFrame, groups: Sequence[str], value: str, cdf: Callable[[Column], Column], slices: Slices, least: int = 5) -> DataFrame:
    """(groups, n, d_plus, d_minus, distance, at, p_value) of an empirical distribution to a continuous one.

    Distinct values are counted and get their running count by slice, so no group is sorted in one task. ``at`` is
    the smallest value of the largest gap; the p-value is Kolmogorov's with the usual correction for n. Groups
    of fewer than ``least`` rows have nulls.
    """
    pos = positions(df, groups, value, slices)
    f = cdf(F.col(value))
    above, below = F.col("cum") / F.col("size") - f, f - (F.col("cum") - F.col("n")) / F.col("size")
    gap = F.struct(F.greatest(above, below).alias("d"), (-F.col(value)).alias("v"))
    out = pos.groupBy(*groups).agg(F.max("size").alias("n"), F.max(above).alias("d_plus"), F.max(below).alias("d_minus"), F.max(gap).alias("__g"))
    root = F.sqrt("n")
    x = (root + 0.12 + 0.11 / root) * F.col("__g.d")
    # Far terms vanish quickly; near zero the series is one.
    tail = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * x * x) for k in range(1, 40)), F.lit(0.0))
    p = F.when(x < 0.3, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))
    enough = F.col("n") >= least
    return out.select(
        *groups, "n", *[F.when(enough, c).alias(name) for name, c in (("d_plus", F.col("d_plus")), ("d_minus", F.col("d_minus")), ("distance", F.col("__g.d")), ("at", -F.col("__g.v")), ("p_value", p))]
    )
