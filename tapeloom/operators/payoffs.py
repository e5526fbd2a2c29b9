"""Short iron butterflies over given end values: their payoff is piecewise linear, so moments of sorted values say all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .asof import asof
from .slices import Slices, ordered_scan, run_sum

_PROBES = 24  #: ranks looked up in a round of the search for the tail


def _zero(c: str, kind: str = "long") -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast(kind))


def butterfly_summary(
    ends: DataFrame, candidates: DataFrame, keys: Sequence[str], value: str, slices: Slices, *, tail: float = 0.05, exercise_tax: float = 0.0015
) -> DataFrame:
    """Every candidate (keys, center, width, net: whole ticks) over the end values of its key (whole ticks).

    Returns keys, center, width, net, n, reason, mean, loss_chance, worst, tail_rows, tail_mean. At the end value S
    a candidate earns net - min(|S - center|, width), less the tax on what its long wings pay. ``tail_mean`` is the
    mean of the worst share ``tail`` of end values (at least one). A credit that is not between zero and the width
    is refused ('nonviable_credit'), a key without values too ('no_paths').

    End values are counted once and get running counts and sums by slice. A candidate then asks for five
    places on the value axis, and its tail, which is the lowest j and the highest k - j values, is found by
    looking up ranks: no candidate ever meets the paths themselves.
    """
    counted = ends.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("long").alias("__v")).agg(F.count(F.lit(1)).alias("__m"))
    table = ordered_scan(counted, keys, ["__v"], slices, {"__n": run_sum("__m"), "__s": run_sum(F.col("__v") * F.col("__m"))})
    table = cut_lineage(table)
    totals = table.groupBy(*keys).agg(F.max("__n").alias("n"), F.max(F.struct("__n", "__s"))["__s"].alias("__total"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    ids = [*keys, "center", "width", "net"]
    viable = (F.col("net") > 0) & (F.col("net") < F.col("width"))
    # Ranks are the axis of the second lookup: as many cuts, evenly.
    largest = totals.agg(F.max("n")).first()[0] or 0
    rank_cuts = Slices(tuple(float(largest) * (k + 1) / (len(slices.cuts) + 1) for k in range(len(slices.cuts))))

    own = candidates.select(*ids).distinct().join(totals, list(keys), "left")
    refused = own.where("n IS NULL OR net IS NULL OR net <= 0 OR net >= width")
    asked = own.where(viable & F.col("n").isNotNull()).withColumn("__k", F.greatest(F.lit(1), F.floor(F.col("n") * tail)).cast("long"))
    asked = cut_lineage(asked)

    places = {"wing_low": F.col("center") - F.col("width"), "mid": F.col("center"), "wing_high": F.col("center") + F.col("width") - 1, "loss_low": F.col("center") - F.col("net") - 1, "loss_high": F.col("center") + F.col("net")}
    probes = asked.select(*ids, F.inline(F.array(*[F.struct(F.lit(name).alias("__name"), at.cast("long").alias("__at")) for name, at in places.items()])))
    found = asof(probes, table, keys=keys, left_ts="__at", right_ts="__v", values=["__n", "__s"], slices=slices)
    cells = [F.max(F.when(F.col("__name") == name, F.struct(_zero("m___n").alias("n"), _zero("m___s").alias("s")))).alias(name) for name in places]
    placed = asked.join(found.groupBy(*ids).agg(*cells), ids)

    # The j-th lowest is in the tail as long as it lies as far from the center as the value it would push out.
    state = cut_lineage(placed.withColumn("__from", F.lit(0).cast("long")).withColumn("__to", F.col("__k") + 1))
    while not state.where("__to - __from > 1").isEmpty():
        points = F.expr(f"filter(transform(sequence(1, {_PROBES}), i -> __from + i * greatest(1, (__to - __from) div {_PROBES})), j -> j < __to)")
        open_ = state.where("__to - __from > 1").select(*ids, "n", "__k", F.explode(points).alias("__j"))
        ranks = open_.select(*ids, "__j", F.inline(F.array(F.struct(F.lit("low").alias("__name"), F.col("__j").alias("__at")), F.struct(F.lit("high").alias("__name"), (F.col("n") - F.col("__k") + F.col("__j")).alias("__at")))))
        seen = asof(ranks, table, keys=keys, left_ts="__at", right_ts="__n", values=["__v"], slices=rank_cuts, direction="forward")
        pairs = seen.groupBy(*ids, "__j").agg(*[F.max(F.when(F.col("__name") == c, F.col("m___v"))).alias(c) for c in ("low", "high")])
        good = F.col("center") - F.col("low") >= F.col("high") - F.col("center")
        bounds = pairs.groupBy(*ids).agg(F.max(F.when(good, F.col("__j"))).alias("__lo"), F.min(F.when(~good, F.col("__j"))).alias("__hi"))
        moved = state.join(bounds, ids, "left").withColumn("__from", F.coalesce("__lo", "__from")).withColumn("__to", F.coalesce("__hi", "__to")).drop("__lo", "__hi")
        state = cut_lineage(moved)

    ranks = state.select(*ids, F.inline(F.array(F.struct(F.lit("low").alias("__name"), F.col("__from").alias("__at")), F.struct(F.lit("high").alias("__name"), (F.col("n") - F.col("__k") + F.col("__from")).alias("__at")))))
    seen = asof(ranks.where("__at > 0"), table, keys=keys, left_ts="__at", right_ts="__n", values=["__v", "__m", "__n", "__s"], slices=rank_cuts, direction="forward")
    # Sum of that many smallest values: all below the value at the rank, and as many of it as are left.
    smallest = F.col("m___s") - F.col("m___v") * (F.col("m___n") - F.col("__at"))
    sums = seen.groupBy(*ids).agg(*[F.max(F.when(F.col("__name") == c, smallest)).alias(f"sum_{c}") for c in ("low", "high")])
    both = state.join(sums, ids, "left")

    c, w, net, tax = F.col("center").cast("double"), F.col("width").cast("double"), F.col("net").cast("double"), exercise_tax

    def lower(j: Column, of_j: Column) -> Column:
        """Earned over the j lowest values, none above the center."""
        beyond = F.least(j, F.col("wing_low.n"))
        part = F.when(j <= F.col("wing_low.n"), of_j).otherwise(F.col("wing_low.s"))
        return beyond * (net - w - tax * (c - w)) + tax * part + (j - beyond) * (net - c) + (of_j - part)

    def upper(m: Column, of_m: Column) -> Column:
        """Earned over the m highest values, none below the center."""
        wing_n, wing_s = F.col("n") - F.col("wing_high.n"), F.col("__total") - F.col("wing_high.s")
        beyond = F.least(m, wing_n)
        part = F.when(m <= wing_n, of_m).otherwise(wing_s)
        return beyond * (net - w + tax * (c + w)) - tax * part + (m - beyond) * (net + c) - (of_m - part)

    n = F.col("n")
    mean = (lower(F.col("mid.n"), F.col("mid.s")) + upper(n - F.col("mid.n"), F.col("__total") - F.col("mid.s"))) / n
    losing = F.col("loss_low.n") + n - F.col("loss_high.n")
    tail_sum = lower(F.col("__from"), _zero("sum_low")) + upper(F.col("__k") - F.col("__from"), F.col("__total") - _zero("sum_high"))
    far = lambda v: net - F.least(F.abs(v - c), w) - tax * F.greatest(F.abs(v - c) - w, F.lit(0.0))
    done = both.select(
        *ids, "n", F.lit(None).cast("string").alias("reason"), mean.alias("mean"), (losing / n).alias("loss_chance"),
        F.least(far(F.col("__low")), far(F.col("__high"))).alias("worst"), F.col("__k").alias("tail_rows"), (tail_sum / F.col("__k")).alias("tail_mean"),
    )
    why = F.when(F.col("n").isNull(), "no_paths").otherwise("nonviable_credit")
    blank = [F.lit(None).cast("double").alias(x) for x in ("mean", "loss_chance", "worst")]
    return done.unionByName(refused.select(*ids, "n", why.alias("reason"), *blank, F.lit(None).cast("long").alias("tail_rows"), F.lit(None).cast("double").alias("tail_mean")))
