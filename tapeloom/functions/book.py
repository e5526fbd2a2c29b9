"""Column functions over order-book ladders: ``array<struct<price, quantity, orders>>``, best first.

Missing stays missing: a function returns null where the quantity is undefined, except for the
region totals, whose documented convention is zero next to an occupied-level count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the market conventions.
TICK = 0.05
BLOCKING_FLAGS = ("crossed_book", "invalid_depth", "stale_quote")
MICROPRICE_SPREAD_EDGES = (10.0, 30.0, 60.0, 100.0, 150.0)
TOUCH_SPREAD_EDGES = (2.0, 10.0, 50.0, 100.0, 150.0, 200.0)
RANK_REGIONS = (
    ("best", 1, 1),
    ("l1_5", 1, 5),
    ("l1_20", 1, 20),
    ("l21_50", 21, 50),
    ("l51_200", 51, 200),
)
DISTANCE_REGIONS = (
    ("d_le5", 0.0, 5.0),
    ("d_5_20", 5.0, 20.0),
    ("d_20_50", 20.0, 50.0),
    ("d_gt50", 50.0, float("inf")),
)
_UNROLL = 12  # short fixed sums stay inside generated code


def best(ladder: Column, field: str = "price") -> Column:
    """Level-one value, null on an empty side."""
    return F.get(ladder, 0)[field]


def side_sum(ladder: Column, field: str = "quantity", levels: int | None = None) -> Column:
    """Sum of one field over the first ``levels`` levels (all of them when None)."""
    if levels is not None and levels <= _UNROLL:
        acc = F.lit(0.0)
        for i in range(levels):
            acc = acc + F.coalesce(F.get(ladder, i)[field].cast("double"), F.lit(0.0))
        return acc
    part = ladder if levels is None else F.slice(ladder, 1, levels)
    return F.aggregate(part, F.lit(0.0), lambda a, x: a + x[field].cast("double"))


def by_rank(ladder: Column, first: int, final: int) -> Column:
    """Levels ``first..final`` counted from 1."""
    return F.slice(ladder, first, final - first + 1)


def by_distance(ladder: Column, low: float, high: float) -> Column:
    """Levels whose distance from the same-side best lies in ``[low, high)`` price units."""
    ref = best(ladder)

    def inside(x: Column) -> Column:
        d = F.abs(x["price"] - ref)
        return (d >= low) if high == float("inf") else (d >= low) & (d < high)

    return F.filter(ladder, inside)


def normalise(ladder: Column, digits: int = 2) -> Column:
    """Drop levels with a missing field and round prices to a common grid."""
    whole = F.filter(
        ladder,
        lambda x: x["price"].isNotNull() & x["quantity"].isNotNull() & x["orders"].isNotNull(),
    )
    return F.transform(
        whole,
        lambda x: F.struct(
            F.round(x["price"].cast("double"), digits).alias("price"),
            x["quantity"].alias("quantity"),
            x["orders"].alias("orders"),
        ),
    )


def valid(bids: Column, asks: Column, levels: int = 1, flags: Column | None = None) -> Column:
    """Enough levels on both sides, not crossed (locked is allowed), no blocking flag."""
    ok = (
        (F.size(bids) >= levels)
        & (F.size(asks) >= levels)
        & (best(asks) >= best(bids))
    )
    if flags is not None:
        ok = ok & ~F.arrays_overlap(flags, F.array(*[F.lit(f) for f in BLOCKING_FLAGS]))
    return F.coalesce(ok, F.lit(False))


def imbalance(bid: Column, ask: Column) -> Column:
    """``(b - a) / (b + a)``, null when the denominator is not positive."""
    total = bid + ask
    return F.when(total > 0, (bid - ask) / total)


def midpoint(bids: Column, asks: Column) -> Column:
    return F.when(valid(bids, asks), (best(bids) + best(asks)) * 0.5)


def spread_ticks(bids: Column, asks: Column, tick: float = TICK) -> Column:
    return F.when(valid(bids, asks), (best(asks) - best(bids)) / F.lit(tick))


def depth_imbalance(bids: Column, asks: Column, levels: int, field: str = "quantity") -> Column:
    return F.when(
        valid(bids, asks, levels),
        imbalance(side_sum(bids, field, levels), side_sum(asks, field, levels)),
    )


def inverse_rank_imbalance(bids: Column, asks: Column, levels: int = 5) -> Column:
    """Quantity imbalance with level i weighted 1/i."""

    def weighted(ladder: Column) -> Column:
        acc = F.lit(0.0)
        for i in range(levels):
            acc = acc + F.get(ladder, i)["quantity"].cast("double") * F.lit(1.0 / (i + 1))
        return acc

    return F.when(valid(bids, asks, levels), imbalance(weighted(bids), weighted(asks)))


def microprice_shift(bids: Column, asks: Column) -> Column:
    """Size-weighted touch price minus midpoint; a locked book is allowed."""
    bq, aq = best(bids, "quantity").cast("double"), best(asks, "quantity").cast("double")
    bp, ap = best(bids), best(asks)
    return F.when(
        valid(bids, asks) & (bq + aq > 0),
        (ap * bq + bp * aq) / (bq + aq) - (bp + ap) * 0.5,
    )


def simple_microprice(bid: Column, bid_q: Column, ask: Column, ask_q: Column) -> Column:
    """Size-weighted touch price; a locked or crossed touch is refused."""
    return F.when((bid < ask) & (bid_q + ask_q > 0), (ask_q * bid + bid_q * ask) / (bid_q + ask_q))


def microprice_tilt(bid: Column, bid_q: Column, ask: Column, ask_q: Column) -> Column:
    return (simple_microprice(bid, bid_q, ask, ask_q) - (bid + ask) / 2.0) / F.lit(TICK)


def l1_depth(bids: Column, asks: Column) -> Column:
    return F.when(
        valid(bids, asks),
        (best(bids, "quantity") + best(asks, "quantity")).cast("double"),
    )


def depth_weighted_offset(levels: Column, mid: Column) -> Column:
    """Quantity-weighted mean distance from the midpoint, null without quantity."""
    sums = F.aggregate(
        levels,
        F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("d")),
        lambda a, x: F.struct(
            (a["w"] + x["quantity"].cast("double")).alias("w"),
            (a["d"] + F.abs(x["price"] - mid) * x["quantity"]).alias("d"),
        ),
    )
    return F.when(sums["w"] > 0, sums["d"] / sums["w"])


def size_build_slope(levels: Column, best_price: Column) -> Column:
    """Least-squares slope of quantity on distance from best; at least three levels."""
    zero = F.lit(0.0)

    def add(a: Column, x: Column) -> Column:
        d, q = F.abs(x["price"] - best_price), x["quantity"].cast("double")
        return F.struct(
            (a["x"] + d).alias("x"), (a["y"] + q).alias("y"), (a["xx"] + d * d).alias("xx"), (a["xy"] + d * q).alias("xy")
        )

    n = F.size(levels).cast("double")
    return F.when(
        F.size(levels) >= 3,
        F.aggregate(
            levels,
            F.struct(*[zero.alias(k) for k in ("x", "y", "xx", "xy")]),
            add,
            lambda a: F.when(
                n * a["xx"] - a["x"] * a["x"] > 1e-9,
                (n * a["xy"] - a["x"] * a["y"]) / (n * a["xx"] - a["x"] * a["x"]),
            ),
        ),
    )


def stage(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column the optimiser evaluates once.

    A plain projection is substituted into every later use, including filters pushed below it; a
    one-element explode is a border those rewrites do not cross.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def add_quadratic_shape(df: DataFrame, ladder: str, name: str, tick: float = TICK) -> DataFrame:
    """Add struct<slope, curvature> of distance (ticks) on log cumulative size over five levels.

    Closed-form centred normal equations. The sums are staged as columns of their own so that no
    intermediate is evaluated twice.
    """
    points = []
    cumulative = F.lit(0.0)
    for i in range(5):
        level = F.get(ladder, i)
        cumulative = cumulative + level["quantity"].cast("double")
        points.append(
            F.struct(
                F.log1p(cumulative).alias("x"),
                (F.abs(level["price"] - F.get(ladder, 0)["price"]) / F.lit(tick)).alias("y"),
            )
        )
    zero = F.lit(0.0)
    pts, mean, cov = f"__{name}_p", f"__{name}_m", f"__{name}_c"
    m, c = F.col(mean), F.col(cov)
    df = stage(
        df.withColumn(pts, F.array(*points)),
        mean,
        F.aggregate(
            pts,
            F.struct(zero.alias("x"), zero.alias("z"), zero.alias("y")),
            lambda a, p: F.struct(
                (a["x"] + p["x"]).alias("x"),
                (a["z"] + p["x"] * p["x"]).alias("z"),
                (a["y"] + p["y"]).alias("y"),
            ),
            lambda a: F.struct((a["x"] / 5.0).alias("x"), (a["z"] / 5.0).alias("z"), (a["y"] / 5.0).alias("y")),
        ),
    )

    def centred(a: Column, p: Column) -> Column:
        x, z, y = p["x"] - m["x"], p["x"] * p["x"] - m["z"], p["y"] - m["y"]
        return F.struct(
            (a["xx"] + x * x).alias("xx"),
            (a["zz"] + z * z).alias("zz"),
            (a["xz"] + x * z).alias("xz"),
            (a["xy"] + x * y).alias("xy"),
            (a["zy"] + z * y).alias("zy"),
        )

    df = stage(
        df, cov, F.aggregate(pts, F.struct(*[zero.alias(k) for k in ("xx", "zz", "xz", "xy", "zy")]), centred)
    )
    det = c["xx"] * c["zz"] - c["xz"] * c["xz"]
    return df.withColumn(
        name,
        F.when(
            (F.size(ladder) >= 5) & (det > 25e-12),
            F.struct(
                ((c["xy"] * c["zz"] - c["zy"] * c["xz"]) / det).alias("slope"),
                ((c["zy"] * c["xx"] - c["xy"] * c["xz"]) / det).alias("curvature"),
            ),
        ),
    ).drop(pts, mean, cov)


def region_totals(levels: Column) -> dict[str, Column]:
    quantity, orders = side_sum(levels), side_sum(levels, "orders")
    return {
        "quantity": quantity,
        "order_count": orders,
        "occupied_levels": F.size(levels).cast("double"),
        "average_order_size_proxy": F.when(orders > 0, quantity / orders),
    }


def state_features(
    bids: Column,
    asks: Column,
    rank_regions: Sequence[tuple[str, int, int]] = RANK_REGIONS,
    distance_regions: Sequence[tuple[str, float, float]] = DISTANCE_REGIONS,
) -> dict[str, Column]:
    """Every ordinary book-state feature by region; empty regions report 0.0 beside their count."""
    zero = F.lit(0.0)
    usable = (F.size(bids) > 0) & (F.size(asks) > 0) & (best(bids) < best(asks))
    mid = (best(bids) + best(asks)) / 2.0
    out: dict[str, Column] = {"best__spread_rupees": best(asks) - best(bids), "midpoint": mid}
    regions = [(n, by_rank(bids, a, b), by_rank(asks, a, b)) for n, a, b in rank_regions]
    regions += [(n, by_distance(bids, a, b), by_distance(asks, a, b)) for n, a, b in distance_regions]
    for name, bid_part, ask_part in regions:
        b, a = region_totals(bid_part), region_totals(ask_part)
        for side, sums in (("bid", b), ("ask", a)):
            for field in ("quantity", "order_count", "occupied_levels"):
                out[f"{name}__{side}_{field}"] = sums[field]
            out[f"{name}__{side}_average_order_size_proxy"] = F.coalesce(
                sums["average_order_size_proxy"], zero
            )
        out[f"{name}__quantity_imbalance"] = F.coalesce(imbalance(b["quantity"], a["quantity"]), zero)
        out[f"{name}__order_count_imbalance"] = F.coalesce(
            imbalance(b["order_count"], a["order_count"]), zero
        )
        out[f"{name}__average_order_size_imbalance_proxy"] = F.coalesce(
            imbalance(
                out[f"{name}__bid_average_order_size_proxy"],
                out[f"{name}__ask_average_order_size_proxy"],
            ),
            zero,
        )
        for side, part, ref in (("bid", bid_part, best(bids)), ("ask", ask_part, best(asks))):
            out[f"{name}__{side}_depth_weighted_offset_rupees"] = F.coalesce(
                depth_weighted_offset(part, mid), zero
            )
            out[f"{name}__{side}_size_build_slope"] = F.coalesce(size_build_slope(part, ref), zero)
        out[f"{name}__depth_weighted_offset_imbalance"] = F.coalesce(
            imbalance(
                out[f"{name}__bid_depth_weighted_offset_rupees"],
                out[f"{name}__ask_depth_weighted_offset_rupees"],
            ),
            zero,
        )
    return {name: F.when(usable, column) for name, column in out.items()}


def lob_features(df: DataFrame, bids: str = "bids", asks: str = "asks", tick: float = TICK) -> DataFrame:
    """Add the five-level book block as ``lob``; null unless the whole block is defined."""
    df = add_quadratic_shape(add_quadratic_shape(df, bids, "__bs", tick), asks, "__as", tick)
    df = df.withColumn(
        "__t",
        F.struct(
            side_sum(bids, "quantity", 5).alias("bt"),
            side_sum(asks, "quantity", 5).alias("at"),
            side_sum(bids, "orders", 5).alias("bo"),
            side_sum(asks, "orders", 5).alias("ao"),
        ),
    )
    b1, a1 = best(bids, "quantity").cast("double"), best(asks, "quantity").cast("double")
    bp, ap = best(bids), best(asks)
    bt, at, bo, ao = (F.col(f"__t.{k}") for k in ("bt", "at", "bo", "ao"))
    out = {
        "spread_ticks": (ap - bp) / F.lit(tick),
        "microprice_tilt_ticks": ((ap * b1 + bp * a1) / (b1 + a1) - (bp + ap) / 2.0) / F.lit(tick),
        "l1_total_quantity": b1 + a1,
        "log1p_l1_total_quantity": F.log1p(b1 + a1),
    }
    for i in range(5):
        b, a = F.get(bids, i), F.get(asks, i)
        for field, label in (("quantity", "quantity"), ("orders", "order_count")):
            out[f"{label}_imbalance_l{i + 1}"] = imbalance(b[field].cast("double"), a[field].cast("double"))
    out |= {
        "quantity_imbalance_cum1": imbalance(b1, a1),
        "quantity_imbalance_cum5": imbalance(bt, at),
        "bid_total_quantity_5": bt,
        "ask_total_quantity_5": at,
        "log1p_bid_total_quantity_5": F.log1p(bt),
        "log1p_ask_total_quantity_5": F.log1p(at),
        "order_count_imbalance_cum5": imbalance(bo, ao),
        "bid_average_order_size_proxy_5": bt / bo,
        "ask_average_order_size_proxy_5": at / ao,
        "average_order_size_log_ratio_proxy_5": F.log((1.0 + bt / bo) / (1.0 + at / ao)),
        "bid_slope": F.col("__bs.slope"),
        "bid_curvature": F.col("__bs.curvature"),
        "ask_slope": F.col("__as.slope"),
        "ask_curvature": F.col("__as.curvature"),
        "slope_asymmetry_ask_minus_bid": F.col("__as.slope") - F.col("__bs.slope"),
        "curvature_asymmetry_ask_minus_bid": F.col("__as.curvature") - F.col("__bs.curvature"),
    }
    defined = (
        (F.size(bids) >= 5) & (F.size(asks) >= 5) & (bp < ap) & (b1 + a1 > 0) & (bo > 0) & (ao > 0)
        & F.col("__bs").isNotNull() & F.col("__as").isNotNull()
    )
    return stage(df, "lob", F.when(defined, F.struct(*[c.alias(n) for n, c in out.items()]))).drop(
        "__bs", "__as", "__t"
    )


def touch_relative(
    ladder: Column, bound: Column, side: str, levels: int, band_ticks: float, tick: float = TICK
) -> Column:
    """Re-key one side onto distance bands outward from a revealed bound.

    Band m holds displayed size at distance ``[(m-1)w, mw)`` ticks; size inside the bound is left
    out. Null when the bound is undefined.
    """
    sign = F.lit(1.0 if side == "bid" else -1.0)
    step = band_ticks * tick

    def band(m: Column) -> Column:
        def take(field: str) -> Column:
            return F.aggregate(
                ladder,
                F.lit(0.0),
                lambda a, x: a
                + F.when(
                    ((bound - x["price"]) * sign / F.lit(tick) >= 0)
                    & (F.floor((bound - x["price"]) * sign / F.lit(tick) / F.lit(band_ticks)) == m),
                    x[field].cast("double"),
                ).otherwise(0.0),
            )

        return F.struct(
            (bound - sign * m * F.lit(step)).alias("price"),
            F.bround(take("quantity")).cast("long").alias("quantity"),
            take("orders").cast("int").alias("orders"),
        )

    return F.when(bound.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), band))


def banded_depth(ladder: Column, bound: Column, side: str, band_ticks: float, tick: float = TICK) -> Column:
    """Displayed size within ``[0, band)`` ticks outward of a bound."""
    sign = 1.0 if side == "bid" else -1.0
    return F.aggregate(
        ladder,
        F.lit(0.0),
        lambda a, x: a
        + F.when(
            ((bound - x["price"]) * sign / F.lit(tick) >= 0)
            & ((bound - x["price"]) * sign / F.lit(tick) < band_ticks),
            x["quantity"].cast("double"),
        ).otherwise(0.0),
    )


def imbalance_bucket(value: Column, buckets: int = 10) -> Column:
    """``[-1, 1]`` to ``0..buckets-1``, clamped."""
    return F.greatest(
        F.least(((value + 1.0) / 2.0 * buckets).cast("int"), F.lit(buckets - 1)), F.lit(0)
    )


def edge_bucket(value: Column, edges: Sequence[float]) -> Column:
    """Index of the first edge above ``value``; the last bucket is open."""
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(value < edges[i], F.lit(i)).otherwise(out)
    return F.when(value.isNotNull(), out)


def edge_label(value: Column, edges: Sequence[float]) -> Column:
    """``[lower,upper)`` label on half-open edges, last bucket open above."""
    out = F.lit(f"[{edges[-1]:g},inf)")
    for i in reversed(range(len(edges))):
        low = edges[i - 1] if i else 0.0
        out = F.when(value < edges[i], F.lit(f"[{low:g},{edges[i]:g})")).otherwise(out)
    return F.when(value.isNotNull(), out)


def state_key(imbalance_col: Column, spread: Column) -> Column:
    """Discrete (imbalance, spread) state label, null on a negative or missing spread."""
    return F.when(
        (spread >= 0) & imbalance_col.isNotNull(),
        F.concat(
            F.lit("i"),
            imbalance_bucket(imbalance_col).cast("string"),
            F.lit("_s"),
            edge_bucket(spread, MICROPRICE_SPREAD_EDGES).cast("string"),
        ),
    )


def print_location(price: Column, bid: Column, ask: Column, tick: float = TICK) -> Column:
    """Where an execution printed against the displayed quote, on the half-even tick grid."""
    p, b, a = (F.bround(c / F.lit(tick)) for c in (price, bid, ask))
    return (
        F.when(bid >= ask, F.lit(None).cast("string"))
        .when(p == b, "at_bid")
        .when(p == a, "at_ask")
        .when((p > b) & (p < a), "strictly_inside")
        .when(p.isNotNull() & b.isNotNull() & a.isNotNull(), "strictly_outside")
    )


def depth_flags(bids: Column, asks: Column) -> Column:
    """Partial, non-monotone and crossed ladder flags as a sorted set."""

    def broken(ladder: Column, rising: bool) -> Column:
        n = F.size(ladder)
        nextone = F.slice(ladder, 2, F.greatest(n - 1, F.lit(1)))
        pairs = F.zip_with(
            ladder,
            nextone,
            lambda a, b: (a["price"] >= b["price"]) if rising else (a["price"] <= b["price"]),
        )
        return F.coalesce(F.exists(pairs, lambda p: p), F.lit(False))

    return F.array_sort(
        F.array_distinct(
            F.array_compact(
                F.array(
                    F.when((F.size(bids) == 0) | (F.size(asks) == 0), F.lit("partial_book")),
                    F.when(broken(bids, False) | broken(asks, True), F.lit("invalid_depth")),
                    F.when(best(bids) >= best(asks), F.lit("crossed_book")),
                )
            )
        )
    )
