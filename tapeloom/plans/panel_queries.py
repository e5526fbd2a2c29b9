"""The daily research panel: grid snapshots, lags, forward targets, split, fit and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import book as B
from ..operators import regression as G
from ..operators.asof import asof
from ..operators.slices import Slices, sliding
from ..session import cut_lineage
from .bindings import BOOKS_SQL, DAY, HOUR, KEYS, books, time_slices, train_until
from .registry import query


def snapshot_grid(
    states: DataFrame, keys: Sequence[str], step: int, slices: Slices, values: Sequence[str], ts: str = "ts_us"
) -> DataFrame:
    """Last state at every grid instant between a key's first and last row.

    The latest row decides: an unusable one gives null values rather than an older state.
    """
    span = states.groupBy(*keys).agg(F.min(ts).alias("__t0"), F.max(ts).alias("__t1"))
    first = F.expr(f"(__t0 + {step - 1}) div {step}")
    final = F.expr(f"__t1 div {step}")
    ticks = span.where(first <= final).select(
        *keys, F.explode(F.sequence(first * step, final * step, F.lit(step).cast("long"))).alias("grid_ts")
    )
    found = asof(
        ticks, states.withColumn("state_ts", F.col(ts)), keys=keys, left_ts="grid_ts", right_ts=ts,
        values=["state_ts", *values], slices=slices, right_ties=["seq"], prefix="",
    )
    return found


STEP = 6 * HOUR
COSTS = (1, 2)  # horizons in grid steps


def panel(spark, sf) -> DataFrame:
    """Features and future-only targets per (instrument, grid instant)."""
    cuts = time_slices(spark, sf)
    bp, ap = B.best("bids"), B.best("asks")
    bq, aq = B.best("bids", "quantity").cast("double"), B.best("asks", "quantity").cast("double")
    ok = (F.size("bids") > 0) & (bp < ap)
    states = books(spark, sf).select(
        "instrument_id", "seq", "ts_us",
        F.when(ok, (bp + ap) / 2.0).alias("mid"),
        F.when(ok, ap - bp).alias("spread"),
        F.when(ok, (ap * bq + bp * aq) / (bq + aq)).alias("micro"),
        F.when(ok, B.imbalance(B.side_sum("bids", "quantity", 5), B.side_sum("asks", "quantity", 5))).alias("imbalance"),
    )
    snaps = snapshot_grid(states, KEYS, STEP, cuts, ["mid", "spread", "micro", "imbalance"]).where(
        F.col("mid").isNotNull() & (F.col("grid_ts") - F.col("state_ts") <= 2 * DAY)
    )
    # Lags and horizons sit on exact grid offsets, so each is a one-row range frame.
    near = sliding(
        snaps, KEYS, "grid_ts", cuts,
        {"lag_mid": lambda f: F.max("mid").over(f(-STEP, -STEP)), **{f"mid_{h}": (lambda f, h=h: F.max("mid").over(f(h * STEP, h * STEP))) for h in COSTS}},
        back=STEP, ahead=max(COSTS) * STEP,
    )
    half = F.greatest(F.col("spread") / 2.0, F.lit(0.025))
    angle = F.lit(2.0 * 3.141592653589793) * F.pmod(F.col("grid_ts"), F.lit(DAY)) / float(DAY)
    rows = near.select(
        "instrument_id", "grid_ts",
        F.log("mid").alias("log_mid"),
        (F.col("spread") / F.col("mid")).alias("relative_spread"),
        ((F.col("micro") - F.col("mid")) / F.col("spread")).alias("microprice_dislocation"),
        F.col("imbalance").alias("depth_imbalance"),
        F.log(F.col("mid") / F.col("lag_mid")).alias("lag_return"),
        F.sin(angle).alias("time_sin"), F.cos(angle).alias("time_cos"),
        *[((F.col(f"mid_{h}") - F.col("mid")) / half).alias(f"markout_{h}") for h in COSTS],
    )
    return rows.dropna()


PANEL_SQL = f"""{BOOKS_SQL}, st AS (SELECT instrument_id, seq, ts_us, len(bids) > 0 AND coalesce(bids[1].price < asks[1].price, false) AS ok, bids[1].price AS bp, asks[1].price AS ap, CAST(bids[1].quantity AS DOUBLE) AS bq, CAST(asks[1].quantity AS DOUBLE) AS aq,
   CAST(list_sum(list_transform(bids[1:5], lambda x: x.quantity)) AS DOUBLE) AS bd, CAST(list_sum(list_transform(asks[1:5], lambda x: x.quantity)) AS DOUBLE) AS ad FROM books),
g AS (SELECT instrument_id, unnest(range((min(ts_us) + {STEP - 1}) // {STEP}, max(ts_us) // {STEP} + 1)) * {STEP} AS grid_ts FROM st GROUP BY 1),
sn AS MATERIALIZED (SELECT g.instrument_id, g.grid_ts, (bp + ap) / 2.0 AS mid, ap - bp AS spread, (ap * bq + bp * aq) / (bq + aq) AS micro, (bd - ad) / (bd + ad) AS imb FROM g ASOF JOIN st s ON g.instrument_id = s.instrument_id AND g.grid_ts >= s.ts_us WHERE s.ok AND g.grid_ts - s.ts_us <= {2 * DAY}),
sq AS MATERIALIZED (SELECT *, grid_ts - {STEP} AS tl, grid_ts + {STEP} AS t1, grid_ts + {2 * STEP} AS t2 FROM sn),
j0 AS MATERIALIZED (SELECT a.*, l.mid AS lmid FROM sq a JOIN sq l ON l.instrument_id = a.instrument_id AND l.grid_ts = a.tl),
j1 AS MATERIALIZED (SELECT a.*, f.mid AS mid1 FROM j0 a JOIN sq f ON f.instrument_id = a.instrument_id AND f.grid_ts = a.t1),
j2 AS MATERIALIZED (SELECT a.*, f.mid AS mid2 FROM j1 a JOIN sq f ON f.instrument_id = a.instrument_id AND f.grid_ts = a.t2),
panel AS MATERIALIZED (SELECT instrument_id, grid_ts, ln(mid) AS log_mid, spread / mid AS relative_spread, (micro - mid) / spread AS microprice_dislocation, imb AS depth_imbalance, ln(mid / lmid) AS lag_return,
   sin(2 * 3.141592653589793 * (grid_ts % {DAY}) / {float(DAY)}) AS time_sin, cos(2 * 3.141592653589793 * (grid_ts % {DAY}) / {float(DAY)}) AS time_cos,
   (mid1 - mid) / greatest(spread / 2.0, 0.025) AS markout_1, (mid2 - mid) / greatest(spread / 2.0, 0.025) AS markout_2 FROM j2)"""

COLUMNS = (
    "log_mid", "relative_spread", "microprice_dislocation", "depth_imbalance", "lag_return", "time_sin", "time_cos", "markout_1", "markout_2",
)


@query(
    "daily_panel",
    f"WITH {PANEL_SQL} SELECT instrument_id, grid_ts, {', '.join(f'round({c}, 6) AS {c}' for c in COLUMNS)} FROM panel",
)
def daily_panel(spark, sf):
    return panel(spark, sf).select("instrument_id", "grid_ts", *[F.round(c, 6).alias(c) for c in COLUMNS])


CUT_SQL = "SELECT min(ts_us) + (max(ts_us) - min(ts_us)) * 7 // 10 AS cut FROM tape"


@query(
    "daily_panel_walk_forward",
    f"""WITH {PANEL_SQL}, k AS ({CUT_SQL}), tr AS (SELECT count(*) AS n, regr_slope(markout_1, depth_imbalance) AS b, regr_intercept(markout_1, depth_imbalance) AS b0, avg(markout_1) AS my FROM panel WHERE grid_ts <= (SELECT cut FROM k)),
    te AS (SELECT * FROM panel WHERE grid_ts > (SELECT cut + {DAY} FROM k)) SELECT CAST(any_value(n) AS DOUBLE) AS train_n, CAST(count(*) AS DOUBLE) AS test_n, round(any_value(b), 6) AS beta, round(1 - sum((markout_1 - b0 - b * depth_imbalance) ^ 2) / sum((markout_1 - my) ^ 2), 6) AS oos_r2 FROM te, tr""",
)
def daily_panel_walk_forward(spark, sf):
    rows = panel(spark, sf).select("grid_ts", "depth_imbalance", "markout_1")
    cut = train_until(spark, sf)
    side = F.when(F.col("grid_ts") <= cut, "train").when(F.col("grid_ts") > cut + DAY, "test")
    # Both sides' moments leave the panel in one pass.
    m = cut_lineage(G.moments(rows.withColumn("side", side).where(F.col("side").isNotNull()), ["side"], ["depth_imbalance"], "markout_1"))
    fits = G.solve_moments(m.where("side = 'train'").drop("side"), ["depth_imbalance"])
    scored = G.score_from_moments(m.where("side = 'test'").drop("side"), fits, [], ["depth_imbalance"])
    return scored.crossJoin(F.broadcast(fits.select(F.col("n").alias("train_n"), F.get("coefficients", 1).alias("beta")))).select(
        "train_n", "test_n", F.round("beta", 6).alias("beta"), F.round("oos_r2", 6).alias("oos_r2")
    )


@query(
    "panel_ridge_by_instrument",
    f"""WITH {PANEL_SQL}, m AS (SELECT instrument_id, count(*) AS n, covar_pop(depth_imbalance, markout_1) / stddev_pop(depth_imbalance) AS push, stddev_pop(depth_imbalance) AS s, avg(depth_imbalance) AS mx, avg(markout_1) AS my FROM panel GROUP BY 1)
    SELECT instrument_id, CAST(n AS DOUBLE) AS n, CASE WHEN s > 1e-12 THEN round(push / (1 + 1.0 / n) / s, 5) ELSE 0 END AS beta FROM m""",
)
def panel_ridge_by_instrument(spark, sf):
    f = G.fit(panel(spark, sf), KEYS, ["depth_imbalance"], "markout_1", [1.0])
    return f.select("instrument_id", "n", F.round(F.get("coefficients", 1), 5).alias("beta"))
