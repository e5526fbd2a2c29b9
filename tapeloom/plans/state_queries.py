"""Rolling states, recursions, episodes and interval algebra."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import book as B
from ..functions import clock as C
from ..operators import states as S
from ..operators.asof import asof
from ..operators.intervals import episode_counts, episodes, exposure_by_bucket, subtract_intervals, union_intervals
from ..operators.quantiles import positions, quantiles
from ..operators.recurrence import greedy_non_overlapping, linear_recurrence, minimum_spacing
from ..operators.slices import Slices, first_after, last, nxt, ordered_scan, prev, run_sum, sliding
from ..session import cut_lineage
from .asof_queries import MIDS_SQL, mids
from .bindings import BOOKS_SQL, DAY, HOUR, KEYS, TAPE_SQL, books, slices_for, tape, time_slices
from .book_queries import ATOMIC_SQL, FAR, atomic
from .registry import query

GRID_SQL = f"""{TAPE_SQL}, grid AS (SELECT channel, ts_us // {HOUR} AS slot, arg_max(value, (ts_us, seq)) AS v FROM tape GROUP BY 1, 2)"""


def grid(spark, sf):
    """Last value per channel and hour: a regular grid with holes."""
    return tape(spark, sf).groupBy("channel", F.expr(f"ts_us div {HOUR}").alias("slot")).agg(
        F.max_by("value", F.struct("ts_us", "seq")).alias("v")
    )


def slot_slices(spark, sf) -> Slices:
    return slices_for(spark, sf, "grid.slot", tape(spark, sf).select(F.expr(f"ts_us div {HOUR}").alias("slot")), "slot")


def _changes(spark, sf):
    """Grid with the change from exactly the previous slot (null at a hole)."""
    g = grid(spark, sf)
    return sliding(
        g, ["channel"], "slot", slot_slices(spark, sf), {"chg": lambda f: F.col("v") - F.max("v").over(f(-1, -1))}, back=1
    )


CHG_SQL = f"""{GRID_SQL}, c AS (SELECT g.channel, g.slot, g.v, g.v - p.v AS chg FROM grid g LEFT JOIN grid p ON g.channel = p.channel AND p.slot = g.slot - 1)"""


@query(
    "rolling_volatility_and_trend",
    f"""WITH {CHG_SQL}, w AS (SELECT channel, slot, v, count(chg) OVER a AS n, stddev_pop(chg) OVER a AS sd, sum(abs(chg)) OVER a AS path,
      max(v) OVER b AS v0 FROM c WINDOW a AS (PARTITION BY channel ORDER BY slot RANGE BETWEEN 4 PRECEDING AND CURRENT ROW), b AS (PARTITION BY channel ORDER BY slot RANGE BETWEEN 5 PRECEDING AND 5 PRECEDING)),
    e AS (SELECT *, CASE WHEN n = 5 THEN sd END AS volatility, CASE WHEN n = 5 AND path > 0 THEN abs(v - v0) / path END AS efficiency FROM w)
    SELECT channel, slot, round(volatility, 6) AS volatility, round(efficiency, 6) AS efficiency,
      CASE WHEN efficiency <= 0.30 THEN 'choppy' WHEN efficiency >= 0.65 THEN 'trending' WHEN efficiency IS NOT NULL THEN 'mixed' END AS trend FROM e""",
)
def rolling_volatility_and_trend(spark, sf):
    h = 5
    out = sliding(
        _changes(spark, sf), ["channel"], "slot", slot_slices(spark, sf),
        {
            "n": lambda f: F.count("chg").over(f(-h + 1, 0)),
            "sd": lambda f: F.stddev_pop("chg").over(f(-h + 1, 0)),
            "path": lambda f: F.sum(F.abs("chg")).over(f(-h + 1, 0)),
            "v0": lambda f: F.max("v").over(f(-h, -h)),
        },
        back=h,
    )
    full = F.col("n") == h
    eff = F.when(full & (F.col("path") > 0), F.abs(F.col("v") - F.col("v0")) / F.col("path"))
    return out.withColumn("eff", eff).select(
        "channel", "slot", F.round(F.when(full, F.col("sd")), 6).alias("volatility"),
        F.round("eff", 6).alias("efficiency"), S.trend_label(F.col("eff")).alias("trend"),
    )


@query(
    "lagged_median_basis",
    f"""WITH {GRID_SQL} SELECT channel, slot, CASE WHEN count(v) OVER w >= 10 THEN round(median(v) OVER w, 6) END AS slow FROM grid
    WINDOW w AS (PARTITION BY channel ORDER BY slot RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING)""",
)
def lagged_median_basis(spark, sf):
    out = sliding(
        grid(spark, sf), ["channel"], "slot", slot_slices(spark, sf),
        {
            "n": lambda f: F.count("v").over(f(-30, -1)),
            "m": lambda f: F.percentile("v", 0.5).over(f(-30, -1)),
        },
        back=30,
    )
    return out.select("channel", "slot", F.when(F.col("n") >= 10, F.round("m", 6)).alias("slow"))


@query(
    "relative_tertile_state",
    f"""WITH {GRID_SQL}, q AS (SELECT channel, slot, v, count(v) OVER w AS n, quantile_cont(v, 0.33) OVER w AS q33, quantile_cont(v, 0.67) OVER w AS q67 FROM grid
      WINDOW w AS (PARTITION BY channel ORDER BY slot RANGE BETWEEN 200 PRECEDING AND 1 PRECEDING))
    SELECT channel, slot, CASE WHEN n >= 120 THEN round(q33, 6) END AS q33, CASE WHEN n >= 120 THEN round(q67, 6) END AS q67,
      CASE WHEN n >= 120 THEN CASE WHEN v < q33 THEN 'low' WHEN v > q67 THEN 'high' ELSE 'mid' END END AS state FROM q""",
)
def relative_tertile_state(spark, sf):
    out = sliding(
        grid(spark, sf), ["channel"], "slot", slot_slices(spark, sf),
        {
            "n": lambda f: F.count("v").over(f(-200, -1)),
            "q": lambda f: F.percentile("v", F.array(F.lit(0.33), F.lit(0.67))).over(f(-200, -1)),
        },
        back=200,
    )
    ok = F.col("n") >= 120
    lo, hi = F.when(ok, F.get("q", 0)), F.when(ok, F.get("q", 1))
    return out.select(
        "channel", "slot", F.round(lo, 6).alias("q33"), F.round(hi, 6).alias("q67"),
        S.tertile_state(F.col("v"), lo, hi).alias("state"),
    )


@query(
    "vol_of_vol_and_future_targets",
    f"""WITH {CHG_SQL} SELECT channel, slot, CASE WHEN count(chg) OVER b >= 40 THEN round(stddev_samp(chg) OVER b, 6) END AS vol_of_vol,
      round(max(v) OVER f - v, 6) AS future_move, CASE WHEN count(v) OVER r = 4 THEN round(max(v) OVER r - min(v) OVER r, 6) END AS future_range FROM c
    WINDOW b AS (PARTITION BY channel ORDER BY slot RANGE BETWEEN 59 PRECEDING AND CURRENT ROW), f AS (PARTITION BY channel ORDER BY slot RANGE BETWEEN 3 FOLLOWING AND 3 FOLLOWING),
      r AS (PARTITION BY channel ORDER BY slot RANGE BETWEEN CURRENT ROW AND 3 FOLLOWING)""",
)
def vol_of_vol_and_future_targets(spark, sf):
    out = sliding(
        _changes(spark, sf), ["channel"], "slot", slot_slices(spark, sf),
        {
            "n": lambda f: F.count("chg").over(f(-59, 0)),
            "sd": lambda f: F.stddev_samp("chg").over(f(-59, 0)),
            "fv": lambda f: F.max("v").over(f(3, 3)),
            "rn": lambda f: F.count("v").over(f(0, 3)),
            "hi": lambda f: F.max("v").over(f(0, 3)),
            "lo": lambda f: F.min("v").over(f(0, 3)),
        },
        back=59, ahead=3,
    )
    return out.select(
        "channel", "slot", F.when(F.col("n") >= 40, F.round("sd", 6)).alias("vol_of_vol"),
        F.round(F.col("fv") - F.col("v"), 6).alias("future_move"),
        F.when(F.col("rn") == 4, F.round(F.col("hi") - F.col("lo"), 6)).alias("future_range"),
    )


@query(
    "state_gates",
    f"""WITH {CHG_SQL}, q AS (SELECT channel, slot, v, count(v) OVER w AS n, quantile_cont(v, 0.33) OVER w AS q33, quantile_cont(v, 0.67) OVER w AS q67,
       count(chg) OVER w AS nc, quantile_cont(abs(chg), 0.33) OVER w AS c33, quantile_cont(abs(chg), 0.67) OVER w AS c67, abs(chg) AS ac FROM c
      WINDOW w AS (PARTITION BY channel ORDER BY slot RANGE BETWEEN 100 PRECEDING AND 1 PRECEDING)),
    s AS (SELECT *, CASE WHEN n >= 50 THEN CASE WHEN v < q33 THEN 'low' WHEN v > q67 THEN 'high' ELSE 'mid' END END AS spread,
       CASE WHEN nc >= 50 AND ac IS NOT NULL THEN CASE WHEN ac < c33 THEN 'low' WHEN ac > c67 THEN 'high' ELSE 'mid' END END AS vol FROM q)
    SELECT channel, slot, CASE WHEN vol IS NOT NULL AND spread IS NOT NULL THEN vol = 'high' AND spread = 'low' END AS parity_highvol_tightspread,
      CASE WHEN vol IS NOT NULL AND spread IS NOT NULL THEN vol = 'low' AND spread = 'mid' END AS l1_quantity_lowvol_middepth, CASE WHEN spread IS NOT NULL THEN spread = 'mid' END AS atm_iv_reversal_mid_vov FROM s""",
)
def state_gates(spark, sf):
    rows = _changes(spark, sf).withColumn("ac", F.abs("chg"))
    edges = F.array(F.lit(0.33), F.lit(0.67))
    out = sliding(
        rows, ["channel"], "slot", slot_slices(spark, sf),
        {
            "n": lambda f: F.count("v").over(f(-100, -1)),
            "q": lambda f: F.percentile("v", edges).over(f(-100, -1)),
            "nc": lambda f: F.count("ac").over(f(-100, -1)),
            "qc": lambda f: F.percentile("ac", edges).over(f(-100, -1)),
        },
        back=100,
    )
    ok, okc = F.col("n") >= 50, F.col("nc") >= 50
    staged = out.select(
        "channel", "slot",
        S.tertile_state(F.col("v"), F.when(ok, F.get("q", 0)), F.when(ok, F.get("q", 1))).alias("spread"),
        S.tertile_state(F.col("ac"), F.when(okc, F.get("qc", 0)), F.when(okc, F.get("qc", 1))).alias("volatility"),
    )
    states = {k: F.col(c) for k, c in {"volatility": "volatility", "spread": "spread", "depth": "spread", "vov": "spread"}.items()}
    names = ("parity_highvol_tightspread", "l1_quantity_lowvol_middepth", "atm_iv_reversal_mid_vov")
    return staged.select("channel", "slot", *[S.gate(n, states).alias(n) for n in names])


ALPHA = 0.1


@query(
    "exponential_mean_innovation",
    f"""WITH RECURSIVE {GRID_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY slot) AS rn FROM grid),
    r AS (SELECT channel, slot, rn, v, v AS m, CAST(NULL AS DOUBLE) AS before FROM o WHERE rn = 1
      UNION ALL SELECT o.channel, o.slot, o.rn, o.v, {ALPHA} * o.v + (1 - {ALPHA}) * r.m, r.m FROM r JOIN o ON o.channel = r.channel AND o.rn = r.rn + 1)
    SELECT channel, slot, round(m, 6) AS mean, round(v - before, 5) AS innovation FROM r""",
)
def exponential_mean_innovation(spark, sf):
    cuts = slot_slices(spark, sf)
    rows = ordered_scan(grid(spark, sf), ["channel"], ["slot"], cuts, {"p": prev("v")})
    rows = rows.withColumn("a", F.when(F.col("p").isNull(), 0.0).otherwise(1 - ALPHA)).withColumn(
        "b", F.when(F.col("p").isNull(), F.col("v")).otherwise(ALPHA * F.col("v"))
    )
    out = linear_recurrence(rows, ["channel"], ["slot"], "a", "b", cuts, "mean")
    before = F.when(F.col("p").isNotNull(), (F.col("mean") - ALPHA * F.col("v")) / (1 - ALPHA))
    return out.select("channel", "slot", F.round("mean", 6).alias("mean"), F.round(F.col("v") - before, 5).alias("innovation"))


@query(
    "publication_cadence",
    f"""WITH {BOOKS_SQL}, g AS (SELECT channel, ts_us, seq, asks[1].price AS ap, coalesce(bids[1].price, -1) AS bp, lag(ts_us) OVER w AS t0, lag(asks[1].price) OVER w AS a0, lag(coalesce(bids[1].price, -1)) OVER w AS b0 FROM books
       WINDOW w AS (PARTITION BY channel ORDER BY ts_us, seq)),
    bins AS (SELECT channel, CAST(floor((ts_us - t0) / 1000.0 / 600000) AS BIGINT) AS bin, count(*) AS n FROM g WHERE t0 IS NOT NULL GROUP BY 1, 2),
    modal AS (SELECT channel, arg_max(bin, (n, -bin)) AS modal_bin, max(n) AS modal_count FROM bins GROUP BY 1)
    SELECT g.channel, count(*) AS publications, min(ts_us - t0) / 1000.0 AS gap_min_ms, max(ts_us - t0) / 1000.0 AS gap_max_ms, round(quantile_cont((ts_us - t0) / 1000.0, 0.05), 4) AS gap_p05_ms, round(quantile_cont((ts_us - t0) / 1000.0, 0.5), 4) AS gap_p50_ms,
      round(count(CASE WHEN ap <> a0 OR bp <> b0 THEN 1 END) / CAST(count(t0) AS DOUBLE), 6) AS top_price_change_fraction, any_value(modal_bin) AS modal_bin, any_value(modal_count) AS modal_count
    FROM g JOIN modal m ON g.channel = m.channel GROUP BY 1""",
)
def publication_cadence(spark, sf):
    top = F.struct(F.coalesce(B.best("bids"), F.lit(-1.0)).alias("b"), B.best("asks").alias("a"), "ts_us")
    rows = books(spark, sf).select("channel", "ts_us", "seq", top.alias("top"))
    seen = ordered_scan(rows, ["channel"], ["ts_us", "seq"], time_slices(spark, sf), {"p": prev("top")})
    gaps = seen.withColumn("gap_ms", (F.col("ts_us") - F.col("p.ts_us")) / 1000.0)
    changed = (F.col("top.b") != F.col("p.b")) | (F.col("top.a") != F.col("p.a"))
    base = gaps.groupBy("channel").agg(
        F.count(F.lit(1)).alias("publications"), F.min("gap_ms").alias("gap_min_ms"), F.max("gap_ms").alias("gap_max_ms"),
        F.round(F.count(F.when(changed, 1)) / F.count("gap_ms"), 6).alias("top_price_change_fraction"),
    )
    bins = gaps.where(F.col("gap_ms").isNotNull()).groupBy("channel", F.floor(F.col("gap_ms") / 600000).alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    modal = bins.groupBy("channel").agg(F.max_by("bin", F.struct("k", -F.col("bin"))).alias("modal_bin"), F.max("k").alias("modal_count"))
    q = quantiles(
        gaps, ["channel"], "gap_ms", {"gap_p05_ms": 0.05, "gap_p50_ms": 0.5}, slices_for(spark, sf, "cadence.gap", gaps, "gap_ms")
    ).select("channel", F.round("gap_p05_ms", 4).alias("gap_p05_ms"), F.round("gap_p50_ms", 4).alias("gap_p50_ms"))
    return base.join(modal, "channel").join(q, "channel")


EPI_W = 12 * HOUR


@query(
    "event_episodes",
    f"""WITH {TAPE_SQL}, b AS (SELECT instrument_id, ts_us, count(*) AS events FROM tape WHERE channel = 'purchase' GROUP BY 1, 2),
    f AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > {EPI_W} OR lag(ts_us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY instrument_id ORDER BY ts_us)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY instrument_id ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS isl FROM f)
    SELECT instrument_id, min(ts_us) AS start_ts, max(ts_us) + {EPI_W} AS end_ts, count(*) AS bursts, CAST(sum(events) AS BIGINT) AS events FROM i GROUP BY instrument_id, isl""",
)
def event_episodes(spark, sf):
    return episodes(
        tape(spark, sf).where(F.col("channel") == "purchase"), KEYS, "ts_us", EPI_W, time_slices(spark, sf)
    )


@query(
    "episode_structure",
    f"""WITH {TAPE_SQL}, b AS (SELECT channel, instrument_id, ts_us, count(*) AS events FROM tape GROUP BY 1, 2, 3),
    f AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > {EPI_W} OR lag(ts_us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY channel, instrument_id ORDER BY ts_us)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY channel, instrument_id ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS isl FROM f),
    e AS (SELECT channel, instrument_id, isl, count(*) AS bursts, max(ts_us) - min(ts_us) AS span FROM i GROUP BY 1, 2, 3)
    SELECT channel, count(*) AS episodes, CAST(sum(bursts) AS BIGINT) AS bursts, max(bursts) AS largest, round(avg(bursts), 6) AS mean_bursts, round(avg(span) / 1000000.0, 4) AS mean_span_s FROM e GROUP BY 1""",
)
def episode_structure(spark, sf):
    e = episodes(tape(spark, sf), ["channel", "instrument_id"], "ts_us", EPI_W, time_slices(spark, sf))
    span = F.col("end_ts") - EPI_W - F.col("start_ts")
    return e.groupBy("channel").agg(
        F.count(F.lit(1)).alias("episodes"), F.sum("bursts").alias("bursts"), F.max("bursts").alias("largest"),
        F.round(F.avg("bursts"), 6).alias("mean_bursts"), F.round(F.avg(span) / 1e6, 4).alias("mean_span_s"),
    )


SPAN_SQL = f"""{TAPE_SQL}, spans AS (SELECT instrument_id, seq, ts_us AS s, ts_us + CAST((seq % 5 + 1) * {4 * HOUR} AS BIGINT) AS e FROM tape WHERE channel IN ('click', 'error'))"""


def spans(spark, sf):
    length = ((F.col("seq") % 5 + 1) * (4 * HOUR)).cast("long")
    return tape(spark, sf).where(F.col("channel").isin("click", "error")).select(
        "instrument_id", "seq", F.col("ts_us").alias("s"), (F.col("ts_us") + length).alias("e")
    )


@query(
    "greedy_non_overlapping",
    f"""WITH RECURSIVE {SPAN_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY s, e) AS rn FROM spans),
    r AS (SELECT instrument_id, seq, rn, e AS lim, true AS selected FROM o WHERE rn = 1
      UNION ALL SELECT o.instrument_id, o.seq, o.rn, CASE WHEN o.s > r.lim THEN o.e ELSE r.lim END, o.s > r.lim FROM r JOIN o ON o.instrument_id = r.instrument_id AND o.rn = r.rn + 1)
    SELECT instrument_id, seq, selected FROM r""",
)
def greedy_non_overlapping_episodes(spark, sf):
    return greedy_non_overlapping(spans(spark, sf), KEYS, "s", "e", time_slices(spark, sf), ties=["seq"]).select("instrument_id", "seq", "selected")


@query(
    "minimum_spacing_sample",
    f"""WITH RECURSIVE {TAPE_SQL}, o AS (SELECT instrument_id, seq, ts_us, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_us, seq) AS rn FROM tape WHERE channel = 'view'),
    r AS (SELECT instrument_id, seq, rn, ts_us AS last_ts, true AS kept FROM o WHERE rn = 1
      UNION ALL SELECT o.instrument_id, o.seq, o.rn, CASE WHEN o.ts_us >= r.last_ts + {DAY} THEN o.ts_us ELSE r.last_ts END, o.ts_us >= r.last_ts + {DAY} FROM r JOIN o ON o.instrument_id = r.instrument_id AND o.rn = r.rn + 1)
    SELECT instrument_id, seq FROM r WHERE kept""",
)
def minimum_spacing_sample(spark, sf):
    rows = tape(spark, sf).where(F.col("channel") == "view").select("instrument_id", "seq", "ts_us")
    return minimum_spacing(rows, KEYS, "ts_us", DAY, time_slices(spark, sf), ties=["seq"]).select("instrument_id", "seq")


UNION_SQL = f"""{SPAN_SQL}, m AS (SELECT *, max(e) OVER (PARTITION BY instrument_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
 isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
 merged AS (SELECT instrument_id, min(s) AS s, max(e) AS e FROM isl GROUP BY instrument_id, k),
 cover AS (SELECT instrument_id, min(ts_us) AS c0, max(ts_us) AS c1 FROM tape GROUP BY 1),
 clip AS (SELECT m.instrument_id, greatest(s, c0) AS b0, least(e, c1) AS b1, c0, c1 FROM merged m JOIN cover c ON m.instrument_id = c.instrument_id WHERE least(e, c1) >= c0 AND greatest(s, c0) <= c1),
 pieces AS (SELECT instrument_id, coalesce(lag(b1) OVER w, c0) AS s, b0 AS e FROM clip WINDOW w AS (PARTITION BY instrument_id ORDER BY b0)
   UNION ALL SELECT instrument_id, max(b1), any_value(c1) FROM clip GROUP BY 1
   UNION ALL SELECT c.instrument_id, c0, c1 FROM cover c WHERE NOT EXISTS (SELECT 1 FROM clip WHERE clip.instrument_id = c.instrument_id)),
 clean AS (SELECT * FROM pieces WHERE s < e)"""


@query("interval_union", f"WITH {UNION_SQL} SELECT instrument_id, s, e FROM merged")
def interval_union(spark, sf):
    return union_intervals(spans(spark, sf), KEYS, "s", "e", time_slices(spark, sf))


def clean_windows(spark, sf):
    cover = tape(spark, sf).groupBy("instrument_id").agg(F.min("ts_us").alias("s"), F.max("ts_us").alias("e"))
    return subtract_intervals(cover, spans(spark, sf), KEYS, "s", "e", time_slices(spark, sf))


@query("clean_windows", f"WITH {UNION_SQL} SELECT instrument_id, s, e FROM clean")
def clean_windows_query(spark, sf):
    return clean_windows(spark, sf)


@query(
    "points_inside_clean_windows",
    f"""WITH {UNION_SQL} SELECT t.instrument_id, t.seq, EXISTS (SELECT 1 FROM clean c WHERE c.instrument_id = t.instrument_id AND c.s <= t.ts_us - {HOUR} AND t.ts_us + {HOUR} <= c.e) AS eligible
    FROM tape t WHERE channel = 'view'""",
)
def points_inside_clean_windows(spark, sf):
    support = HOUR
    points = tape(spark, sf).where(F.col("channel") == "view").select("instrument_id", "seq", (F.col("ts_us") - support).alias("t"))
    # Clean windows are disjoint, so only the latest one that has started can hold the point.
    out = asof(
        points, clean_windows(spark, sf), keys=KEYS, left_ts="t", right_ts="s", values=["e"], slices=time_slices(spark, sf)
    )
    return out.select("instrument_id", "seq", F.coalesce(F.col("t") + 2 * support <= F.col("m_e"), F.lit(False)).alias("eligible"))


@query(
    "bucket_exposure_seconds",
    f"""WITH {UNION_SQL}, b AS (SELECT instrument_id, s, e, unnest(range(s // {DAY}, (e - 1) // {DAY} + 1)) AS bucket FROM clean)
    SELECT bucket, count(*) AS pieces, round(sum(least(e, (bucket + 1) * {DAY}) - greatest(s, bucket * {DAY})) / 1000000.0, 3) AS seconds FROM b GROUP BY 1""",
)
def bucket_exposure_seconds(spark, sf):
    return exposure_by_bucket(clean_windows(spark, sf), "s", "e", DAY, ["instrument_id"]).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("pieces"), F.round(F.sum("seconds"), 3).alias("seconds")
    )


@query(
    "past_session_percentile",
    f"""WITH {ATOMIC_SQL}, a AS (SELECT kind, side, ts_us // {DAY} AS session, seq, price, magnitude FROM atomic)
    SELECT kind, side, session, magnitude, count(*) AS events, any_value(h.n) AS history_n, CASE WHEN any_value(h.n) >= 200 THEN round(any_value(h.le) / CAST(any_value(h.n) AS DOUBLE), 6) END AS percentile
    FROM a LEFT JOIN LATERAL (SELECT count(*) AS n, count(CASE WHEN b.magnitude <= a.magnitude THEN 1 END) AS le FROM a b WHERE b.kind = a.kind AND b.side = a.side AND b.session < a.session) h ON true GROUP BY 1, 2, 3, 4""",
)
def past_session_percentile(spark, sf):
    from ..operators.history import past_session_percentiles

    rows = atomic(spark, sf).withColumn("session", F.expr(f"ts_us div {DAY}"))
    cuts = slices_for(spark, sf, "atomic.magnitude", rows.select("magnitude"), "magnitude")
    out = past_session_percentiles(rows, ["kind", "side"], "session", "magnitude", cuts)
    return out.select(
        "kind", "side", "session", "magnitude", "events", "history_n",
        F.when(F.col("history_n") >= 200, F.round(F.col("at_or_below") / F.col("history_n"), 6)).alias("percentile"),
    )


CUTS = (0.5, 0.9, 0.99)


def magnitudes(spark, sf):
    """How often each magnitude of a kind and side occurs, stored, with cuts of its values: the changes are read once."""
    counted = cut_lineage(atomic(spark, sf).groupBy("kind", "side", "magnitude").agg(F.count(F.lit(1)).alias("n")))
    return counted, slices_for(spark, sf, "atomic.magnitudes", counted, "magnitude")


@query(
    "selectivity_curve",
    f"""WITH {ATOMIC_SQL}, c AS (SELECT *, cume_dist() OVER (PARTITION BY kind, side ORDER BY magnitude) AS pct FROM atomic), k AS (SELECT unnest([0.5, 0.9, 0.99]) AS cutoff),
    r AS (SELECT kind, side, instrument_id, ts_us, CAST(cutoff AS DOUBLE) AS cutoff, count(*) AS n FROM c, k WHERE pct >= cutoff GROUP BY ALL),
    f AS (SELECT *, CASE WHEN lag(ts_us) OVER w IS NULL OR ts_us - lag(ts_us) OVER w > {EPI_W} THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY kind, side, cutoff, instrument_id ORDER BY ts_us))
    SELECT kind, side, cutoff, CAST(sum(n) AS BIGINT) AS events, count(*) AS bursts, CAST(sum(new) AS BIGINT) AS episodes FROM f GROUP BY 1, 2, 3""",
)
def selectivity_curve(spark, sf):
    cell = ["kind", "side"]
    counted, cuts = magnitudes(spark, sf)
    pct = positions(counted, cell, "magnitude", cuts, F.col("n")).select(*cell, "magnitude", (F.col("cum") / F.col("size")).alias("pct"))
    rows = atomic(spark, sf).select(*cell, "magnitude", "instrument_id", "ts_us").join(pct, [*cell, "magnitude"])
    out = episode_counts(rows, cell, KEYS, "ts_us", EPI_W, time_slices(spark, sf), {str(c): F.col("pct") >= c for c in CUTS})
    return out.select(*cell, F.col("level").cast("double").alias("cutoff"), "events", "bursts", "episodes")


@query(
    "in_sample_magnitude_cutoffs",
    f"""WITH {ATOMIC_SQL} SELECT kind, side, count(*) AS n, round(quantile_cont(magnitude, 0.5), 6) AS p50, round(quantile_cont(magnitude, 0.9), 6) AS p90, round(quantile_cont(magnitude, 0.99), 6) AS p99 FROM atomic GROUP BY 1, 2""",
)
def in_sample_magnitude_cutoffs(spark, sf):
    counted, cuts = magnitudes(spark, sf)
    q = quantiles(counted, ["kind", "side"], "magnitude", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, cuts, weight=F.col("n"))
    return q.select("kind", "side", "n", *[F.round(p, 6).alias(p) for p in ("p50", "p90", "p99")])


@query(
    "next_different_mid_transition",
    f"""WITH {BOOKS_SQL}, s AS (SELECT instrument_id, ts_us, seq, (bids[1].price + asks[1].price) / 2.0 AS mid, CASE WHEN (asks[1].price - bids[1].price) >= 0 THEN 'i' || CAST(greatest(least(CAST(trunc(((bids[1].quantity - asks[1].quantity) / CAST(bids[1].quantity + asks[1].quantity AS DOUBLE) + 1) / 2 * 10) AS INTEGER), 9), 0) AS VARCHAR) END AS st FROM books),
    m AS (SELECT * FROM s WHERE mid IS NOT NULL), n AS (SELECT *, lag(mid) OVER (PARTITION BY instrument_id ORDER BY ts_us, seq) AS pm FROM m),
    c AS (SELECT *, CASE WHEN pm IS NULL OR mid <> pm THEN seq END AS chg FROM n),
    x AS (SELECT *, min(chg) OVER (PARTITION BY instrument_id ORDER BY ts_us, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM c)
    SELECT a.instrument_id, a.seq, a.st AS state, b.st AS next_state, round((b.mid - a.mid) / 0.05, 4) AS mid_change_ticks, b.ts_us AS resolved_ts FROM x a JOIN m b ON a.nxt = b.seq WHERE a.st IS NOT NULL AND b.st IS NOT NULL""",
)
def next_different_mid_transition(spark, sf):
    return stoikov_transitions(spark, sf).select(
        "instrument_id", "seq", "state", "next_state", F.round("mid_change_ticks", 4).alias("mid_change_ticks"), "resolved_ts"
    )


def stoikov_transitions(spark, sf):
    cuts = time_slices(spark, sf)
    bq, aq = B.best("bids", "quantity").cast("double"), B.best("asks", "quantity").cast("double")
    state = F.when(
        B.best("asks") - B.best("bids") >= 0, F.concat(F.lit("i"), B.imbalance_bucket(B.imbalance(bq, aq)).cast("string"))
    )
    rows = books(spark, sf).select(
        "instrument_id", "ts_us", "seq", ((B.best("bids") + B.best("asks")) / 2.0).alias("mid"), state.alias("state")
    ).where(F.col("mid").isNotNull())
    stepped = ordered_scan(rows, KEYS, ["ts_us", "seq"], cuts, {"pm": prev("mid")})
    turn = F.when(
        F.col("pm").isNull() | (F.col("mid") != F.col("pm")), F.struct("mid", "state", "ts_us")
    )
    found = ordered_scan(stepped, KEYS, ["ts_us", "seq"], cuts, {"n": first_after(turn)})
    return found.where(F.col("n.state").isNotNull() & F.col("state").isNotNull()).select(
        "instrument_id", "seq", "ts_us", "state", F.col("n.state").alias("next_state"),
        ((F.col("n.mid") - F.col("mid")) / F.lit(B.TICK)).alias("mid_change_ticks"), F.col("n.ts_us").alias("resolved_ts"),
    )


@query(
    "path_extremum",
    f"""WITH {MIDS_SQL}, a AS (SELECT an.instrument_id, an.seq, an.ts_us, p.mid AS base FROM anchors an ASOF JOIN path p ON an.instrument_id = p.instrument_id AND an.ts_us >= p.ts_us),
    j AS (SELECT a.*, p.mid - base AS dev, p.ts_us - a.ts_us AS off FROM a LEFT JOIN path p ON a.instrument_id = p.instrument_id AND p.ts_us > a.ts_us AND p.ts_us <= a.ts_us + {3 * DAY})
    SELECT instrument_id, seq, count(dev) AS used, round(coalesce(arg_max(dev, (abs(dev), -off)) FILTER (WHERE abs(dev) > 0), 0), 6) AS peak,
      coalesce(arg_max(off, (abs(dev), -off)) FILTER (WHERE abs(dev) > 0), 0) AS offset_us FROM j GROUP BY 1, 2""",
)
def path_extremum(spark, sf):
    cuts = time_slices(spark, sf)
    path = mids(spark, sf).where(F.col("mid").isNotNull()).select("instrument_id", "seq", "ts_us", "mid")
    anchored = asof(
        tape(spark, sf).where(F.col("channel") == "click").select("instrument_id", "seq", "ts_us"), path,
        keys=KEYS, left_ts="ts_us", right_ts="ts_us", values=["mid"], slices=cuts, right_ties=["seq"], prefix="base_",
    ).where(F.col("base_mid").isNotNull())
    axis = anchored.withColumn("a", F.lit(True)).unionByName(path.select("instrument_id", "ts_us", "mid"), allowMissingColumns=True)
    h = 3 * DAY
    hi, lo = F.struct("mid", -F.col("ts_us")), F.struct(-F.col("mid"), -F.col("ts_us"))
    # The farthest point from any base is the earliest maximum or the earliest minimum of the path.
    out = sliding(
        axis, KEYS, "ts_us", cuts,
        {
            "used": lambda f: F.count("mid").over(f(1, h)),
            "hi": lambda f: F.max(F.when(F.col("mid").isNotNull(), hi)).over(f(1, h)),
            "lo": lambda f: F.max(F.when(F.col("mid").isNotNull(), lo)).over(f(1, h)),
        },
        ahead=h,
    ).where(F.col("a"))
    up, down = F.col("hi.mid") - F.col("base_mid"), -F.col("lo.col1") - F.col("base_mid")
    t_up, t_down = -F.col("hi.col2") - F.col("ts_us"), -F.col("lo.col2") - F.col("ts_us")
    take_up = (F.abs(up) > F.abs(down)) | ((F.abs(up) == F.abs(down)) & (t_up <= t_down))
    peak = F.coalesce(F.when(take_up, up).otherwise(down), F.lit(0.0))
    off = F.when(take_up, t_up).otherwise(t_down)
    return out.select(
        "instrument_id", "seq", "used", F.round(peak, 6).alias("peak"), F.when(peak == 0, F.lit(0)).otherwise(off).cast("long").alias("offset_us")
    )


@query(
    "grid_snapshots",
    f"""WITH {BOOKS_SQL}, st AS (SELECT instrument_id, seq, ts_us, CASE WHEN len(bids) > 0 AND bids[1].price < asks[1].price THEN (bids[1].price + asks[1].price) / 2.0 END AS mid FROM books),
    g AS (SELECT instrument_id, unnest(range((min(ts_us) + {6 * HOUR - 1}) // {6 * HOUR}, max(ts_us) // {6 * HOUR} + 1)) * {6 * HOUR} AS grid_ts FROM st GROUP BY 1)
    SELECT g.instrument_id, grid_ts, round(s.mid, 6) AS mid, grid_ts - s.ts_us AS age_us FROM g ASOF JOIN st s ON g.instrument_id = s.instrument_id AND g.grid_ts >= s.ts_us
    WHERE s.mid IS NOT NULL AND grid_ts - s.ts_us <= {DAY}""",
)
def grid_snapshots(spark, sf):
    from .panel_queries import snapshot_grid

    rows = books(spark, sf)
    mid = F.when((F.size("bids") > 0) & (B.best("bids") < B.best("asks")), (B.best("bids") + B.best("asks")) / 2.0)
    states = rows.select("instrument_id", "seq", "ts_us", mid.alias("mid"))
    snaps = snapshot_grid(states, KEYS, 6 * HOUR, time_slices(spark, sf), ["mid"])
    return snaps.where(F.col("mid").isNotNull() & (F.col("grid_ts") - F.col("state_ts") <= DAY)).select(
        "instrument_id", "grid_ts", F.round("mid", 6).alias("mid"), (F.col("grid_ts") - F.col("state_ts")).alias("age_us")
    )


@query(
    "bar_gaps",
    f"""WITH {TAPE_SQL}, b AS (SELECT instrument_id, ts_us // {DAY} * {DAY} AS s, (ts_us // {DAY} + 1) * {DAY} AS e FROM tape GROUP BY ALL), l AS (SELECT *, lag(e) OVER (PARTITION BY instrument_id ORDER BY s) AS pe FROM b)
    SELECT instrument_id, pe AS gap_start, s AS gap_end FROM l WHERE pe < s""",
)
def bar_gaps(spark, sf):
    from ..sources.bars import bar_gaps as gaps

    day = F.expr(f"ts_us div {DAY}")
    bars = tape(spark, sf).groupBy("instrument_id", day.alias("d")).agg(F.count(F.lit(1)).alias("rows"))
    bars = bars.select("instrument_id", (F.col("d") * DAY).alias("s"), ((F.col("d") + 1) * DAY).alias("e"))
    return gaps(bars, KEYS, "s", "e", time_slices(spark, sf))


@query(
    "covariates_at_anchor",
    f"""WITH {BOOKS_SQL}, q AS (SELECT instrument_id, seq, ts_us, (bids[1].price + asks[1].price) / 2.0 / 0.05 AS m, asks[1].price - bids[1].price AS spread,
       CAST(list_sum(list_transform(bids, lambda x: x.quantity)) AS DOUBLE) AS bd, CAST(list_sum(list_transform(asks, lambda x: x.quantity)) AS DOUBLE) AS ad FROM books WHERE channel = 'view' AND len(bids) > 0 AND bids[1].price < asks[1].price),
    d AS (SELECT *, (bd - lag(bd) OVER w) - (ad - lag(ad) OVER w) AS ofi, m - lag(m) OVER w AS step, min(ts_us) OVER (PARTITION BY instrument_id) AS t0, ts_us - {DAY} AS rt FROM q WINDOW w AS (PARTITION BY instrument_id ORDER BY ts_us, seq)),
    v AS (SELECT *, count(*) OVER r AS n, stddev_pop(step) OVER r2 AS rv FROM d WINDOW r AS (PARTITION BY instrument_id ORDER BY ts_us RANGE BETWEEN {10 * DAY} PRECEDING AND CURRENT ROW), r2 AS (PARTITION BY instrument_id ORDER BY ts_us RANGE BETWEEN {10 * DAY} PRECEDING AND CURRENT ROW))
    SELECT v.instrument_id, v.seq, round(v.spread, 6) AS spread, v.bd + v.ad AS top_depth, coalesce(v.ofi, 0) AS top_ofi, round(v.m - p.m, 6) AS recent_return, v.n AS path_points FROM v
    ASOF JOIN q p ON v.instrument_id = p.instrument_id AND v.rt >= p.ts_us WHERE v.ts_us - {10 * DAY} >= v.t0 AND v.n >= 3""",
)
def covariates_at_anchor(spark, sf):
    cuts = time_slices(spark, sf)
    q = books(spark, sf).where((F.col("channel") == "view") & (F.size("bids") > 0) & (B.best("bids") < B.best("asks"))).select(
        "instrument_id", "seq", "ts_us", ((B.best("bids") + B.best("asks")) / 2.0 / F.lit(B.TICK)).alias("m"),
        (B.best("asks") - B.best("bids")).alias("spread"), B.side_sum("bids").alias("bd"), B.side_sum("asks").alias("ad"),
    )
    # The first instant of a key is its running minimum, so it rides on the same scan.
    from ..operators.slices import run_min

    d = ordered_scan(q, KEYS, ["ts_us", "seq"], cuts, {"p": prev(F.struct("bd", "ad")), "t0": run_min("ts_us")})
    n = sliding(d, KEYS, "ts_us", cuts, {"n": lambda f: F.count(F.lit(1)).over(f(-10 * DAY, 0))}, back=10 * DAY).withColumn(
        "rt", F.col("ts_us") - DAY
    )
    out = asof(n, q, keys=KEYS, left_ts="rt", right_ts="ts_us", values=["m"], slices=cuts, right_ties=["seq"], prefix="past_")
    ofi = (F.col("bd") - F.col("p.bd")) - (F.col("ad") - F.col("p.ad"))
    return out.where((F.col("ts_us") - 10 * DAY >= F.col("t0")) & (F.col("n") >= 3) & F.col("past_m").isNotNull()).select(
        "instrument_id", "seq", F.round("spread", 6).alias("spread"), (F.col("bd") + F.col("ad")).alias("top_depth"),
        F.coalesce(ofi, F.lit(0.0)).alias("top_ofi"), F.round(F.col("m") - F.col("past_m"), 6).alias("recent_return"), F.col("n").alias("path_points"),
    )


@query(
    "rolling_win_score",
    f"""WITH {GRID_SQL}, f AS (SELECT g.channel, g.slot, g.v - p.v AS prediction, n.v - g.v AS actual FROM grid g JOIN grid p ON g.channel = p.channel AND p.slot = g.slot - 1 JOIN grid n ON g.channel = n.channel AND n.slot = g.slot + 1),
    s AS (SELECT *, slot + 1 AS end_slot, CASE WHEN prediction > 0 THEN CASE WHEN actual >= prediction THEN 1 WHEN actual <= -prediction THEN -1 ELSE 0 END
      WHEN prediction < 0 THEN CASE WHEN actual <= prediction THEN 1 WHEN actual >= -prediction THEN -1 ELSE 0 END ELSE 0 END AS score FROM f)
    SELECT channel, end_slot, score, round(avg(score) OVER w, 6) AS rolling_mean, count(*) OVER w AS rolling_n FROM s WINDOW w AS (PARTITION BY channel ORDER BY end_slot RANGE BETWEEN 23 PRECEDING AND CURRENT ROW)""",
)
def rolling_win_score(spark, sf):
    from ..operators.evaluation import win_score

    cuts = slot_slices(spark, sf)
    nb = sliding(
        grid(spark, sf), ["channel"], "slot", cuts,
        {"p": lambda f: F.max("v").over(f(-1, -1)), "x": lambda f: F.max("v").over(f(1, 1))}, back=1, ahead=1,
    ).where(F.col("p").isNotNull() & F.col("x").isNotNull())
    scored = nb.select(
        "channel", (F.col("slot") + 1).alias("end_slot"), win_score(F.col("v") - F.col("p"), F.col("x") - F.col("v")).alias("score")
    )
    out = sliding(
        scored, ["channel"], "end_slot", cuts,
        {"m": lambda f: F.avg("score").over(f(-23, 0)), "rolling_n": lambda f: F.count(F.lit(1)).over(f(-23, 0))}, back=23,
    )
    return out.select("channel", "end_slot", "score", F.round("m", 6).alias("rolling_mean"), "rolling_n")
