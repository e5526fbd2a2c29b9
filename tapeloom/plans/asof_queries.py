"""Event-time joins: prevailing quotes, as-of labels, refusals and interval matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import book as B
from ..functions.book import TICK
from ..operators.asof import asof, asof_offsets
from ..operators.slices import nxt, ordered_scan, run_sum
from ..operators.trades import classify_prints
from ..session import cut_lineage
from .bindings import BOOKS_SQL, DAY, HOUR, KEYS, TAPE_SQL, books, slices_for, table, tape, time_slices
from .registry import query

BOUND_MS = 12 * 3_600_000.0


def depth_rows(spark, sf):
    """Depth updates: views are one channel, clicks the other; one side per row."""
    seq = F.col("seq")
    return (
        books(spark, sf)
        .where(F.col("channel").isin("view", "click"))
        .select(
            "instrument_id",
            "seq",
            "ts_us",
            F.when(F.col("channel") == "view", "depth20").otherwise("depth200").alias("channel"),
            F.when(seq % 2 == 0, "bid").otherwise("ask").alias("update_side"),
            (seq % 29 == 0).alias("reconnect"),
            "bids",
            "asks",
        )
    )


def print_rows(spark, sf):
    """Prints: purchases and signups on the tick grid, with a mostly rising cumulative volume."""
    seq = F.col("seq")
    ticks = 1000 + F.floor(F.col("value") / 20) + seq % 5 - 2
    return (
        tape(spark, sf)
        .where(F.col("channel").isin("purchase", "signup"))
        .select(
            "instrument_id",
            "seq",
            "ts_us",
            (ticks.cast("double") * F.lit(TICK)).alias("price"),
            (1 + seq % 40).alias("last_quantity"),
            F.when(seq % 37 == 0, seq * 10 - 5000).otherwise(seq * 10).alias("cumulative_volume"),
        )
    )


PRINTS_SQL = f"""{BOOKS_SQL},
depth AS (SELECT instrument_id, seq, ts_us, CASE WHEN channel = 'view' THEN 'depth20' ELSE 'depth200' END AS channel,
  CASE WHEN seq % 2 = 0 THEN 'bid' ELSE 'ask' END AS update_side, seq % 29 = 0 AS reconnect, bids, asks
  FROM books WHERE channel IN ('view', 'click')),
prints AS (SELECT instrument_id, seq, ts_us,
  CAST(1000 + CAST(floor(value / 20) AS BIGINT) + seq % 5 - 2 AS DOUBLE) * 0.05 AS price, 1 + seq % 40 AS last_quantity,
  CASE WHEN seq % 37 = 0 THEN seq * 10 - 5000 ELSE seq * 10 END AS cumulative_volume
  FROM tape WHERE channel IN ('purchase', 'signup'))"""

CLASSIFIED_SQL = f"""{PRINTS_SQL},
sides AS (SELECT *,
  last_value(CASE WHEN reconnect THEN seq END IGNORE NULLS) OVER w AS reset_at,
  last_value(CASE WHEN update_side = 'bid' THEN seq END IGNORE NULLS) OVER w AS bid_seq,
  last_value(CASE WHEN update_side = 'ask' THEN seq END IGNORE NULLS) OVER w AS ask_seq,
  last_value(CASE WHEN update_side = 'bid' THEN ts_us END IGNORE NULLS) OVER w AS bid_ts,
  last_value(CASE WHEN update_side = 'ask' THEN ts_us END IGNORE NULLS) OVER w AS ask_ts
  FROM depth WINDOW w AS (PARTITION BY instrument_id, channel ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING)),
marks AS (SELECT instrument_id, channel, seq, ts_us, bids[1].price AS bid, asks[1].price AS ask, bid_ts, ask_ts,
  bid_seq IS NOT NULL AND ask_seq IS NOT NULL AND bid_seq >= coalesce(reset_at, -1) AND ask_seq >= coalesce(reset_at, -1)
    AND len(bids) > 0 AND len(asks) > 0 AS complete FROM sides
  WHERE reconnect OR (bid_seq >= coalesce(reset_at, -1) AND ask_seq >= coalesce(reset_at, -1) AND len(bids) > 0 AND len(asks) > 0)),
stepped AS (SELECT *, lag(price) OVER w AS p0, lag(cumulative_volume) OVER w AS v0 FROM prints
  WINDOW w AS (PARTITION BY instrument_id ORDER BY ts_us, seq)),
turned AS (SELECT *, last_value(CASE WHEN price <> p0 THEN p0 END IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY ts_us, seq
  ROWS UNBOUNDED PRECEDING) AS differing FROM stepped),
m20 AS (SELECT * FROM marks WHERE channel = 'depth20'), m200 AS (SELECT * FROM marks WHERE channel = 'depth200'),
joined AS (SELECT t.*,
  CASE WHEN a.complete THEN a.bid END AS bid_a, CASE WHEN a.complete THEN a.ask END AS ask_a,
  CASE WHEN a.complete THEN greatest(a.bid_ts, a.ask_ts) END AS at_a, CASE WHEN a.complete THEN least(a.bid_ts, a.ask_ts) END AS old_a,
  CASE WHEN b.complete THEN b.bid END AS bid_b, CASE WHEN b.complete THEN b.ask END AS ask_b,
  CASE WHEN b.complete THEN greatest(b.bid_ts, b.ask_ts) END AS at_b, CASE WHEN b.complete THEN least(b.bid_ts, b.ask_ts) END AS old_b
  FROM turned t ASOF LEFT JOIN m20 a ON t.instrument_id = a.instrument_id AND t.ts_us >= a.ts_us
  ASOF LEFT JOIN m200 b ON t.instrument_id = b.instrument_id AND t.ts_us >= b.ts_us),
chosen AS (SELECT instrument_id, seq, ts_us, price, last_quantity, cumulative_volume, cumulative_volume - v0 AS volume_increment,
  differing AS last_differing_price, at_b IS NOT NULL AND (at_a IS NULL OR at_b >= at_a) AS deep, *
  EXCLUDE (instrument_id, seq, ts_us, price, last_quantity, cumulative_volume, differing)
  FROM joined WHERE cumulative_volume > v0),
quoted AS (SELECT instrument_id, seq, ts_us, price, last_quantity, cumulative_volume, volume_increment, last_differing_price,
  CASE WHEN deep THEN 'depth200' WHEN at_a IS NOT NULL THEN 'depth20' END AS quote_channel,
  CASE WHEN deep THEN bid_b ELSE bid_a END AS quote_bid, CASE WHEN deep THEN ask_b ELSE ask_a END AS quote_ask,
  CASE WHEN deep THEN at_b ELSE at_a END AS quote_ts, (ts_us - CASE WHEN deep THEN old_b ELSE old_a END) / 1000.0 AS quote_age_ms FROM chosen),
reasoned AS (SELECT *, CASE WHEN quote_bid IS NULL THEN 'no_prevailing_quote'
  WHEN quote_bid <= 0 OR quote_ask <= 0 OR quote_bid >= quote_ask THEN 'invalid_quote'
  WHEN quote_age_ms > {BOUND_MS} THEN 'stale_quote'
  WHEN CAST(price AS DECIMAL(18,8)) * 2 <> CAST(quote_bid AS DECIMAL(18,8)) + CAST(quote_ask AS DECIMAL(18,8)) THEN 'quote_rule'
  WHEN last_differing_price IS NULL THEN 'no_prior_differing_trade' ELSE 'tick_rule' END AS reason FROM quoted),
classified AS (SELECT *, CASE WHEN reason = 'quote_rule' THEN CASE WHEN CAST(price AS DECIMAL(18,8)) * 2 >
    CAST(quote_bid AS DECIMAL(18,8)) + CAST(quote_ask AS DECIMAL(18,8)) THEN 'buy' ELSE 'sell' END
  WHEN reason = 'tick_rule' THEN CASE WHEN price > last_differing_price THEN 'buy' ELSE 'sell' END ELSE 'unclassified' END AS side,
  reason IN ('no_prevailing_quote', 'invalid_quote', 'stale_quote') AS degraded, volume_increment > last_quantity AS coalesced FROM reasoned)"""


def classified(spark, sf):
    return classify_prints(
        print_rows(spark, sf),
        depth_rows(spark, sf),
        KEYS,
        time_slices(spark, sf),
        bound_ms=BOUND_MS,
        channels=["depth20", "depth200"],
    )


def stored_prints(spark, sf):
    """Classified prints as a stored table, the way a tape keeps them for later readers."""
    return cut_lineage(classified(spark, sf))


_CLASS_COLS = (
    "instrument_id, seq, ts_us, round(price, 6) AS price, last_quantity, cumulative_volume, volume_increment, quote_channel, "
    "round(quote_bid, 6) AS quote_bid, round(quote_ask, 6) AS quote_ask, quote_ts, round(quote_age_ms, 3) AS quote_age_ms, "
    "round(last_differing_price, 6) AS last_differing_price, side, reason, degraded, coalesced"
)


@query("trade_classification", f"WITH {CLASSIFIED_SQL} SELECT {_CLASS_COLS} FROM classified")
def trade_classification(spark, sf):
    out = classified(spark, sf)
    rounded = {"price": 6, "quote_bid": 6, "quote_ask": 6, "quote_age_ms": 3, "last_differing_price": 6}
    return out.select(*[F.round(c, rounded[c]).alias(c) if c in rounded else F.col(c) for c in out.columns])


def mids(spark, sf, channel="view"):
    """Usable midpoints of one channel: right side of most as-of queries."""
    rows = books(spark, sf).where(F.col("channel") == channel)
    mid = (B.best(F.col("bids")) + B.best(F.col("asks"))) / 2.0
    return rows.select(
        "instrument_id",
        "seq",
        "ts_us",
        F.when((F.size("bids") > 0) & (B.best(F.col("bids")) < B.best(F.col("asks"))), mid).alias("mid"),
    )


MIDS_SQL = f"""{BOOKS_SQL},
quotes AS (SELECT instrument_id, seq, ts_us, CASE WHEN len(bids) > 0 AND bids[1].price < asks[1].price
  THEN (bids[1].price + asks[1].price) / 2.0 END AS mid FROM books WHERE channel = 'view'),
path AS (SELECT * FROM quotes WHERE mid IS NOT NULL),
span AS (SELECT instrument_id, min(ts_us) AS t0, max(ts_us) AS t1 FROM path GROUP BY 1),
anchors AS (SELECT instrument_id, seq, ts_us FROM tape WHERE channel = 'click')"""


def anchors(spark, sf):
    return tape(spark, sf).where(F.col("channel") == "click").select("instrument_id", "seq", "ts_us")


@query(
    "asof_covered_midpoint",
    f"""WITH {MIDS_SQL} SELECT a.instrument_id, a.seq, CASE WHEN a.ts_us BETWEEN s.t0 AND s.t1 THEN round(p.mid, 6) END AS mid,
      CASE WHEN a.ts_us BETWEEN s.t0 AND s.t1 THEN p.ts_us END AS quote_ts
    FROM anchors a ASOF LEFT JOIN path p ON a.instrument_id = p.instrument_id AND a.ts_us >= p.ts_us
    LEFT JOIN span s ON a.instrument_id = s.instrument_id""",
)
def asof_covered_midpoint(spark, sf):
    out = asof(
        anchors(spark, sf),
        mids(spark, sf).where(F.col("mid").isNotNull()),
        keys=KEYS, left_ts="ts_us", right_ts="ts_us", values=["mid", "ts_us"],
        slices=time_slices(spark, sf), right_ties=["seq"], covered=True,
    )
    return out.select("instrument_id", "seq", F.round("m_mid", 6).alias("mid"), F.col("m_ts_us").alias("quote_ts"))


@query(
    "asof_strict_previous",
    f"""WITH {MIDS_SQL} SELECT a.instrument_id, a.seq, round(p.mid, 6) AS mid FROM quotes a
    ASOF LEFT JOIN path p ON a.instrument_id = p.instrument_id AND a.ts_us > p.ts_us""",
)
def asof_strict_previous(spark, sf):
    q = mids(spark, sf)
    out = asof(
        q.select("instrument_id", "seq", "ts_us"), q.where(F.col("mid").isNotNull()),
        keys=KEYS, left_ts="ts_us", right_ts="ts_us", values=["mid"],
        slices=time_slices(spark, sf), right_ties=["seq"], strict=True,
    )
    return out.select("instrument_id", "seq", F.round("m_mid", 6).alias("mid"))


@query(
    "first_quote_after_print",
    f"""WITH {MIDS_SQL}, pr AS (SELECT instrument_id, seq, ts_us FROM tape WHERE channel = 'purchase')
    SELECT a.instrument_id, a.seq, CASE WHEN p.ts_us - a.ts_us <= {12 * HOUR} THEN p.ts_us - a.ts_us END AS delay_us,
      CASE WHEN p.ts_us - a.ts_us <= {12 * HOUR} THEN round(p.mid, 6) END AS mid
    FROM pr a ASOF LEFT JOIN path p ON a.instrument_id = p.instrument_id AND a.ts_us < p.ts_us""",
)
def first_quote_after_print(spark, sf):
    prints = tape(spark, sf).where(F.col("channel") == "purchase").select("instrument_id", "seq", "ts_us")
    out = asof(
        prints, mids(spark, sf).where(F.col("mid").isNotNull()),
        keys=KEYS, left_ts="ts_us", right_ts="ts_us", values=["mid", "ts_us"],
        slices=time_slices(spark, sf), right_ties=["seq"], direction="forward", strict=True,
    )
    delay = F.col("m_ts_us") - F.col("ts_us")
    near = delay <= 12 * HOUR
    return out.select(
        "instrument_id", "seq", F.when(near, delay).alias("delay_us"), F.when(near, F.round("m_mid", 6)).alias("mid")
    )


def with_epoch(spark, sf):
    """Tape rows with the connection epoch: one more than the error rows seen so far."""
    flag = F.when(F.col("channel") == "error", 1).otherwise(0).cast("long")
    return ordered_scan(
        books(spark, sf), KEYS, ["ts_us", "seq"], time_slices(spark, sf), {"epoch": run_sum(flag)}
    ).withColumn("epoch", F.col("epoch") + 1)


EPOCH_SQL = f"""{BOOKS_SQL}, ep AS (SELECT *, 1 + CAST(sum(CASE WHEN channel = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_id
  ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM books),
 eq AS (SELECT instrument_id, seq, ts_us, epoch, coalesce(len(bids) >= 5 AND len(asks) >= 5 AND bids[1].price < asks[1].price, false) AS usable,
   (bids[1].price + asks[1].price) / 2.0 AS mid FROM ep WHERE channel = 'view'),
 ea AS (SELECT instrument_id, seq, ts_us, epoch FROM ep WHERE channel = 'click')"""


def epoch_quotes(rows):
    bids, asks = F.col("bids"), F.col("asks")
    usable = (F.size(bids) >= 5) & (F.size(asks) >= 5) & (B.best(bids) < B.best(asks))
    return rows.where(F.col("channel") == "view").select(
        "instrument_id", "seq", "ts_us", "epoch", F.coalesce(usable, F.lit(False)).alias("usable"),
        ((B.best(bids) + B.best(asks)) / 2.0).alias("mid"),
    )


def refusal(epoch, found_epoch, usable, age_us, max_age_us):
    """Why a same-epoch as-of is refused; null when it resolves. The latest row decides."""
    return (
        F.when(found_epoch.isNull(), "no_prior_state")
        .when(found_epoch != epoch, "epoch_mismatch")
        .when(~usable, "unusable_state")
        .when(age_us > max_age_us, "stale_state")
    )


@query(
    "asof_refusal_reasons",
    f"""WITH {EPOCH_SQL}, j AS (SELECT a.instrument_id, a.seq, a.epoch, q.epoch AS qe, q.usable, q.mid, a.ts_us - q.ts_us AS age FROM ea a
      ASOF LEFT JOIN eq q ON a.instrument_id = q.instrument_id AND a.ts_us >= q.ts_us),
    r AS (SELECT *, CASE WHEN qe IS NULL THEN 'no_prior_state' WHEN qe <> epoch THEN 'epoch_mismatch' WHEN NOT usable THEN 'unusable_state'
      WHEN age > {2 * DAY} THEN 'stale_state' END AS reason FROM j)
    SELECT instrument_id, seq, reason, CASE WHEN reason IS NULL THEN round(mid, 6) END AS mid FROM r""",
)
def asof_refusal_reasons(spark, sf):
    rows = with_epoch(spark, sf)
    left = rows.where(F.col("channel") == "click").select("instrument_id", "seq", "ts_us", "epoch")
    out = asof(
        left, epoch_quotes(rows), keys=KEYS, left_ts="ts_us", right_ts="ts_us",
        values=["epoch", "usable", "mid", "ts_us"], slices=time_slices(spark, sf), right_ties=["seq"],
    )
    reason = refusal(
        F.col("epoch"), F.col("m_epoch"), F.col("m_usable"), F.col("ts_us") - F.col("m_ts_us"), 2 * DAY
    )
    return out.withColumn("reason", reason).select(
        "instrument_id", "seq", "reason", F.when(F.col("reason").isNull(), F.round("m_mid", 6)).alias("mid")
    )


GAP, SPAN = 2 * HOUR, 8 * HOUR


@query(
    "guarded_move",
    f"""WITH {EPOCH_SQL}, x AS (SELECT *, ts_us + {GAP} AS ts_s, ts_us + {GAP + SPAN} AS ts_e FROM ea),
    j AS (SELECT x.*, s.epoch AS s_epoch, s.usable AS s_usable, s.mid AS s_mid, x.ts_s - s.ts_us AS s_age,
        e.epoch AS e_epoch, e.usable AS e_usable, e.mid AS e_mid, x.ts_e - e.ts_us AS e_age FROM x
      ASOF LEFT JOIN eq s ON x.instrument_id = s.instrument_id AND x.ts_s >= s.ts_us
      ASOF LEFT JOIN eq e ON x.instrument_id = e.instrument_id AND x.ts_e >= e.ts_us),
    ends AS (SELECT instrument_id, epoch, max(ts_us) AS epoch_end FROM eq GROUP BY 1, 2),
    tails AS (SELECT instrument_id, max(ts_us) AS last_ts FROM eq GROUP BY 1),
    r AS (SELECT j.*, CASE WHEN coalesce(n.epoch_end, -1) < ts_e THEN CASE WHEN coalesce(t.last_ts, -1) >= ts_e THEN 'epoch_right_edge' ELSE 'right_edge_uncovered' END
      WHEN s_epoch IS NULL THEN 'start_no_prior_state' WHEN s_epoch <> j.epoch THEN 'start_epoch_mismatch' WHEN NOT s_usable THEN 'start_unusable_state' WHEN s_age > {DAY} THEN 'start_stale_state'
      WHEN e_epoch IS NULL THEN 'end_no_prior_state' WHEN e_epoch <> j.epoch THEN 'end_epoch_mismatch' WHEN NOT e_usable THEN 'end_unusable_state' WHEN e_age > {DAY} THEN 'end_stale_state' END AS reason
      FROM j LEFT JOIN ends n ON j.instrument_id = n.instrument_id AND j.epoch = n.epoch LEFT JOIN tails t ON j.instrument_id = t.instrument_id)
    SELECT instrument_id, seq, reason, CASE WHEN reason IS NULL THEN round((e_mid - s_mid) / 0.05, 4) END AS move_ticks FROM r""",
)
def guarded_move(spark, sf):
    rows = with_epoch(spark, sf)
    left = rows.where(F.col("channel") == "click").select("instrument_id", "seq", "ts_us", "epoch")
    quotes = epoch_quotes(rows).withColumn("at", F.col("ts_us"))
    found = asof_offsets(
        left, quotes, keys=KEYS, id_cols=["seq", "ts_us", "epoch"], left_ts="ts_us",
        offsets={"s": GAP, "e": GAP + SPAN, "f": GAP + SPAN}, forward=["f"], right_ts="ts_us",
        values=["epoch", "usable", "mid", "at"], slices=time_slices(spark, sf), right_ties=["seq"], covered=False,
    )
    # Epochs only grow, so this epoch reaches the end instant exactly when the first state at or
    # after that instant still belongs to it.
    start = refusal(F.col("epoch"), F.col("s_epoch"), F.col("s_usable"), F.col("ts_us") + GAP - F.col("s_at"), DAY)
    end = refusal(F.col("epoch"), F.col("e_epoch"), F.col("e_usable"), F.col("ts_us") + GAP + SPAN - F.col("e_at"), DAY)
    reason = (
        F.when(F.col("f_epoch").isNull(), "right_edge_uncovered")
        .when(F.col("f_epoch") != F.col("epoch"), "epoch_right_edge")
        .when(start.isNotNull(), F.concat(F.lit("start_"), start))
        .when(end.isNotNull(), F.concat(F.lit("end_"), end))
    )
    return found.withColumn("reason", reason).select(
        "instrument_id", "seq", "reason",
        F.when(F.col("reason").isNull(), F.round((F.col("e_mid") - F.col("s_mid")) / F.lit(TICK), 4)).alias("move_ticks"),
    )


@query(
    "response_ticks",
    f"""WITH {MIDS_SQL},
    look AS (SELECT a.*, s.t0, s.t1, n.mid AS now_mid, f.mid AS fut_mid, p.mid AS past_mid, b.mid AS before_mid, c.mid AS after_mid
      FROM (SELECT *, ts_us + {DAY} AS tf, ts_us - {DAY} AS tp FROM anchors) a
      ASOF LEFT JOIN path n ON a.instrument_id = n.instrument_id AND a.ts_us >= n.ts_us
      ASOF LEFT JOIN path f ON a.instrument_id = f.instrument_id AND a.tf >= f.ts_us
      ASOF LEFT JOIN path p ON a.instrument_id = p.instrument_id AND a.tp >= p.ts_us
      ASOF LEFT JOIN path b ON a.instrument_id = b.instrument_id AND a.ts_us > b.ts_us
      ASOF LEFT JOIN path c ON a.instrument_id = c.instrument_id AND a.ts_us <= c.ts_us
      LEFT JOIN span s ON a.instrument_id = s.instrument_id)
    SELECT instrument_id, seq, CASE WHEN ts_us BETWEEN t0 AND t1 AND tf <= t1 THEN round((fut_mid - now_mid) / 0.05, 4) END AS future_ticks,
      CASE WHEN ts_us BETWEEN t0 AND t1 AND tp >= t0 THEN round((now_mid - past_mid) / 0.05, 4) END AS past_ticks,
      CASE WHEN ts_us BETWEEN t0 AND t1 THEN round((after_mid - before_mid) / 0.05, 4) END AS straddle_ticks FROM look""",
)
def response_ticks(spark, sf):
    found = asof_offsets(
        anchors(spark, sf), mids(spark, sf).where(F.col("mid").isNotNull()),
        keys=KEYS, id_cols=["seq"], left_ts="ts_us",
        offsets={"now": 0, "fut": DAY, "past": -DAY, "before": 0, "after": 0},
        strict=["before"], forward=["after"], right_ts="ts_us", values=["mid"],
        slices=time_slices(spark, sf), right_ties=["seq"],
    )
    now = F.col("now_mid")
    tick = F.lit(TICK)
    return found.select(
        "instrument_id", "seq",
        F.round((F.col("fut_mid") - now) / tick, 4).alias("future_ticks"),
        F.round((now - F.col("past_mid")) / tick, 4).alias("past_ticks"),
        F.when(now.isNotNull(), F.round((F.col("after_mid") - F.col("before_mid")) / tick, 4)).alias("straddle_ticks"),
    )


@query(
    "frozen_response_geometry",
    f"""WITH {MIDS_SQL}, g AS (SELECT *, ts_us + {GAP} AS tz, ts_us + {GAP + DAY} AS te, ts_us - {GAP} AS mz, ts_us - {GAP + DAY} AS me FROM anchors),
    look AS (SELECT g.*, s.t0, s.t1, a.mid AS a_mid, b.mid AS b_mid, c.mid AS c_mid, d.mid AS d_mid FROM g
      ASOF LEFT JOIN path a ON g.instrument_id = a.instrument_id AND g.tz >= a.ts_us
      ASOF LEFT JOIN path b ON g.instrument_id = b.instrument_id AND g.te >= b.ts_us
      ASOF LEFT JOIN path c ON g.instrument_id = c.instrument_id AND g.mz >= c.ts_us
      ASOF LEFT JOIN path d ON g.instrument_id = d.instrument_id AND g.me >= d.ts_us
      LEFT JOIN span s ON g.instrument_id = s.instrument_id)
    SELECT instrument_id, seq, CASE WHEN tz BETWEEN t0 AND t1 AND te BETWEEN t0 AND t1 THEN round((b_mid - a_mid) / 0.05, 4) END AS future_ticks,
      CASE WHEN mz BETWEEN t0 AND t1 AND me BETWEEN t0 AND t1 THEN round((c_mid - d_mid) / 0.05, 4) END AS mirror_ticks FROM look""",
)
def frozen_response_geometry(spark, sf):
    found = asof_offsets(
        anchors(spark, sf), mids(spark, sf).where(F.col("mid").isNotNull()),
        keys=KEYS, id_cols=["seq"], left_ts="ts_us",
        offsets={"a": GAP, "b": GAP + DAY, "c": -GAP, "d": -GAP - DAY}, right_ts="ts_us", values=["mid"],
        slices=time_slices(spark, sf), right_ties=["seq"],
    )
    return found.select(
        "instrument_id", "seq",
        F.round((F.col("b_mid") - F.col("a_mid")) / F.lit(TICK), 4).alias("future_ticks"),
        F.round((F.col("c_mid") - F.col("d_mid")) / F.lit(TICK), 4).alias("mirror_ticks"),
    )


@query(
    "nearest_endpoint_within_tolerance",
    f"""WITH {MIDS_SQL}, pts AS (SELECT instrument_id, ts_us, count(*) AS n, max(mid) AS mid FROM path GROUP BY 1, 2),
    e AS (SELECT *, ts_us + {6 * HOUR} AS want FROM anchors),
    j AS (SELECT e.*, b.ts_us AS bt, b.mid AS bm, b.n AS bn, f.ts_us AS ft, f.mid AS fm, f.n AS fn FROM e
      ASOF LEFT JOIN pts b ON e.instrument_id = b.instrument_id AND e.want >= b.ts_us
      ASOF LEFT JOIN pts f ON e.instrument_id = f.instrument_id AND e.want < f.ts_us),
    d AS (SELECT *, CASE WHEN want - bt <= {3 * HOUR} THEN want - bt END AS db, CASE WHEN ft - want <= {3 * HOUR} THEN ft - want END AS df FROM j)
    SELECT instrument_id, seq, CASE WHEN db IS NOT NULL AND (df IS NULL OR db < df) AND bn = 1 THEN round(bm, 6)
      WHEN df IS NOT NULL AND (db IS NULL OR df < db) AND fn = 1 THEN round(fm, 6) END AS mid FROM d""",
)
def nearest_endpoint_within_tolerance(spark, sf):
    points = (
        mids(spark, sf).where(F.col("mid").isNotNull()).groupBy("instrument_id", "ts_us")
        .agg(F.count(F.lit(1)).alias("n"), F.max("mid").alias("mid")).withColumn("at", F.col("ts_us"))
    )
    want = 6 * HOUR
    found = asof_offsets(
        anchors(spark, sf), points, keys=KEYS, id_cols=["seq", "ts_us"], left_ts="ts_us",
        offsets={"b": want, "f": want + 1}, forward=["f"], right_ts="ts_us", values=["at", "mid", "n"],
        slices=time_slices(spark, sf), covered=False,
    )
    back, fore = F.col("ts_us") + want - F.col("b_at"), F.col("f_at") - F.col("ts_us") - want
    db, df = F.when(back <= 3 * HOUR, back), F.when(fore <= 3 * HOUR, fore)
    pick = F.when(db.isNotNull() & (df.isNull() | (db < df)) & (F.col("b_n") == 1), F.col("b_mid")).when(
        df.isNotNull() & (db.isNull() | (df < db)) & (F.col("f_n") == 1), F.col("f_mid")
    )
    return found.select("instrument_id", "seq", F.round(pick, 6).alias("mid"))


@query(
    "any_match_within",
    f"""WITH {MIDS_SQL}, w AS (SELECT instrument_id, seq, ts_us, 1000 + CAST(floor(value / 20) AS BIGINT) AS level FROM tape WHERE channel = 'click'),
    c AS (SELECT instrument_id, ts_us, 1000 + CAST(floor(value / 20) AS BIGINT) AS level FROM tape WHERE channel = 'view')
    SELECT instrument_id, seq, EXISTS (SELECT 1 FROM c WHERE c.instrument_id = w.instrument_id AND c.level = w.level
      AND c.ts_us BETWEEN w.ts_us - {6 * HOUR} AND w.ts_us + {6 * HOUR}) AS matched FROM w""",
)
def any_match_within(spark, sf):
    rows = tape(spark, sf).withColumn("level", 1000 + F.floor(F.col("value") / 20))
    witness = rows.where(F.col("channel") == "click").select("instrument_id", "seq", "ts_us", "level")
    other = rows.where(F.col("channel") == "view").select("instrument_id", "level", "ts_us", F.col("ts_us").alias("at"))
    # Matching content joins the key, so a match within the band is a nearest neighbour in time.
    found = asof_offsets(
        witness, other, keys=["instrument_id", "level"], id_cols=["seq", "ts_us"], left_ts="ts_us",
        offsets={"b": 0, "f": 0}, forward=["f"], right_ts="ts_us", values=["at"],
        slices=time_slices(spark, sf), covered=False,
    )
    near = (F.col("ts_us") - F.col("b_at") <= 6 * HOUR) | (F.col("f_at") - F.col("ts_us") <= 6 * HOUR)
    return found.select("instrument_id", "seq", F.coalesce(near, F.lit(False)).alias("matched"))


@query(
    "quiet_control_pool",
    f"""WITH {TAPE_SQL}, e AS (SELECT instrument_id, ts_us FROM tape WHERE channel = 'purchase'),
    c AS (SELECT instrument_id, seq, ts_us FROM tape WHERE channel = 'view')
    SELECT instrument_id, seq FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.instrument_id = c.instrument_id
      AND e.ts_us BETWEEN c.ts_us - {12 * HOUR} AND c.ts_us + {12 * HOUR})""",
)
def quiet_control_pool(spark, sf):
    rows = tape(spark, sf)
    controls = rows.where(F.col("channel") == "view").select("instrument_id", "seq", "ts_us")
    events = rows.where(F.col("channel") == "purchase").select("instrument_id", "ts_us", F.col("ts_us").alias("at"))
    found = asof_offsets(
        controls, events, keys=KEYS, id_cols=["seq", "ts_us"], left_ts="ts_us", offsets={"b": 0, "f": 0},
        forward=["f"], right_ts="ts_us", values=["at"], slices=time_slices(spark, sf), covered=False,
    )
    near = (F.col("ts_us") - F.col("b_at") <= 12 * HOUR) | (F.col("f_at") - F.col("ts_us") <= 12 * HOUR)
    return found.where(~F.coalesce(near, F.lit(False))).select("instrument_id", "seq")


@query(
    "skip_window_witnesses",
    f"""WITH {TAPE_SQL}, pub AS (SELECT instrument_id, ts_us AS open_ts, lead(ts_us) OVER (PARTITION BY instrument_id ORDER BY ts_us, seq) AS close_ts,
        CAST(floor(value / 20) AS BIGINT) AS lv, lead(CAST(floor(value / 20) AS BIGINT)) OVER (PARTITION BY instrument_id ORDER BY ts_us, seq) AS lv2 FROM tape WHERE channel = 'click'),
    w AS (SELECT instrument_id, seq, ts_us, CAST(floor(value / 20) AS BIGINT) AS lv FROM tape WHERE channel = 'view')
    SELECT CASE WHEN close_ts - open_ts > {2 * DAY} THEN 'skip' ELSE 'control' END AS arm, count(*) AS witnesses,
      count(CASE WHEN w.lv = pub.lv AND w.lv = lv2 THEN 1 END) AS matches_both, count(CASE WHEN w.lv = pub.lv AND w.lv <> lv2 THEN 1 END) AS matches_open_only,
      count(CASE WHEN w.lv <> pub.lv AND w.lv = lv2 THEN 1 END) AS matches_close_only, count(CASE WHEN w.lv <> pub.lv AND w.lv <> lv2 THEN 1 END) AS matches_neither
    FROM w JOIN pub ON w.instrument_id = pub.instrument_id AND w.ts_us > open_ts AND w.ts_us < close_ts GROUP BY 1""",
)
def skip_window_witnesses(spark, sf):
    rows = tape(spark, sf).withColumn("lv", F.floor(F.col("value") / 20))
    cuts = time_slices(spark, sf)
    windows = ordered_scan(
        rows.where(F.col("channel") == "click"), KEYS, ["ts_us", "seq"], cuts, {"close_ts": nxt("ts_us"), "lv2": nxt("lv")}
    )
    inside = asof(
        rows.where(F.col("channel") == "view"), windows, keys=KEYS, left_ts="ts_us", right_ts="ts_us",
        values=["ts_us", "close_ts", "lv", "lv2"], slices=cuts, right_ties=["seq"], strict=True,
    ).where(F.col("ts_us") < F.col("m_close_ts"))
    o, c = F.col("lv") == F.col("m_lv"), F.col("lv") == F.col("m_lv2")
    arm = F.when(F.col("m_close_ts") - F.col("m_ts_us") > 2 * DAY, "skip").otherwise("control")
    return inside.groupBy(arm.alias("arm")).agg(
        F.count(F.lit(1)).alias("witnesses"),
        F.count(F.when(o & c, 1)).alias("matches_both"),
        F.count(F.when(o & ~c, 1)).alias("matches_open_only"),
        F.count(F.when(~o & c, 1)).alias("matches_close_only"),
        F.count(F.when(~o & ~c, 1)).alias("matches_neither"),
    )


@query(
    "event_response_labels",
    f"""WITH {EPOCH_SQL}, grid AS (SELECT z, h FROM (VALUES ({HOUR}), ({4 * HOUR})) a(z), (VALUES ({6 * HOUR}), ({DAY})) b(h)),
    ev AS (SELECT e.instrument_id, e.seq, e.ts_us, e.epoch, z, h, e.ts_us + z AS tz, e.ts_us + z + h AS te FROM ep e, grid WHERE channel = 'purchase'),
    g AS (SELECT * FROM eq WHERE usable),
    j AS (SELECT ev.*, p.mid AS pre, a.mid AS base, a.epoch AS ae, b.mid AS fin, b.epoch AS be, t.last_ts FROM ev
      ASOF LEFT JOIN g p ON ev.instrument_id = p.instrument_id AND ev.ts_us > p.ts_us
      ASOF LEFT JOIN g a ON ev.instrument_id = a.instrument_id AND ev.tz >= a.ts_us
      ASOF LEFT JOIN g b ON ev.instrument_id = b.instrument_id AND ev.te >= b.ts_us
      LEFT JOIN (SELECT instrument_id, max(ts_us) AS last_ts FROM g GROUP BY 1) t ON ev.instrument_id = t.instrument_id),
    r AS (SELECT *, CASE WHEN pre IS NULL THEN 'no_pre_event_state' WHEN coalesce(last_ts, -1) < te THEN 'right_edge_uncovered'
      WHEN ae <> epoch OR be <> epoch THEN 'epoch_boundary' END AS reason FROM j)
    SELECT instrument_id, seq, z AS gap_us, h AS horizon_us, reason, CASE WHEN reason IS NULL THEN round((fin - base) / 0.05, 4) END AS response_ticks,
      CASE WHEN reason IS NULL THEN round((base - pre) / 0.05, 4) END AS gap_ticks FROM r""",
)
def event_response_labels(spark, sf):
    rows = with_epoch(spark, sf)
    quotes = epoch_quotes(rows).where("usable").withColumn("at", F.col("ts_us"))
    grid = [(z, h) for z in (HOUR, 4 * HOUR) for h in (6 * HOUR, DAY)]
    events = rows.where(F.col("channel") == "purchase").select("instrument_id", "seq", "ts_us", "epoch")
    offsets = {"pre": 0}
    for z in sorted({z for z, _ in grid}):
        offsets[f"z{z}"] = z
    for z, h in grid:
        offsets[f"e{z}_{h}"] = z + h
        offsets[f"c{z}_{h}"] = z + h
    found = asof_offsets(
        events, quotes, keys=KEYS, id_cols=["seq", "ts_us", "epoch"], left_ts="ts_us", offsets=offsets,
        strict=["pre"], forward=[n for n in offsets if n.startswith("c")], right_ts="ts_us",
        values=["mid", "epoch"], slices=time_slices(spark, sf), right_ties=["seq"], covered=False,
    )
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(z).alias("gap_us"), F.lit(h).alias("horizon_us"),
                    F.col(f"z{z}_mid").alias("base"), F.col(f"z{z}_epoch").alias("ae"),
                    F.col(f"e{z}_{h}_mid").alias("fin"), F.col(f"e{z}_{h}_epoch").alias("be"),
                    F.col(f"c{z}_{h}_mid").isNotNull().alias("covered"),
                )
                for z, h in grid
            ]
        )
    )
    reason = (
        F.when(F.col("pre_mid").isNull(), "no_pre_event_state")
        .when(~F.col("c.covered"), "right_edge_uncovered")
        .when((F.col("c.ae") != F.col("epoch")) | (F.col("c.be") != F.col("epoch")), "epoch_boundary")
    )
    flat = found.withColumn("c", cells).withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return flat.select(
        "instrument_id", "seq", "c.gap_us", "c.horizon_us", "reason",
        F.when(ok, F.round((F.col("c.fin") - F.col("c.base")) / F.lit(TICK), 4)).alias("response_ticks"),
        F.when(ok, F.round((F.col("c.base") - F.col("pre_mid")) / F.lit(TICK), 4)).alias("gap_ticks"),
    )


@query(
    "lagged_placebo_source",
    f"""WITH {EPOCH_SQL}, x AS (SELECT *, ts_us - {6 * HOUR} AS want FROM ea)
    SELECT x.instrument_id, x.seq, CASE WHEN q.epoch = x.epoch THEN q.seq END AS source_seq FROM x
    ASOF LEFT JOIN eq q ON x.instrument_id = q.instrument_id AND x.epoch = q.epoch AND x.want >= q.ts_us""",
)
def lagged_placebo_source(spark, sf):
    rows = with_epoch(spark, sf)
    left = rows.where(F.col("channel") == "click").select("instrument_id", "seq", "ts_us", "epoch").withColumn(
        "want", F.col("ts_us") - 6 * HOUR
    )
    out = asof(
        left, epoch_quotes(rows), keys=["instrument_id", "epoch"], left_ts="want", right_ts="ts_us",
        values=["seq"], slices=time_slices(spark, sf), right_ties=["seq"],
    )
    return out.select("instrument_id", "seq", F.col("m_seq").alias("source_seq"))


@query(
    "same_side_print_return",
    f"""WITH {CLASSIFIED_SQL}, s AS (SELECT instrument_id, side, seq, ts_us, price FROM classified WHERE side IN ('buy', 'sell')),
    a AS (SELECT an.instrument_id, an.seq, an.ts_us, an.ts_us + {DAY} AS te, p.side FROM (SELECT instrument_id, seq, ts_us FROM tape WHERE channel = 'click') an
      ASOF JOIN s p ON an.instrument_id = p.instrument_id AND an.ts_us >= p.ts_us),
    j AS (SELECT a.*, b.price AS p0, b.seq AS s0, e.price AS p1, e.seq AS s1 FROM a
      ASOF JOIN s b ON a.instrument_id = b.instrument_id AND a.side = b.side AND a.ts_us >= b.ts_us
      ASOF JOIN s e ON a.instrument_id = e.instrument_id AND a.side = e.side AND a.te >= e.ts_us)
    SELECT instrument_id, seq, side, CASE WHEN s1 <> s0 THEN round((p1 - p0) / 0.05, 4) END AS return_ticks FROM j""",
)
def same_side_print_return(spark, sf):
    cuts = time_slices(spark, sf)
    signed = cut_lineage(
        classified(spark, sf)
        .where(F.col("side").isin("buy", "sell"))
        .select("instrument_id", "side", "seq", "ts_us", "price")
    )
    started = asof(
        anchors(spark, sf), signed, keys=KEYS, left_ts="ts_us", right_ts="ts_us", values=["side"],
        slices=cuts, right_ties=["seq"], prefix="",
    ).where(F.col("side").isNotNull())
    found = asof_offsets(
        started, signed.withColumn("pseq", F.col("seq")), keys=["instrument_id", "side"], id_cols=["seq"], left_ts="ts_us",
        offsets={"a": 0, "b": DAY}, right_ts="ts_us", values=["price", "pseq"], slices=cuts, right_ties=["seq"], covered=False,
    )
    moved = F.col("b_pseq") != F.col("a_pseq")
    return found.select(
        "instrument_id", "seq", "side",
        F.when(moved, F.round((F.col("b_price") - F.col("a_price")) / F.lit(TICK), 4)).alias("return_ticks"),
    )


_GRID_SQL = f"""{TAPE_SQL}, h AS (SELECT instrument_id, ts_us // {6 * HOUR} AS slot, arg_max(value, (ts_us, seq)) AS v FROM tape GROUP BY 1, 2)"""


@query(
    "exact_offset_moves",
    f"""WITH {_GRID_SQL} SELECT a.instrument_id, a.slot, round(a.v - p.v, 6) AS prior_move, round(f.v - a.v, 6) AS future_move FROM h a
    LEFT JOIN h p ON a.instrument_id = p.instrument_id AND p.slot = a.slot - 1
    LEFT JOIN h f ON a.instrument_id = f.instrument_id AND f.slot = a.slot + 2""",
)
def exact_offset_moves(spark, sf):
    grid = tape(spark, sf).groupBy("instrument_id", F.expr(f"ts_us div {6 * HOUR}").alias("slot")).agg(
        F.max_by("value", F.struct("ts_us", "seq")).alias("v")
    )
    past = grid.select("instrument_id", (F.col("slot") + 1).alias("slot"), F.col("v").alias("pv"))
    future = grid.select("instrument_id", (F.col("slot") - 2).alias("slot"), F.col("v").alias("fv"))
    return grid.join(past, ["instrument_id", "slot"], "left").join(future, ["instrument_id", "slot"], "left").select(
        "instrument_id", "slot",
        F.round(F.col("v") - F.col("pv"), 6).alias("prior_move"),
        F.round(F.col("fv") - F.col("v"), 6).alias("future_move"),
    )


@query(
    "instrument_lookup",
    """WITH m AS (SELECT s_nationkey AS key, count(*) AS n, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1)
    SELECT c_custkey, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS lookup,
      CASE WHEN n = 1 THEN s_suppkey END AS s_suppkey FROM customer LEFT JOIN m ON c_nationkey = key""",
)
def instrument_lookup(spark, sf):
    from ..sources.masters import lookup_unique

    master = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("key"), "s_suppkey")
    asked = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("key"))
    return lookup_unique(asked, master, "key").drop("key")


@query(
    "feature_target_join",
    """SELECT o_orderkey AS observation_id, round(o_totalprice, 4) AS feature, round(sum(l_extendedprice), 2) AS target, count(*) AS legs
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""",
)
def feature_target_join(spark, sf):
    # Aggregate the many side first: one row per id crosses the join.
    target = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("observation_id")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("target"), F.count(F.lit(1)).alias("legs")
    )
    features = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("observation_id"), F.round("o_totalprice", 4).alias("feature")
    )
    return features.join(target, "observation_id")


@query(
    "one_to_one_merge_check",
    """WITH l AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT c_custkey AS key, count(*) AS n FROM customer GROUP BY 1)
    SELECT CASE WHEN l.key IS NULL THEN 'right_only' WHEN r.key IS NULL THEN 'left_only' WHEN l.n > 1 OR r.n > 1 THEN 'not_one_to_one' ELSE 'one_to_one' END AS status,
      count(*) AS keys FROM l FULL JOIN r ON l.key = r.key GROUP BY 1""",
)
def one_to_one_merge_check(spark, sf):
    left = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("l_n"))
    right = table(spark, sf, "customer").groupBy(F.col("c_custkey").alias("key")).agg(F.count(F.lit(1)).alias("r_n"))
    status = (
        F.when(F.col("l_n").isNull(), "right_only")
        .when(F.col("r_n").isNull(), "left_only")
        .when((F.col("l_n") > 1) | (F.col("r_n") > 1), "not_one_to_one")
        .otherwise("one_to_one")
    )
    return left.join(right, "key", "full").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("keys"))


@query(
    "next_expiry_on_or_after",
    """WITH cal AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS expiry FROM orders WHERE dayofweek(CAST(o_orderdate AS DATE)) = 4),
    d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)
    SELECT date, expiry, CAST(date_diff('day', date, expiry) AS INTEGER) AS days FROM d ASOF LEFT JOIN cal ON d.date <= cal.expiry""",
)
def next_expiry_on_or_after(spark, sf):
    orders = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("expiry")).distinct()
    calendar = orders.where(F.dayofweek("expiry") == 5)
    dates = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()

    def days(c):
        return F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("long")

    from ..operators.slices import Slices

    dates = dates.withColumn("d", days("date")).withColumn("k", F.lit(0))
    calendar = calendar.withColumn("d", days("expiry")).withColumn("k", F.lit(0))
    cuts = slices_for(spark, sf, "lineitem.shipday", dates, "d")
    assert isinstance(cuts, Slices)
    out = asof(
        dates, calendar, keys=["k"], left_ts="d", right_ts="d", values=["expiry"], slices=cuts,
        direction="forward", prefix="",
    )
    return out.select("date", "expiry", F.datediff("expiry", "date").alias("days"))


@query(
    "keyed_reconciliation",
    """WITH a AS (SELECT c_custkey AS key, c_nationkey AS v FROM customer WHERE c_custkey % 7 <> 0),
    b AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS v FROM customer WHERE c_custkey % 11 <> 0)
    SELECT CASE WHEN a.key IS NULL THEN 'extra' WHEN b.key IS NULL THEN 'missing' WHEN a.v <> b.v THEN 'changed' ELSE 'equal' END AS status, count(*) AS rows
    FROM a FULL JOIN b ON a.key = b.key GROUP BY 1""",
)
def keyed_reconciliation(spark, sf):
    from ..operators.orders import reconcile

    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("v"))
    left = c.where(F.col("key") % 7 != 0)
    right = c.where(F.col("key") % 11 != 0).withColumn("v", F.when(F.col("key") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return reconcile(left, right, ["key"], ["v"]).groupBy("status").agg(F.count(F.lit(1)).alias("rows"))
