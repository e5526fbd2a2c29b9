"""Horse-race observations: all predictors and responses at one anchor clock, under four reference prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import book as B
from ..operators.asof import asof_offsets
from ..operators.orders import first_failing
from . import book_queries as Q
from .asof_queries import stored_prints
from .bindings import DAY, HOUR, KEYS, books, tape, time_slices
from .registry import ORACLES, query

REFERENCES = ("displayed_mid", "microprice", "last_trade", "effective_touch")
HORIZONS = {"h1": 6 * HOUR, "h2": DAY}


def reference_paths(spark, sf):
    """(instrument_id, reference, ts_us, price): the four price paths a response can be measured on."""
    b = books(spark, sf).where(F.col("channel") == "view")
    bp, ap = B.best("bids"), B.best("asks")
    micro = B.simple_microprice(bp, B.best("bids", "quantity"), ap, B.best("asks", "quantity"))
    pair = F.array(F.struct(F.lit("displayed_mid").alias("reference"), ((bp + ap) / 2).alias("price")), F.struct(F.lit("microprice").alias("reference"), micro.alias("price")))
    book = b.where(bp < ap).select("instrument_id", "ts_us", "seq", F.inline(pair))
    prints = stored_prints(spark, sf).select("instrument_id", "ts_us", "seq", F.lit("last_trade").alias("reference"), "price")
    touch = Q.touches(spark, sf).where("mid IS NOT NULL").select("instrument_id", "ts_us", "seq", F.lit("effective_touch").alias("reference"), F.col("mid").alias("price"))
    return book.unionByName(prints).unionByName(touch)


_RETURNS = [f"{r}_{h}" for r in REFERENCES for h in HORIZONS]
_CELLS = ", ".join(f"max(CASE WHEN reference = '{r}' THEN v_{h} - v_0 END) AS {r}_{h}" for r in REFERENCES for h in HORIZONS)
_LOOKUPS = ", ".join(f"max(CASE WHEN shift = {s} AND ta <= til THEN price END) AS v_{n}" for n, s in {"0": 0, **HORIZONS}.items())


def _sql() -> str:
    return f"""WITH {Q.TOUCH_SQL}, b AS (SELECT instrument_id, ts_us, bids[1].price AS bp, asks[1].price AS ap, bids[1].quantity AS bq, asks[1].quantity AS aq FROM books WHERE channel = 'view'),
    p AS MATERIALIZED (SELECT 'displayed_mid' AS reference, instrument_id, ts_us, (bp + ap) / 2 AS price FROM b WHERE bp < ap UNION ALL SELECT 'microprice', instrument_id, ts_us, (aq * bp + bq * ap) / (bq + aq) FROM b WHERE bp < ap
     UNION ALL SELECT 'last_trade', instrument_id, ts_us, price FROM classified UNION ALL SELECT 'effective_touch', instrument_id, ts_us, (effective_bid + effective_ask) / 2 FROM touch WHERE effective_bid < effective_ask),
    e AS (SELECT reference, instrument_id, max(ts_us) AS til FROM p GROUP BY 1, 2), q AS (SELECT an.instrument_id, an.seq, reference, shift, an.ts_us + shift AS ta FROM an, (VALUES {", ".join(f"('{r}')" for r in REFERENCES)}) r(reference), (VALUES (0), {", ".join(f"({s})" for s in HORIZONS.values())}) s(shift)),
    f AS (SELECT q.*, p.price, til FROM q ASOF JOIN p ON p.instrument_id = q.instrument_id AND p.reference = q.reference AND q.ta >= p.ts_us JOIN e ON e.instrument_id = q.instrument_id AND e.reference = q.reference),
    v AS (SELECT seq, reference, {_LOOKUPS} FROM f GROUP BY 1, 2), w AS (SELECT seq, {_CELLS}, max(CASE WHEN reference = 'displayed_mid' THEN v_0 END) AS d0, max(CASE WHEN reference = 'displayed_mid' THEN v_h2 END) AS d2 FROM v GROUP BY 1)
    SELECT an.instrument_id, an.seq, k.pressure AS cks_pressure, m.simple_average AS ccz_average, m.best_level AS ccz_best, s.signed_volume, s.absolute_volume, CASE WHEN effective_bid < effective_ask THEN round((effective_bid + effective_ask) / 2, 6) END AS effective_mid, {", ".join(f"round({c}, 6) AS {c}" for c in _RETURNS)},
     CASE WHEN k.pressure IS NULL OR m.simple_average IS NULL THEN 'incomplete_history' WHEN d0 IS NULL THEN 'no_response_anchor' WHEN d2 IS NULL THEN 'no_future_coverage' END AS reason
    FROM an LEFT JOIN touch t ON t.seq = an.seq LEFT JOIN ({ORACLES["windowed_level_one_pressure"]}) k ON k.seq = an.seq LEFT JOIN ({ORACLES["multi_level_flow_ranked"]}) m ON m.seq = an.seq LEFT JOIN ({ORACLES["signed_volume_window"]}) s ON s.seq = an.seq LEFT JOIN w ON w.seq = an.seq"""


@query("horse_race_observations", _sql())
def horse_race_observations(spark, sf):
    """Every anchor with its level-one pressure, ranked multi-level flow, signed volume and effective touch, the moves
    of each reference price over both horizons, and the first reason that keeps it out of a study."""
    anchors = tape(spark, sf).where(F.col("channel") == "click").select("instrument_id", "seq", "ts_us")
    asked = anchors.withColumn("reference", F.explode(F.array(*map(F.lit, REFERENCES))))
    paths = reference_paths(spark, sf).select("instrument_id", "reference", F.col("ts_us").alias("pts"), F.col("seq").alias("pseq"), "price")
    found = asof_offsets(
        asked, paths, keys=["instrument_id", "reference"], id_cols=["seq"], left_ts="ts_us", offsets={"o": 0, **HORIZONS}, right_ts="pts", values=["price"],
        slices=time_slices(spark, sf), right_ties=["pseq"],
    )
    moves = [F.max(F.when(F.col("reference") == r, F.col(f"{h}_price") - F.col("o_price"))).alias(f"{r}_{h}") for r in REFERENCES for h in HORIZONS]
    shown = F.col("reference") == "displayed_mid"
    wide = found.groupBy("seq").agg(*moves, F.max(F.when(shown, F.col("o_price"))).alias("__d0"), F.max(F.when(shown, F.col("h2_price"))).alias("__d2"))
    pressure = Q.windowed_level_one_pressure(spark, sf).select("seq", F.col("pressure").alias("cks_pressure"))
    flow = Q.multi_level_flow_ranked(spark, sf).select("seq", F.col("simple_average").alias("ccz_average"), F.col("best_level").alias("ccz_best"))
    volume = Q.signed_volume_window(spark, sf).select("seq", "signed_volume", "absolute_volume")
    touch = Q.touches(spark, sf).select("seq", F.round("mid", 6).alias("effective_mid"))
    out = anchors
    for part in (pressure, flow, volume, touch, wide):
        out = out.join(part, "seq", "left")
    reason = first_failing(
        [("incomplete_history", F.col("cks_pressure").isNull() | F.col("ccz_average").isNull()), ("no_response_anchor", F.col("__d0").isNull()), ("no_future_coverage", F.col("__d2").isNull())]
    )
    return out.select("instrument_id", "seq", "cks_pressure", "ccz_average", "ccz_best", "signed_volume", "absolute_volume", "effective_mid", *[F.round(c, 6).alias(c) for c in _RETURNS], reason.alias("reason"))
