"""Study-level compositions: carry joins, eligibility, coverage gates, reference prices, activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import book as B
from ..functions.real import ln_ratio, rounded
from ..operators.asof import asof
from ..operators.orders import first_failing
from ..operators.slices import ordered_scan, prev, row_no, sliding
from .asof_queries import CLASSIFIED_SQL, EPOCH_SQL, epoch_quotes, refusal, stored_prints, with_epoch
from .bindings import DAY, HOUR, KEYS, TAPE_SQL, books, slices_for, tape, time_slices
from .registry import query


@query(
    "surface_carry_refusals",
    f"""WITH {EPOCH_SQL}, j AS (SELECT a.instrument_id, a.seq, a.epoch, q.epoch AS qe, a.ts_us - q.ts_us AS age FROM ea a ASOF LEFT JOIN eq q ON a.instrument_id = q.instrument_id AND a.ts_us >= q.ts_us)
    SELECT CASE WHEN qe IS NULL THEN 'no_prior_state' WHEN qe <> epoch THEN 'epoch_mismatch' WHEN age > {DAY} THEN 'stale_state' ELSE 'joined' END AS outcome, count(*) AS anchors, max(CASE WHEN qe = epoch AND age <= {DAY} THEN age END) AS oldest_carry_us FROM j GROUP BY 1""",
)
def surface_carry_refusals(spark, sf):
    rows = with_epoch(spark, sf)
    left = rows.where(F.col("channel") == "click").select("instrument_id", "seq", "ts_us", "epoch")
    out = asof(
        left, epoch_quotes(rows), keys=KEYS, left_ts="ts_us", right_ts="ts_us", values=["epoch", "ts_us"],
        slices=time_slices(spark, sf), right_ties=["seq"],
    )
    age = F.col("ts_us") - F.col("m_ts_us")
    why = refusal(F.col("epoch"), F.col("m_epoch"), F.lit(True), age, DAY)
    return out.groupBy(F.coalesce(why, F.lit("joined")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("anchors"), F.max(F.when(why.isNull(), age)).alias("oldest_carry_us")
    )


@query(
    "hypothesis_row_eligibility",
    f"""WITH {TAPE_SQL}, s AS (SELECT *, ts_us // {DAY} AS day FROM tape), d AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS back FROM (SELECT DISTINCT day FROM s)),
    r AS (SELECT CASE WHEN back > 20 THEN 'outside_fitting_window' WHEN seq % 17 = 0 THEN 'missing_target' WHEN value > 150 THEN 'predictor_out_of_range' WHEN instrument_id % 3 = 0 THEN 'regime_excluded' ELSE 'eligible' END AS reason FROM s JOIN d ON s.day = d.day)
    SELECT reason, count(*) AS rows FROM r GROUP BY 1""",
)
def hypothesis_row_eligibility(spark, sf):
    rows = tape(spark, sf).withColumn("day", F.expr(f"ts_us div {DAY}"))
    days = rows.select("day").distinct().withColumn("k", F.lit(0)).withColumn("rev", -F.col("day"))
    back = ordered_scan(days, ["k"], ["rev"], slices_for(spark, sf, "study.rev", days, "rev"), {"back": row_no()}).select("day", "back")
    reason = first_failing(
        [
            ("outside_fitting_window", F.col("back") > 20),
            ("missing_target", F.col("seq") % 17 == 0),
            ("predictor_out_of_range", F.col("value") > 150),
            ("regime_excluded", F.col("instrument_id") % 3 == 0),
        ]
    )
    return rows.join(back, "day").groupBy(F.coalesce(reason, F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "coverage_gate",
    f"""WITH {TAPE_SQL}, c AS (SELECT channel, count(DISTINCT instrument_id) AS seen, (SELECT count(DISTINCT instrument_id) FROM tape) AS asked, max(ts_us) - min(ts_us) AS span FROM tape GROUP BY 1)
    SELECT channel, seen, round(seen / CAST(asked AS DOUBLE), 6) AS covered_fraction, CASE WHEN channel = 'error' THEN 'stream_error' WHEN seen / CAST(asked AS DOUBLE) < 0.95 THEN 'instrument_coverage' WHEN span < {20 * DAY} THEN 'coverage_seconds' END AS reason FROM c""",
)
def coverage_gate(spark, sf):
    rows = tape(spark, sf)
    asked = rows.agg(F.count_distinct("instrument_id").alias("asked"))
    c = rows.groupBy("channel").agg(F.count_distinct("instrument_id").alias("seen"), (F.max("ts_us") - F.min("ts_us")).alias("span")).crossJoin(F.broadcast(asked))
    share = F.col("seen") / F.col("asked")
    reason = first_failing(
        [("stream_error", F.col("channel") == "error"), ("instrument_coverage", share < 0.95), ("coverage_seconds", F.col("span") < 20 * DAY)]
    )
    return c.select("channel", "seen", F.round(share, 6).alias("covered_fraction"), reason.alias("reason"))


@query(
    "reference_price_coverage",
    f"""WITH {CLASSIFIED_SQL}, b AS (SELECT instrument_id, ts_us, bids[1].price AS bp, asks[1].price AS ap, bids[1].quantity AS bq, asks[1].quantity AS aq FROM books WHERE channel = 'view'),
    p AS (SELECT 'displayed_mid' AS reference, instrument_id, ts_us, (bp + ap) / 2 AS price FROM b WHERE bp < ap UNION ALL SELECT 'microprice', instrument_id, ts_us, (aq * bp + bq * ap) / (bq + aq) FROM b WHERE bp < ap UNION ALL SELECT 'last_trade', instrument_id, ts_us, price FROM classified)
    SELECT reference, count(*) AS points, count(DISTINCT instrument_id) AS instruments, min(ts_us) AS coverage_start, max(ts_us) AS coverage_end, round(avg(price), 6) AS mean_price FROM p GROUP BY 1""",
)
def reference_price_coverage(spark, sf):
    b = books(spark, sf).where(F.col("channel") == "view")
    bp, ap = B.best("bids"), B.best("asks")
    micro = B.simple_microprice(bp, B.best("bids", "quantity"), ap, B.best("asks", "quantity"))
    from_book = b.where(bp < ap).select(
        "instrument_id", "ts_us",
        F.inline(
            F.array(
                F.struct(F.lit("displayed_mid").alias("reference"), ((bp + ap) / 2).alias("price")),
                F.struct(F.lit("microprice").alias("reference"), micro.alias("price")),
            )
        ),
    )
    prints = stored_prints(spark, sf).select("instrument_id", "ts_us", F.lit("last_trade").alias("reference"), "price")
    return from_book.unionByName(prints).groupBy("reference").agg(
        F.count(F.lit(1)).alias("points"), F.count_distinct("instrument_id").alias("instruments"), F.min("ts_us").alias("coverage_start"),
        F.max("ts_us").alias("coverage_end"), F.round(F.avg("price"), 6).alias("mean_price"),
    )


@query(
    "rolling_activity_windows",
    f"""WITH {TAPE_SQL}, r AS (SELECT *, CASE WHEN lag(value) OVER w > 0 THEN ln(value / lag(value) OVER w) END AS r FROM tape WINDOW w AS (PARTITION BY instrument_id ORDER BY ts_us, seq))
    SELECT instrument_id, seq, round(sqrt(sum(r * r) OVER a), 6) AS realized_volatility, CAST(sum(1 + seq % 50) OVER b AS BIGINT) AS trade_volume FROM r
    WINDOW a AS (PARTITION BY instrument_id ORDER BY ts_us RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW), b AS (PARTITION BY instrument_id ORDER BY ts_us RANGE BETWEEN {12 * HOUR} PRECEDING AND CURRENT ROW)""",
)
def rolling_activity_windows(spark, sf):
    cuts = time_slices(spark, sf)
    stepped = ordered_scan(tape(spark, sf), KEYS, ["ts_us", "seq"], cuts, {"p": prev("value")})
    rows = stepped.withColumn("r", F.when(F.col("p") > 0, ln_ratio("value", "p"))).withColumn("qty", 1 + F.col("seq") % 50)
    out = sliding(
        rows, KEYS, "ts_us", cuts,
        {
            "rv": lambda f: F.sqrt(F.sum(F.col("r") * F.col("r")).over(f(-3 * DAY, 0))),
            "trade_volume": lambda f: F.sum("qty").over(f(-12 * HOUR, 0)),
        },
        back=3 * DAY,
    )
    return out.select("instrument_id", "seq", rounded("rv", 6).alias("realized_volatility"), "trade_volume")


@query(
    "complete_quote_sequence",
    f"""WITH {CLASSIFIED_SQL} SELECT instrument_id, channel, count(CASE WHEN complete THEN 1 END) AS complete_quotes, count(CASE WHEN NOT complete THEN 1 END) AS clears FROM marks GROUP BY 1, 2""",
)
def complete_quote_sequence(spark, sf):
    from ..operators.trades import complete_quotes
    from .asof_queries import depth_rows

    q = complete_quotes(depth_rows(spark, sf), KEYS, time_slices(spark, sf))
    return q.groupBy("instrument_id", "channel").agg(
        F.count(F.when(F.col("quote").isNotNull(), 1)).alias("complete_quotes"), F.count(F.when(F.col("quote").isNull(), 1)).alias("clears")
    )
