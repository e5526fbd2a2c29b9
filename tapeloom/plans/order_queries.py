"""Order-event analytics bound to orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import orders as O
from ..operators.slices import Slices, ordered_scan, prev, run_sum, sliding
from .bindings import slices_for, table
from .registry import query

DAY_S = 86_400
ORDER_BY = ["t", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
LINES_SQL = """lines AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, CAST(epoch(l_shipdate) AS BIGINT) AS t, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side FROM lineitem)"""


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("t"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
    )


def ship_slices(spark, sf) -> Slices:
    return slices_for(spark, sf, "lineitem.t", lines(spark, sf), "t")


@query(
    "positions_from_fills",
    f"""WITH {LINES_SQL}, c AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER_BY)} ROWS UNBOUNDED PRECEDING) AS cumulative FROM lines), f AS (SELECT *, cumulative - coalesce(lag(cumulative) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER_BY)}), 0) AS fill FROM c)
    SELECT l_suppkey, count(*) AS fills, sum(fill) AS filled, sum(CASE WHEN side = 'buy' THEN fill ELSE -fill END) AS position FROM f GROUP BY 1""",
)
def positions_from_fills(spark, sf):
    cuts = ship_slices(spark, sf)
    cumulative = ordered_scan(lines(spark, sf), ["l_orderkey"], ORDER_BY, cuts, {"cumulative": run_sum("l_quantity")})
    stepped = ordered_scan(cumulative, ["l_orderkey"], ORDER_BY, cuts, {"before": prev("cumulative")})
    fill = F.col("cumulative") - F.coalesce(F.col("before"), F.lit(0.0))
    return stepped.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("fills"), F.sum(fill).alias("filled"),
        F.sum(F.when(F.col("side") == "buy", fill).otherwise(-fill)).alias("position"),
    )


@query(
    "running_position_path",
    f"""WITH {LINES_SQL} SELECT l_suppkey, t, max(p) AS highest, min(p) AS lowest FROM (SELECT l_suppkey, t, sum(CASE WHEN side = 'buy' THEN l_quantity ELSE -l_quantity END) OVER (PARTITION BY l_suppkey ORDER BY {', '.join(ORDER_BY)}, l_orderkey ROWS UNBOUNDED PRECEDING) AS p FROM lines) GROUP BY 1, 2""",
)
def running_position_path(spark, sf):
    signed = F.when(F.col("side") == "buy", F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    out = ordered_scan(lines(spark, sf), ["l_suppkey"], [*ORDER_BY, "l_orderkey"], ship_slices(spark, sf), {"p": run_sum(signed)})
    return out.groupBy("l_suppkey", "t").agg(F.max("p").alias("highest"), F.min("p").alias("lowest"))


EVENTS = (
    "FillUpdate", "CancelRequested", "CancelAccepted", "ModifyRequested", "ModifyAccepted", "BrokerRejected", "ReconcileWorking",
    "CancelRejected", "ModifyRejected", "SubmissionAmbiguous", "ReconcileCancelled",
)
EVENTS_SQL = f"""ev AS (SELECT o_custkey AS intent, CAST(epoch(o_orderdate) AS BIGINT) * 1000000 + o_orderkey AS sequence, CASE o_orderstatus WHEN 'O' THEN 'acknowledged' WHEN 'F' THEN 'filled' ELSE 'ambiguous_submission' END AS state,
  [{", ".join(f"'{e}'" for e in EVENTS)}][1 + o_orderkey % {len(EVENTS)}] AS event FROM orders)"""


def order_events(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("intent"),
        (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1_000_000 + F.col("o_orderkey")).alias("sequence"),
        F.when(F.col("o_orderstatus") == "O", "acknowledged").when(F.col("o_orderstatus") == "F", "filled").otherwise("ambiguous_submission").alias("state"),
        F.get(F.array(*map(F.lit, EVENTS)), (F.col("o_orderkey") % len(EVENTS)).cast("int")).alias("event"),
    )


@query(
    "latest_disposition",
    f"WITH {EVENTS_SQL} SELECT intent, count(*) AS events, arg_max(state, sequence) AS state, arg_max(state, sequence) IN ('ambiguous_submission', 'reconciliation_required') AS needs_reconciliation FROM ev GROUP BY 1",
)
def latest_disposition(spark, sf):
    return O.latest_disposition(order_events(spark, sf), "intent", "sequence")


@query(
    "illegal_transitions",
    f"""WITH {EVENTS_SQL}, m AS (SELECT *, CASE WHEN event = 'ModifyRequested' THEN 'modify' WHEN event = 'CancelRequested' THEN 'cancel'
      WHEN event IN ('ModifyAccepted', 'ModifyRejected', 'CancelAccepted', 'CancelRejected') OR event LIKE 'Reconcile%' OR (event = 'FillUpdate' AND state = 'filled') THEN 'none' END AS mark FROM ev),
    w AS (SELECT *, lag(state) OVER o AS before, coalesce(last_value(mark IGNORE NULLS) OVER past, 'none') AS pending, coalesce(bool_or(event = 'CancelRequested') OVER past, false) AS asked FROM m
      WINDOW o AS (PARTITION BY intent ORDER BY sequence), past AS (PARTITION BY intent ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT before, pending, event, count(*) AS events FROM w WHERE before IS NOT NULL AND NOT CASE event
      WHEN 'FillUpdate' THEN before IN ('acknowledged', 'partially_filled', 'filled')
      WHEN 'CancelRequested' THEN before IN ('acknowledged', 'partially_filled') AND pending = 'none'
      WHEN 'ModifyRequested' THEN before IN ('acknowledged', 'partially_filled') AND pending = 'none'
      WHEN 'ModifyAccepted' THEN pending = 'modify' WHEN 'ModifyRejected' THEN pending = 'modify' WHEN 'CancelRejected' THEN pending = 'cancel'
      WHEN 'CancelAccepted' THEN CASE WHEN before IN ('filled', 'cancelled') THEN asked ELSE pending = 'cancel' END
      WHEN 'BrokerRejected' THEN before IN ('prepared', 'submission_started', 'rejected')
      WHEN 'SubmissionAmbiguous' THEN before = 'submission_started' OR pending <> 'none'
      WHEN 'ReconcileWorking' THEN before IN ('ambiguous_submission', 'reconciliation_required')
      WHEN 'ReconcileCancelled' THEN before IN ('ambiguous_submission', 'reconciliation_required', 'cancelled') END GROUP BY ALL""",
)
def illegal_transitions(spark, sf):
    ev = order_events(spark, sf)
    cuts = slices_for(spark, sf, "orders.sequence", ev, "sequence")
    bad = O.illegal_transitions(ev, "intent", "sequence", "state", "event", cuts)
    return bad.groupBy("before", "pending", "event").agg(F.count(F.lit(1)).alias("events"))


@query(
    "three_way_reconciliation",
    """WITH o AS (SELECT o_orderkey AS key, o_orderkey % 7 AS v FROM orders), oo AS (SELECT l_orderkey AS key, any_value(l_orderkey % 7) AS v FROM lineitem GROUP BY 1), f AS (SELECT l_orderkey AS key, sum(l_quantity) AS v FROM lineitem GROUP BY 1), ff AS (SELECT l_orderkey AS key, sum(CASE WHEN l_tax > 0.07 THEN l_quantity + 1 ELSE l_quantity END) AS v FROM lineitem GROUP BY 1),
    p AS (SELECT l_suppkey AS key, sum(l_quantity) AS v FROM lineitem GROUP BY 1), pp AS (SELECT s_suppkey AS key, 0.0 AS v FROM supplier),
    r AS (SELECT 'orders' AS tbl, CASE WHEN o.key IS NULL THEN 'extra' WHEN oo.key IS NULL THEN 'missing' WHEN o.v <> oo.v THEN 'changed' ELSE 'equal' END AS status FROM o FULL JOIN oo ON o.key = oo.key UNION ALL
      SELECT 'fills', CASE WHEN f.key IS NULL THEN 'extra' WHEN ff.key IS NULL THEN 'missing' WHEN f.v <> ff.v THEN 'changed' ELSE 'equal' END FROM f FULL JOIN ff ON f.key = ff.key UNION ALL
      SELECT 'positions', CASE WHEN p.key IS NULL THEN 'extra' WHEN pp.key IS NULL THEN 'missing' WHEN p.v <> pp.v THEN 'changed' ELSE 'equal' END FROM p FULL JOIN pp ON p.key = pp.key)
    SELECT tbl AS record, status, count(*) AS rows FROM r GROUP BY 1, 2""",
)
def three_way_reconciliation(spark, sf):
    li = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 7).alias("v"))
    seen = li.select(F.col("l_orderkey").alias("key"), (F.col("l_orderkey") % 7).alias("v")).distinct()
    both = li.groupBy(F.col("l_orderkey").alias("key")).agg(
        F.sum("l_quantity").alias("v"), F.sum(F.when(F.col("l_tax") > 0.07, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))).alias("w")
    )
    held = li.groupBy(F.col("l_suppkey").alias("key")).agg(F.sum("l_quantity").alias("v"))
    flat = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.lit(0.0).alias("v"))
    parts = {
        "orders": O.reconcile(orders, seen, ["key"], ["v"]),
        "fills": O.reconcile(both.select("key", "v"), both.select("key", F.col("w").alias("v")), ["key"], ["v"]),
        "positions": O.reconcile(held, flat, ["key"], ["v"]),
    }
    out = None
    for name, part in parts.items():
        counted = part.groupBy("status").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("record"), "status", "rows")
        out = counted if out is None else out.unionByName(counted)
    return out


@query(
    "exposure_checks",
    f"""WITH e AS (SELECT o_custkey AS acct, CAST(epoch(o_orderdate) AS BIGINT) AS t, o_orderkey, o_totalprice AS px FROM orders), w AS (SELECT *, count(*) OVER r AS recent, sum(px) OVER r AS gross FROM e WINDOW r AS (PARTITION BY acct ORDER BY t RANGE BETWEEN {90 * DAY_S - 1} PRECEDING AND CURRENT ROW))
    SELECT coalesce(CASE WHEN px > 450000 THEN 'single_order_size' WHEN recent > 3 THEN 'order_rate' WHEN gross > 600000 THEN 'gross_exposure' END, 'pass') AS verdict, count(*) AS orders FROM w GROUP BY 1""",
)
def exposure_checks(spark, sf):
    e = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("acct"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("t"), "o_orderkey", F.col("o_totalprice").alias("px")
    )
    w = 90 * DAY_S
    out = sliding(
        e, ["acct"], "t", slices_for(spark, sf, "orders.t", e, "t"),
        {"recent": lambda f: F.count(F.lit(1)).over(f(-w + 1, 0)), "gross": lambda f: F.sum("px").over(f(-w + 1, 0))}, back=w,
    )
    verdict = O.first_failing(
        [("single_order_size", F.col("px") > 450000), ("order_rate", F.col("recent") > 3), ("gross_exposure", F.col("gross") > 600000)]
    )
    return out.groupBy(F.coalesce(verdict, F.lit("pass")).alias("verdict")).agg(F.count(F.lit(1)).alias("orders"))


@query(
    "duplicate_update_conflicts",
    """WITH u AS (SELECT l_orderkey * 10 + l_linenumber AS update_id, CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR) AS fingerprint FROM lineitem), c AS (SELECT update_id, count(*) AS copies, count(DISTINCT fingerprint) AS versions FROM u GROUP BY 1)
    SELECT CASE WHEN versions > 1 THEN 'conflict' WHEN copies > 1 THEN 'duplicate' ELSE 'single' END AS status, count(*) AS updates, CAST(sum(copies) AS BIGINT) AS rows FROM c GROUP BY 1""",
)
def duplicate_update_conflicts(spark, sf):
    u = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("update_id"),
        F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("fingerprint"),
    )
    # Least and greatest fingerprint differ exactly when there are several versions.
    c = u.groupBy("update_id").agg(
        F.count(F.lit(1)).alias("copies"), (F.min("fingerprint") != F.max("fingerprint")).alias("conflict")
    )
    status = F.when(F.col("conflict"), "conflict").when(F.col("copies") > 1, "duplicate").otherwise("single")
    return c.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("updates"), F.sum("copies").alias("rows"))


@query(
    "trailing_order_rate",
    f"""WITH e AS (SELECT o_custkey AS acct, CAST(epoch(o_orderdate) AS BIGINT) AS t, o_orderkey FROM orders) SELECT acct, o_orderkey, count(*) OVER (PARTITION BY acct ORDER BY t RANGE BETWEEN {30 * DAY_S - 1} PRECEDING AND CURRENT ROW) AS recent FROM e""",
)
def trailing_order_rate(spark, sf):
    e = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("acct"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("t"), "o_orderkey"
    )
    w = 30 * DAY_S
    out = sliding(
        e, ["acct"], "t", slices_for(spark, sf, "orders.t", e, "t"), {"recent": lambda f: F.count(F.lit(1)).over(f(-w + 1, 0))}, back=w
    )
    return out.select("acct", "o_orderkey", "recent")


@query(
    "catalogue_fold",
    """WITH e AS (SELECT o_custkey AS dataset_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS event_sequence, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'active' END AS status FROM orders),
    x AS (SELECT *, CASE WHEN event_sequence = 1 THEN 'dataset_registered' WHEN status = 'completed' THEN 'dataset_published' ELSE 'segment_published' END AS event_type, CAST(o_orderkey AS VARCHAR) AS event_digest, CASE WHEN event_sequence > 1 THEN CASE WHEN o_orderkey % 23 = 0 THEN 'broken' ELSE lag(CAST(o_orderkey AS VARCHAR)) OVER (PARTITION BY dataset_id ORDER BY event_sequence) END END AS prior FROM e),
    y AS (SELECT *, lag(event_digest) OVER w AS pd, lag(status) OVER w AS ps FROM x WINDOW w AS (PARTITION BY dataset_id ORDER BY event_sequence)),
    z AS (SELECT *, CASE WHEN coalesce(prior, '') <> coalesce(pd, '') THEN 'broken_digest_chain' WHEN event_sequence = 1 AND event_type <> 'dataset_registered' THEN 'invalid_first_event' WHEN ps IS NOT NULL AND ps <> 'active' AND (event_type <> 'dataset_published' OR status <> ps) THEN 'terminal_status_changed' END AS problem FROM y)
    SELECT dataset_id, count(*) AS events, arg_max(status, event_sequence) AS status, arg_max(event_type, event_sequence) AS last_event, arg_min(problem, event_sequence) FILTER (WHERE problem IS NOT NULL) AS problem FROM z GROUP BY 1""",
)
def catalogue_fold(spark, sf):
    from ..operators.slices import row_no
    from ..sources.catalog import fold_events

    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("dataset_id"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("active").alias("status"))
    cuts = slices_for(spark, sf, "orders.key", o, "o_orderkey")
    e = ordered_scan(o, ["dataset_id"], ["o_orderkey"], cuts, {"event_sequence": row_no(), "p": prev("o_orderkey")})
    first = F.col("event_sequence") == 1
    e = e.select(
        "dataset_id", "event_sequence", "status",
        F.when(first, "dataset_registered").when(F.col("status") == "completed", "dataset_published").otherwise("segment_published").alias("event_type"),
        F.col("o_orderkey").cast("string").alias("event_digest"),
        F.when(~first, F.when(F.col("o_orderkey") % 23 == 0, "broken").otherwise(F.col("p").cast("string"))).alias("prior_event_digest"),
    )
    return fold_events(e, slices_for(spark, sf, "catalog.seq", e, "event_sequence"))


@query(
    "dataset_request_resolution",
    """WITH h AS (SELECT o_orderkey AS dataset_id, CAST(o_orderdate AS DATE) AS trading_date, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'failed' END AS status, substr(o_orderpriority, 1, 1) AS ch, o_totalprice AS completed_at FROM orders),
    r AS (SELECT c_custkey AS request_id, CAST(o_orderdate AS DATE) AS trading_date, substr(o_orderpriority, 1, 1) AS ch, c_custkey % 2 = 0 AS allow_active FROM customer JOIN orders ON o_orderkey = c_custkey),
    m AS (SELECT request_id, dataset_id, completed_at FROM r JOIN h ON r.trading_date = h.trading_date AND r.ch = h.ch AND (status = 'completed' OR (status = 'active' AND allow_active)))
    SELECT r.request_id, arg_max(dataset_id, (completed_at, dataset_id)) AS dataset_id FROM r LEFT JOIN m ON r.request_id = m.request_id GROUP BY 1""",
)
def dataset_request_resolution(spark, sf):
    from ..sources.catalog import resolve

    o = table(spark, sf, "orders")
    channel = F.array(F.substring("o_orderpriority", 1, 1))
    none = F.lit(None).cast("timestamp")
    handles = o.select(
        F.col("o_orderkey").alias("dataset_id"), F.to_date("o_orderdate").alias("trading_date"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "active").otherwise("failed").alias("status"),
        channel.alias("channels"), F.array(F.lit("X")).alias("instrument_ids"), none.alias("coverage_start"), none.alias("coverage_end"),
        F.col("o_totalprice").alias("completed_at"),
    )
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"))
    requests = c.join(o, F.col("request_id") == F.col("o_orderkey")).select(
        "request_id", F.to_date("o_orderdate").alias("trading_date"), channel.alias("req_channels"), F.array(F.lit("X")).alias("req_instruments"),
        none.alias("req_start"), none.alias("req_end"), (F.col("request_id") % 2 == 0).alias("allow_active"),
    )
    return resolve(requests, handles)
