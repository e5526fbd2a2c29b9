"""Response families of large prints, with matched quiet controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import responses as R
from ..session import cut_lineage
from .bindings import DAY, HOUR, TAPE_SQL, tape, time_slices
from .registry import query

HAIR = 1e-9  #: means of hundredths may end in an exact 5, which this rounds alike everywhere
GAPS, HORIZONS, LAG = (HOUR, 6 * HOUR), (6 * HOUR, DAY), 3

# Prices are a channel's own prints; events are its large ones, by side of the middle.
_PRICES_SQL = f"{TAPE_SQL}, v AS (SELECT channel, ts_us, seq, value FROM tape), m AS (SELECT channel, max(ts_us) AS til FROM v GROUP BY 1)"
_CELLS = f"(VALUES {', '.join(f'({g}, {h})' for g in GAPS for h in HORIZONS)}) gh(gap, horizon)"


def _responses_sql(name: str, where: str) -> str:
    return f"""{name}0 AS (SELECT channel, seq, ts_us, value > 50 AS up, ts_us // {DAY} AS day, gap, horizon, ts_us + gap AS ta, ts_us + gap + horizon AS tb FROM tape, {_CELLS} WHERE {where}),
    {name}1 AS (SELECT x.*, a.value AS va FROM {name}0 x ASOF JOIN v a ON x.channel = a.channel AND x.ta >= a.ts_us),
    {name} AS (SELECT x.channel, x.seq, x.ts_us, up, day, gap, horizon, b.value - va AS response FROM {name}1 x ASOF JOIN v b ON x.channel = b.channel AND x.tb >= b.ts_us JOIN m ON m.channel = x.channel AND tb <= til)"""


_EVENT, _QUIET = "abs(value - 50) > 40", "abs(value - 50) < 25"


def responses(spark, sf, condition: str):
    rows = tape(spark, sf)
    events = rows.where(condition)
    out = R.timed_responses(events, rows.select("channel", F.col("ts_us").alias("pts"), F.col("seq").alias("pseq"), "value"), ["channel"], "seq", "ts_us", "pts", "pseq", "value", GAPS, HORIZONS, time_slices(spark, sf))
    return out.join(events.select("seq", (F.col("value") > 50).alias("up"), F.expr(f"ts_us div {DAY}").alias("day")), "seq")


def control_pairs(spark, sf):
    """The next quiet print of the channel after each event: a pair is made by time, never by outcome."""
    from ..operators.asof import asof

    rows = tape(spark, sf)
    quiet = rows.where(_QUIET).select("channel", F.col("ts_us").alias("qts"), F.col("seq").alias("control"))
    out = asof(rows.where(_EVENT).select("channel", "seq", "ts_us"), quiet, keys=["channel"], left_ts="ts_us", right_ts="qts", values=["control"], slices=time_slices(spark, sf), right_ties=["control"], direction="forward", strict=True)
    return out.where("m_control IS NOT NULL").select("seq", F.col("m_control").alias("control"))


@query(
    "timed_event_responses",
    f"""WITH {_PRICES_SQL}, {_responses_sql("e", _EVENT)} SELECT channel, up, CAST(gap AS BIGINT) AS gap, CAST(horizon AS BIGINT) AS horizon, count(*) AS events, round(avg(response) + {HAIR}, 6) AS mean FROM e GROUP BY 1, 2, 3, 4""",
)
def timed_event_responses(spark, sf):
    out = responses(spark, sf, _EVENT).groupBy("channel", "up", "gap", "horizon")
    return out.agg(F.count(F.lit(1)).alias("events"), F.round(F.avg("response") + HAIR, 6).alias("mean"))


@query(
    "matched_response_differences",
    f"""WITH {_PRICES_SQL}, {_responses_sql("e", _EVENT)}, {_responses_sql("c", _QUIET)}, q AS (SELECT channel, ts_us, seq FROM tape WHERE {_QUIET}),
    p AS (SELECT t.seq, q.seq AS control FROM tape t ASOF JOIN q ON t.channel = q.channel AND t.ts_us < q.ts_us WHERE {_EVENT.replace("value", "t.value")})
    SELECT e.channel, up, CAST(e.gap AS BIGINT) AS gap, CAST(e.horizon AS BIGINT) AS horizon, count(*) AS pairs, round(avg(e.response - k.response) + {HAIR}, 6) AS mean_difference FROM e JOIN p ON p.seq = e.seq JOIN (SELECT seq, gap, horizon, response FROM c) k ON k.seq = p.control AND k.gap = e.gap AND k.horizon = e.horizon GROUP BY 1, 2, 3, 4""",
)
def matched_response_differences(spark, sf):
    """Events less the next quiet print of their channel, in the same cell."""
    events, quiet = responses(spark, sf, _EVENT), responses(spark, sf, _QUIET)
    out = R.matched_differences(events, control_pairs(spark, sf), "seq", "control", quiet).groupBy("channel", "up", "gap", "horizon")
    return out.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("response") + HAIR, 6).alias("mean_difference"))


_NW = " + ".join(f"{1 - k / (LAG + 1)!r} * coalesce(sum(u * u{k}), 0)" for k in range(1, LAG + 1))


@query(
    "response_family_estimates",
    f"""WITH RECURSIVE {_PRICES_SQL}, {_responses_sql("e", _EVENT)}, {_responses_sql("c", _QUIET)}, q AS (SELECT channel, ts_us, seq FROM tape WHERE {_QUIET}),
    p AS (SELECT t.seq, q.seq AS control FROM tape t ASOF JOIN q ON t.channel = q.channel AND t.ts_us < q.ts_us WHERE {_EVENT.replace("value", "t.value")}),
    o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY channel, up, gap, horizon ORDER BY ts_us, seq) AS i FROM e),
    g AS (SELECT channel, up, gap, horizon, i, ts_us + gap + horizon AS held, true AS kept FROM o WHERE i = 1 UNION ALL SELECT o.channel, o.up, o.gap, o.horizon, o.i, CASE WHEN o.ts_us > held THEN o.ts_us + o.gap + o.horizon ELSE held END, o.ts_us > held FROM g JOIN o ON o.channel = g.channel AND o.up = g.up AND o.gap = g.gap AND o.horizon = g.horizon AND o.i = g.i + 1),
    r AS (SELECT '{R.ALL}' AS arm, channel, up, gap, horizon, ts_us, seq, response FROM e UNION ALL SELECT '{R.EPISODES}', o.channel, o.up, o.gap, o.horizon, ts_us, seq, response FROM o JOIN g ON o.channel = g.channel AND o.up = g.up AND o.gap = g.gap AND o.horizon = g.horizon AND o.i = g.i WHERE kept
     UNION ALL SELECT '{R.MATCHED}', e.channel, e.up, e.gap, e.horizon, e.ts_us, e.seq, e.response - k.response FROM e JOIN p ON p.seq = e.seq JOIN (SELECT seq, gap, horizon, response FROM c) k ON k.seq = p.control AND k.gap = e.gap AND k.horizon = e.horizon),
    d AS (SELECT *, response - avg(response) OVER (PARTITION BY arm, channel, up, gap, horizon) AS u FROM r), l AS (SELECT *, {", ".join(f"lag(u, {k}) OVER w AS u{k}" for k in range(1, LAG + 1))} FROM d WINDOW w AS (PARTITION BY arm, channel, up, gap, horizon ORDER BY ts_us, seq)),
    s AS (SELECT arm, channel, up, gap, horizon, count(*) AS n, avg(response) AS mean, sqrt(greatest(sum(u * u) / count(*) + 2 * ({_NW}) / count(*), 0) / count(*)) AS se FROM l GROUP BY ALL)
    SELECT arm, channel, up, CAST(gap AS BIGINT) AS gap, CAST(horizon AS BIGINT) AS horizon, n, round(mean + {HAIR}, 6) AS mean, round(se, 5) AS standard_error, round(mean - 1.959963984540054 * se, 5) AS low, round(mean + 1.959963984540054 * se, 5) AS high FROM s""",
)
def response_family_estimates(spark, sf):
    """All cells in three arms; the adjusted p-values are in ``response_family``."""
    out = response_family(spark, sf)
    return out.drop("t_statistic", "rank", "adjusted_p").select(
        "arm", "channel", "up", "gap", "horizon", "n", F.round(F.col("mean") + HAIR, 6).alias("mean"), *[F.round(c, 5).alias(c) for c in ("standard_error", "low", "high")]
    )


@query("response_family")
def response_family(spark, sf):
    """The same with ranks and step-down p-values over all cells of an arm."""
    events, quiet = cut_lineage(responses(spark, sf, _EVENT)), responses(spark, sf, _QUIET)
    differences = R.matched_differences(events, control_pairs(spark, sf), "seq", "control", quiet)
    return R.response_family(events, [], ["channel", "up"], "day", "seq", "ts_us", time_slices(spark, sf), lag=LAG, differences=differences)
