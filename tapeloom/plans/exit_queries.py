"""Exit ceilings and butterflies over the end values of given paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ceiling as C
from ..operators.payoffs import butterfly_summary
from .bindings import DAY, TAPE_SQL, slices_for, tape
from .registry import query

_PATHS_SQL = f"{TAPE_SQL}, q AS (SELECT channel, ts_us // {DAY} AS day, ts_us, seq, value + 1 AS p FROM tape), e AS (SELECT channel, day, min(ts_us) AS t0, max(ts_us) AS t1, count(*) AS rows, arg_min(p, (ts_us, seq)) AS entry, arg_max(p, (ts_us, seq)) AS close, max(p) AS peak, min(p) AS trough, arg_max(ts_us, (p, -ts_us, -seq)) AS top_ts FROM q GROUP BY 1, 2)"


def paths(spark, sf):
    return tape(spark, sf).select("channel", F.expr(f"ts_us div {DAY}").alias("day"), "ts_us", "seq", (F.col("value") + 1).alias("p"))


@query(
    "exit_ceilings",
    f"""WITH {_PATHS_SQL}, b AS (SELECT q.channel, q.day, min(ts_us) AS passed FROM q JOIN e USING (channel, day) WHERE p >= entry * (1 + 2.0 / 100) AND ts_us > t0 GROUP BY 1, 2)
    SELECT e.channel, e.day, rows, entry, close, peak, trough, t1 - t0 AS span_us, e.top_ts - t0 AS peak_us, round(CASE WHEN t1 > t0 THEN CAST(e.top_ts - t0 AS DOUBLE) / (t1 - t0) END, 6) AS peak_u, round((peak - entry) / entry * 100, 6) AS peak_return, round((close - entry) / entry * 100, 6) AS close_return, round((peak - close) / entry * 100, 6) AS giveback, b.passed - t0 AS break_even_us
    FROM e LEFT JOIN b ON e.channel = b.channel AND e.day = b.day""",
)
def exit_ceilings(spark, sf):
    """Each channel's day as a path from its first print; break-even is two percent above it."""
    out = C.path_ceilings(paths(spark, sf), ["channel", "day"], "ts_us", "seq", "p", 2.0)
    rounded = ("peak_u", "peak_return", "close_return", "giveback")
    return out.select(*[F.round(c, 6).alias(c) if c in rounded else c for c in out.columns])


_ARCSINE = "2 / pi() * asin(sqrt(greatest(0, least(1, u))))"


@query(
    "peak_time_arcsine",
    f"""WITH {_PATHS_SQL}, u AS (SELECT channel, CAST(top_ts - t0 AS DOUBLE) / (t1 - t0) AS u FROM e WHERE t1 > t0), r AS (SELECT channel, u, count(*) OVER (PARTITION BY channel) AS n, rank() OVER (PARTITION BY channel ORDER BY u) - 1 AS under, rank() OVER (PARTITION BY channel ORDER BY u) - 1 + count(*) OVER (PARTITION BY channel, u) AS upto FROM u),
    g AS (SELECT channel, u, n, CAST(upto AS DOUBLE) / n - {_ARCSINE} AS above, {_ARCSINE} - CAST(under AS DOUBLE) / n AS below FROM r), d AS (SELECT channel, any_value(n) AS n, max(above) AS d_plus, max(below) AS d_minus, max(greatest(above, below)) AS d FROM g GROUP BY 1)
    SELECT channel, n, round(d_plus, 6) AS d_plus, round(d_minus, 6) AS d_minus, round(d, 6) AS distance, round(CASE WHEN (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d < 0.3 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 40), lambda k: 2.0 * (-1) ** (k - 1) * exp(-2.0 * k * k * ((sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d) ** 2))))) END, 6) AS p_value FROM d WHERE n >= 5""",
)
def peak_time_arcsine(spark, sf):
    """Whether peaks fall as an arcsine law has them: more at both ends of a day than in its middle."""
    ends = C.path_ceilings(paths(spark, sf), ["channel", "day"], "ts_us", "seq", "p", 2.0).where("peak_u IS NOT NULL")
    out = C.distribution_distance(ends, ["channel"], "peak_u", C.arcsine_cdf, slices_for(spark, sf, "peak.u", ends, "peak_u"))
    return out.where("distance IS NOT NULL").select("channel", "n", *[F.round(c, 6).alias(c) for c in ("d_plus", "d_minus", "distance", "p_value")])


_TICKS = "CAST(round(value * 100) AS BIGINT)"


@query(
    "butterfly_candidates",
    f"""WITH {TAPE_SQL}, s AS (SELECT channel, {_TICKS} AS v, count(*) OVER (PARTITION BY channel) AS n FROM tape), k AS (SELECT channel, c * 100 AS center, w * 100 AS width, w * q AS net FROM (SELECT DISTINCT channel FROM tape), range(20, 90, 5) a(c), (VALUES (5), (15), (40)) b(w), (VALUES (30), (80), (120)) d(q)),
    p AS (SELECT k.*, n, k.net - least(abs(v - center), width) - 0.0015 * greatest(abs(v - center) - width, 0) AS pnl, row_number() OVER (PARTITION BY k.channel, center, width, net ORDER BY abs(v - center) DESC) AS r FROM k JOIN s USING (channel) WHERE net < width),
    g AS (SELECT channel, center, width, net, any_value(n) AS n, avg(pnl) AS mean, avg(CASE WHEN pnl < 0 THEN 1.0 ELSE 0 END) AS loss_chance, min(pnl) AS worst, greatest(1, CAST(floor(any_value(n) * 0.05) AS BIGINT)) AS tail_rows, avg(pnl) FILTER (WHERE r <= greatest(1, floor(n * 0.05))) AS tail_mean FROM p GROUP BY 1, 2, 3, 4)
    SELECT channel, center, width, net, n, NULL AS reason, round(mean, 6) AS mean, round(loss_chance, 6) AS loss_chance, round(worst, 6) AS worst, tail_rows, round(tail_mean, 6) AS tail_mean FROM g
    UNION ALL SELECT channel, center, width, net, (SELECT any_value(n) FROM s WHERE s.channel = k.channel), 'nonviable_credit', NULL, NULL, NULL, NULL, NULL FROM k WHERE net >= width""",
)
def butterfly_candidates(spark, sf):
    """A grid of centers, widths and credits over the given values of each channel, in hundredths."""
    ends = tape(spark, sf).select("channel", F.round(F.col("value") * 100).cast("long").alias("v"))
    grid = ends.select("channel").distinct().select(
        "channel", F.explode(F.sequence(F.lit(20), F.lit(85), F.lit(5))).alias("c")
    ).withColumn("w", F.explode(F.array(*map(F.lit, (5, 15, 40))))).withColumn("q", F.explode(F.array(*map(F.lit, (30, 80, 120)))))
    candidates = grid.select("channel", (F.col("c") * 100).cast("long").alias("center"), (F.col("w") * 100).cast("long").alias("width"), (F.col("w") * F.col("q")).cast("long").alias("net"))
    out = butterfly_summary(ends, candidates, ["channel"], "v", slices_for(spark, sf, "ticks.v", ends, "v"))
    return out.select(*[F.round(c, 6).alias(c) if c in ("mean", "loss_chance", "worst", "tail_mean") else c for c in out.columns])
