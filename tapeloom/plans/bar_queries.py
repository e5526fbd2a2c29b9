"""Bars, spreads, realised measures, breakouts and exits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.real import divide, rounded, sign
from ..operators import bars as R
from ..operators.quantiles import quantiles
from ..operators.slices import ordered_scan, prev, row_no, sliding
from ..session import cut_lineage
from .bindings import DAY, HOUR, KEYS, TAPE_SQL, slices_for, table, tape, time_slices
from .registry import query

W = 6 * HOUR
BARS_SQL = f"""{TAPE_SQL}, bars AS (SELECT channel, ts_us // {W} * {W} AS bar_start, arg_min(value, (ts_us, seq)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts_us, seq)) AS close,
  CAST(sum(1 + seq % 50) AS BIGINT) AS volume, count(*) AS rows FROM tape GROUP BY 1, 2)"""


def channel_bars(spark, sf):
    rows = tape(spark, sf).withColumn("qty", 1 + F.col("seq") % 50)
    return R.make_bars(rows, ["channel"], "ts_us", "seq", "value", "qty", W)


@query("ohlcv_bars", f"WITH {BARS_SQL} SELECT * FROM bars")
def ohlcv_bars(spark, sf):
    return channel_bars(spark, sf)


@query(
    "realized_measures",
    f"""WITH {TAPE_SQL}, r AS (SELECT channel, ts_us // {DAY} AS day, ts_us, seq, ln(value / lag(value) OVER (PARTITION BY channel, ts_us // {DAY} ORDER BY ts_us, seq)) AS r FROM tape), l AS (SELECT *, lag(r) OVER (PARTITION BY channel, day ORDER BY ts_us, seq) AS r1 FROM r),
    a AS (SELECT channel, day, count(r) AS returns, coalesce(sum(r * r), 0) AS rv, coalesce(sum(CASE WHEN r > 0 THEN r * r END), 0) AS up, coalesce(sum(CASE WHEN r < 0 THEN r * r END), 0) AS dn, 1.5707963267948966 * coalesce(sum(abs(r) * abs(r1)), 0) AS bp, count(r) / 3.0 * coalesce(sum(r * r * r * r), 0) AS q, max(abs(r)) AS m FROM l GROUP BY 1, 2)
    SELECT channel, day, returns, round(rv, 5) AS realized_variance, round(up, 5) AS up_semivariance, round(dn, 5) AS down_semivariance, round(bp, 5) AS bipower, round(greatest(rv - bp, 0), 5) AS jump, round(q, 3) AS quarticity, round(m, 6) AS max_abs_return FROM a""",
)
def realized_measures(spark, sf):
    rows = tape(spark, sf).withColumn("day", F.expr(f"ts_us div {DAY}"))
    r = R.log_returns(rows, ["channel", "day"], ["ts_us", "seq"], "value", time_slices(spark, sf))
    out = R.realized_measures(r, ["channel", "day"])
    d = {"realized_variance": 5, "up_semivariance": 5, "down_semivariance": 5, "bipower": 5, "jump": 5, "quarticity": 3, "max_abs_return": 6}
    return out.select("channel", "day", "returns", *[F.round(c, n).alias(c) for c, n in d.items()])


@query(
    "path_quality_labels",
    f"""WITH {BARS_SQL}, p AS (SELECT channel, bar_start, close, bar_start // {W} AS k FROM bars), s AS (SELECT *, ln(close / lag(close) OVER w) AS r, abs(close - lag(close) OVER w) AS st FROM p WINDOW w AS (PARTITION BY channel ORDER BY k)),
    l AS (SELECT *, lag(r) OVER (PARTITION BY channel ORDER BY k) AS r1, avg(r) OVER (PARTITION BY channel) AS mu FROM s)
    SELECT channel, count(*) AS points, round(sum((r - mu) * (r1 - mu)) / sum((r - mu) * (r - mu)), 6) AS rho1, round(regr_r2(close, k), 6) AS line_r2, round(abs(arg_max(close, k) - arg_min(close, k)) / sum(st), 6) AS efficiency,
      round((arg_max(close, k) / arg_min(close, k) - 1) * 100, 5) AS displacement_pct, round(sqrt(sum(r * r)), 6) AS realized_volatility FROM l GROUP BY 1""",
)
def path_quality_labels(spark, sf):
    p = channel_bars(spark, sf).select("channel", F.expr(f"bar_start div {W}").alias("k"), "close")
    out = R.path_measures(p, ["channel"], "k", "close", slices_for(spark, sf, "bars.k", p, "k"))
    return out.select("channel", "points", *[F.round(c, 5 if c == "displacement_pct" else 6).alias(c) for c in ("rho1", "line_r2", "efficiency", "displacement_pct", "realized_volatility")])


ROLL_SQL = f"""{TAPE_SQL}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY instrument_id ORDER BY ts_us, seq) AS d FROM tape), e AS (SELECT *, lag(d) OVER (PARTITION BY instrument_id ORDER BY ts_us, seq) AS d1 FROM d)"""


@query(
    "roll_effective_spread",
    f"""WITH {ROLL_SQL}, a AS (SELECT instrument_id, count(*) AS prices, count(d1) AS pairs, covar_pop(d, d1) AS c FROM e GROUP BY 1)
    SELECT instrument_id, prices, pairs, round(c, 4) AS autocovariance, CASE WHEN pairs >= 2 AND c < 0 THEN round(2 * sqrt(-c), 6) END AS effective_spread FROM a""",
)
def roll_effective_spread(spark, sf):
    out = R.roll_spread(tape(spark, sf), KEYS, KEYS, ["ts_us", "seq"], "value", time_slices(spark, sf))
    return out.select("instrument_id", "prices", "pairs", F.round("autocovariance", 4).alias("autocovariance"), F.round("effective_spread", 6).alias("effective_spread"))


@query(
    "roll_spread_tumbling",
    f"""WITH {TAPE_SQL}, w AS (SELECT *, ts_us // {4 * DAY} AS b FROM tape), d AS (SELECT *, value - lag(value) OVER (PARTITION BY instrument_id, b ORDER BY ts_us, seq) AS d FROM w), e AS (SELECT *, lag(d) OVER (PARTITION BY instrument_id, b ORDER BY ts_us, seq) AS d1 FROM d),
    a AS (SELECT instrument_id, b, count(*) AS prices, count(d1) AS pairs, covar_samp(d, d1) AS c FROM e GROUP BY 1, 2)
    SELECT instrument_id, b AS bucket, prices, pairs, CASE WHEN pairs >= 2 AND c < 0 THEN round(2 * sqrt(-c), 6) END AS effective_spread FROM a""",
)
def roll_spread_tumbling(spark, sf):
    rows = tape(spark, sf).withColumn("bucket", F.expr(f"ts_us div {4 * DAY}"))
    keys = ["instrument_id", "bucket"]
    out = R.roll_spread(rows, keys, keys, ["ts_us", "seq"], "value", time_slices(spark, sf), sample=True)
    return out.select(*keys, "prices", "pairs", F.round("effective_spread", 6).alias("effective_spread"))


@query(
    "high_low_spread",
    f"""WITH {BARS_SQL}, p AS (SELECT *, lag(high) OVER w AS h0, lag(low) OVER w AS l0 FROM bars WINDOW w AS (PARTITION BY channel ORDER BY bar_start)),
    q AS (SELECT channel, ln(high / low) ^ 2 + ln(h0 / l0) ^ 2 AS beta, ln(greatest(high, h0) / least(low, l0)) ^ 2 AS g FROM p WHERE h0 IS NOT NULL), a AS (SELECT channel, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2)) - sqrt(g / (3 - 2 * sqrt(2))) AS al FROM q),
    s AS (SELECT channel, 2 * (exp(al) - 1) / (1 + exp(al)) AS s FROM a)
    SELECT channel, count(*) AS n, round(median(s), 6) AS spread FROM s WHERE s > 0 GROUP BY 1""",
)
def high_low_spread(spark, sf):
    pairs = R.corwin_schultz(channel_bars(spark, sf), ["channel"], "bar_start", time_slices(spark, sf))
    pairs = cut_lineage(pairs.select("channel", "spread"))
    cuts = slices_for(spark, sf, "bars.spread", pairs, "spread")
    q = quantiles(pairs.withColumnRenamed("spread", "s"), ["channel"], "s", {"spread": 0.5}, cuts)
    return q.withColumn("spread", F.round("spread", 6))


@query(
    "low_activity_range_floor",
    f"""WITH {BARS_SQL}, e AS (SELECT channel, quantile_cont(volume, 0.25) AS cut FROM bars GROUP BY 1) SELECT channel, count(*) AS bars, round(median(high - low) / 2, 6) AS half_range FROM bars JOIN e USING (channel) WHERE volume <= cut GROUP BY 1""",
)
def low_activity_range_floor(spark, sf):
    b = channel_bars(spark, sf)
    cut = quantiles(b, ["channel"], "volume", {"cut": 0.25}, slices_for(spark, sf, "bars.volume", b, "volume"))
    quiet = b.join(cut.select("channel", "cut"), "channel").where(F.col("volume") <= F.col("cut")).withColumn("rng", F.col("high") - F.col("low"))
    q = quantiles(quiet, ["channel"], "rng", {"m": 0.5}, slices_for(spark, sf, "bars.range", quiet, "rng"))
    return q.select("channel", F.col("n").alias("bars"), F.round(F.col("m") / 2, 6).alias("half_range"))


TR_SQL = f"""{BARS_SQL}, k AS (SELECT *, row_number() OVER w AS i, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY channel ORDER BY bar_start)),
 tr AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm FROM k)"""


def ranged_bars(spark, sf):
    cuts = time_slices(spark, sf)
    b = R.true_range(channel_bars(spark, sf), ["channel"], "bar_start", cuts)
    return R.directional_movement(b).withColumn("i", F.expr(f"bar_start div {W}"))


@query(
    "true_range_choppiness",
    f"""WITH {TR_SQL}, c AS (SELECT channel, bar_start, tr, bar_start // {W} AS g FROM tr), w AS (SELECT t.channel, t.bar_start, t.tr, sum(t.tr) OVER x AS s, max(high) OVER x - min(low) OVER x AS r, count(*) OVER x AS n FROM tr t WINDOW x AS (PARTITION BY t.channel ORDER BY bar_start // {W} RANGE BETWEEN 13 PRECEDING AND CURRENT ROW))
    SELECT channel, bar_start, round(tr, 6) AS tr, CASE WHEN n = 14 AND r > 0 AND s > 0 THEN round(100 * log10(s / r) / log10(14), 5) END AS choppiness FROM w""",
)
def true_range_choppiness(spark, sf):
    b = ranged_bars(spark, sf)
    out = R.choppiness(b, ["channel"], "i", 14, slices_for(spark, sf, "bars.k", b.withColumnRenamed("i", "k"), "k"))
    return out.select("channel", "bar_start", F.round("tr", 6).alias("tr"), F.round("choppiness", 5).alias("choppiness"))


@query(
    "wilder_average_true_range",
    f"""WITH RECURSIVE {TR_SQL}, s AS (SELECT channel, i, bar_start, tr, sum(tr) OVER (PARTITION BY channel ORDER BY i) AS c FROM tr),
    r AS (SELECT channel, i, bar_start, c AS acc FROM s WHERE i = 7 UNION ALL SELECT s.channel, s.i, s.bar_start, r.acc - r.acc / 7 + s.tr FROM r JOIN s ON s.channel = r.channel AND s.i = r.i + 1)
    SELECT s.channel, s.bar_start, round(r.acc / 7, 5) AS atr FROM s LEFT JOIN r ON s.channel = r.channel AND s.i = r.i""",
)
def wilder_average_true_range(spark, sf):
    b = ranged_bars(spark, sf).select("channel", "bar_start", "tr")
    out = R.wilder(b, ["channel"], "bar_start", "tr", 7, time_slices(spark, sf), "acc")
    return out.select("channel", "bar_start", F.round(F.col("acc") / 7, 5).alias("atr"))


@query(
    "prior_close_returns",
    f"""WITH {TAPE_SQL}, d AS (SELECT instrument_id, ts_us // {DAY} AS day, arg_min(value, (ts_us, seq)) AS open, arg_max(value, (ts_us, seq)) AS close FROM tape GROUP BY 1, 2), l AS (SELECT *, lag(close, 1) OVER w AS c1, lag(close, 2) OVER w AS c2 FROM d WINDOW w AS (PARTITION BY instrument_id ORDER BY day))
    SELECT instrument_id, day, round(100 * (open / c1 - 1), 4) AS gap_pct, round(100 * (close / open - 1), 4) AS intraday_pct, round(100 * (c1 / c2 - 1), 4) AS prior_return_pct FROM l""",
)
def prior_close_returns(spark, sf):
    rows = tape(spark, sf).withColumn("qty", F.lit(1))
    d = R.make_bars(rows, KEYS, "ts_us", "seq", "value", "qty", DAY).select("instrument_id", "bar_start", "open", "close")
    cuts = time_slices(spark, sf)
    one = ordered_scan(d, KEYS, ["bar_start"], cuts, {"c1": prev("close")})
    two = ordered_scan(one, KEYS, ["bar_start"], cuts, {"c2": prev("c1")})
    return two.select(
        "instrument_id", F.expr(f"bar_start div {DAY}").alias("day"),
        rounded(100 * (divide("open", "c1") - 1), 4).alias("gap_pct"),
        rounded(100 * (divide("close", "open") - 1), 4).alias("intraday_pct"),
        rounded(100 * (divide("c1", "c2") - 1), 4).alias("prior_return_pct"),
    )


@query(
    "expanding_median_signal",
    f"""WITH {TAPE_SQL}, d AS (SELECT channel, ts_us // {DAY} AS day, avg(value) AS m FROM tape GROUP BY 1, 2), e AS (SELECT *, median(m) OVER (PARTITION BY channel ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tm FROM d)
    SELECT channel, day, round(m, 6) AS level, round(tm, 6) AS trailing_median, CAST(sign(m - tm) AS INTEGER) AS signal FROM e""",
)
def expanding_median_signal(spark, sf):
    daily = tape(spark, sf).groupBy("channel", F.expr(f"ts_us div {DAY}").alias("day")).agg(F.avg("value").alias("m"))
    # One row per session: an expanding frame over sessions is bounded by the calendar.
    cuts = slices_for(spark, sf, "trend.day", daily, "day")
    span = 40_000
    out = sliding(daily, ["channel"], "day", cuts, {"t": lambda f: F.percentile("m", 0.5).over(f(-span, -1))}, back=span)
    return out.select(
        "channel", "day", F.round("m", 6).alias("level"), F.round("t", 6).alias("trailing_median"),
        F.signum(F.col("m") - F.col("t")).cast("int").alias("signal"),
    )


@query(
    "trailing_sum_prior_rows",
    f"""WITH {TAPE_SQL}, d AS (SELECT channel, ts_us // {DAY} AS day, sum(value) AS v FROM tape GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY day) AS i, sum(v) OVER w AS s, avg(v) OVER w AS m FROM d WINDOW w AS (PARTITION BY channel ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
    SELECT channel, day, CASE WHEN i > 5 THEN round(s, 3) END AS prior_sum, CASE WHEN i > 5 THEN round(m, 4) END AS prior_mean FROM n""",
)
def trailing_sum_prior_rows(spark, sf):
    daily = tape(spark, sf).groupBy("channel", F.expr(f"ts_us div {DAY}").alias("day")).agg(F.sum("value").alias("v"))
    cuts = slices_for(spark, sf, "trend.day", daily, "day")
    numbered = ordered_scan(daily, ["channel"], ["day"], cuts, {"i": row_no()})
    out = sliding(
        numbered, ["channel"], "i", slices_for(spark, sf, "trend.i", numbered, "i"),
        {"s": lambda f: F.sum("v").over(f(-5, -1)), "m": lambda f: F.avg("v").over(f(-5, -1))}, back=5,
    )
    ok = F.col("i") > 5
    return out.select("channel", "day", F.when(ok, F.round("s", 3)).alias("prior_sum"), F.when(ok, F.round("m", 4)).alias("prior_mean"))


@query(
    "within_group_zscore",
    f"""WITH {TAPE_SQL}, d AS (SELECT channel, instrument_id, avg(value) AS v FROM tape GROUP BY 1, 2) SELECT channel, instrument_id, CASE WHEN count(*) OVER w >= 3 AND stddev_samp(v) OVER w > 0 THEN round((v - avg(v) OVER w) / stddev_samp(v) OVER w, 5) END AS z FROM d WINDOW w AS (PARTITION BY channel)""",
)
def within_group_zscore(spark, sf):
    d = tape(spark, sf).groupBy("channel", "instrument_id").agg(F.avg("value").alias("v"))
    m = d.groupBy("channel").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.count(F.lit(1)).alias("n"))
    z = F.when((F.col("n") >= 3) & (F.col("s") > 0), F.round((F.col("v") - F.col("m")) / F.col("s"), 5))
    return d.join(m, "channel").select("channel", "instrument_id", z.alias("z"))


@query(
    "extreme_order",
    f"""WITH {TAPE_SQL}, a AS (SELECT channel, ts_us // {DAY} AS day, arg_min(ts_us, (-value, ts_us)) AS high_at, arg_min(ts_us, (value, ts_us)) AS low_at, max(value) AS high, min(value) AS low FROM tape GROUP BY 1, 2)
    SELECT channel, day, high_at, low_at, high, low, CASE WHEN high_at <> low_at THEN high_at < low_at END AS high_first FROM a""",
)
def extreme_order(spark, sf):
    rows = tape(spark, sf).withColumn("day", F.expr(f"ts_us div {DAY}"))
    return R.extreme_order(rows, ["channel", "day"], "ts_us", "value")


@query(
    "opening_range_breakout",
    f"""WITH {TAPE_SQL}, p AS (SELECT channel, ts_us // {DAY} AS day, ts_us % {DAY} AS clock, value AS px FROM tape), r AS (SELECT channel, day, max(CASE WHEN clock <= {4 * HOUR} THEN px END) AS hi, min(CASE WHEN clock <= {4 * HOUR} THEN px END) AS lo FROM p GROUP BY 1, 2),
    l AS (SELECT p.*, hi, lo FROM p JOIN r USING (channel, day) WHERE clock >= {5 * HOUR}), f AS (SELECT channel, day, any_value(hi) AS hi, any_value(lo) AS lo, arg_max(px, clock) AS close, min(CASE WHEN px > hi OR px < lo THEN clock END) AS bo FROM l GROUP BY 1, 2),
    e AS (SELECT f.*, l.px AS entry, CASE WHEN l.px > f.hi THEN 1 ELSE -1 END AS d FROM f JOIN l ON f.channel = l.channel AND f.day = l.day AND l.clock = f.bo)
    SELECT e.channel, e.day, e.hi AS or_high, e.lo AS or_low, d AS direction, bo AS breakout_at, entry, close, round(max(d * (px - entry)), 6) AS mfe, round(min(d * (px - entry)), 6) AS mae, bool_or(CASE WHEN d > 0 THEN px < e.hi ELSE px > e.lo END) AS failed, count(*) - 1 AS held, round(d * (close - entry), 6) AS follow_through
    FROM e JOIN l ON e.channel = l.channel AND e.day = l.day AND l.clock >= e.bo GROUP BY ALL""",
)
def opening_range_breakout(spark, sf):
    rows = tape(spark, sf).select("channel", F.expr(f"ts_us div {DAY}").alias("day"), F.expr(f"ts_us % {DAY}").alias("clock"), F.col("value").alias("px"))
    out = R.opening_range_breakout(rows, ["channel", "day"], "clock", "px", 4 * HOUR, 5 * HOUR)
    return out.select(*[F.round(c, 6).alias(c) if c in ("mfe", "mae", "follow_through") else F.col(c) for c in out.columns])


@query(
    "exit_rule_grid",
    f"""WITH {TAPE_SQL}, h AS (SELECT channel, ts_us // {DAY} AS day, (ts_us % {DAY}) // {HOUR} AS step, arg_max(value, (ts_us, seq)) AS px FROM tape GROUP BY 1, 2, 3), e AS (SELECT channel, day, arg_min(px, step) AS entry, max(step) AS fin FROM h GROUP BY 1, 2),
    g AS (SELECT * FROM (VALUES ('stop20', 0.2, NULL, 23), ('stop20_take50', 0.2, 0.5, 23), ('clock12', NULL, NULL, 12), ('take100_12', NULL, 1.0, 12)) v(rule, stop, target, cap)),
    x AS (SELECT h.channel, h.day, rule, cap, fin, step, (px - entry) / entry AS ret, stop, target FROM h JOIN e USING (channel, day), g WHERE step <= cap),
    a AS (SELECT channel, day, rule, any_value(cap) AS cap, any_value(fin) AS fin, arg_min(ret, step) FILTER (WHERE ret <= -stop OR ret >= target) AS hit, arg_max(ret, step) AS lastr, max(step) AS ls FROM x GROUP BY 1, 2, 3)
    SELECT channel, day, rule, round(100 * CASE WHEN hit IS NOT NULL THEN hit WHEN least(cap, fin) - ls <= 2 THEN lastr END, 4) AS return_pct, hit IS NOT NULL AS triggered FROM a""",
)
def exit_rule_grid(spark, sf):
    h = tape(spark, sf).groupBy("channel", F.expr(f"ts_us div {DAY}").alias("day"), F.expr(f"(ts_us % {DAY}) div {HOUR}").alias("step")).agg(
        F.max_by("value", F.struct("ts_us", "seq")).alias("px")
    )
    e = h.groupBy("channel", "day").agg(F.min_by("px", "step").alias("entry"))
    rules = [("stop20", 0.2, None, 23), ("stop20_take50", 0.2, 0.5, 23), ("clock12", None, None, 12), ("take100_12", None, 1.0, 12)]
    out = R.exit_rules(h.join(e, ["channel", "day"]), ["channel", "day"], "step", "px", "entry", rules)
    return out.withColumn("return_pct", F.round("return_pct", 4))


@query(
    "peak_timing",
    f"""WITH {TAPE_SQL}, h AS (SELECT channel, ts_us // {DAY} AS day, (ts_us % {DAY}) // {HOUR} AS step, arg_max(value, (ts_us, seq)) AS px FROM tape GROUP BY 1, 2, 3), p AS (SELECT channel, day, arg_min(step, (-px, step)) AS peak_step, min(step) AS first_step FROM h GROUP BY 1, 2)
    SELECT channel, count(*) AS sessions, round(avg(peak_step - first_step), 6) AS mean_time_to_peak, count(CASE WHEN peak_step >= 12 THEN 1 END) AS late_peaks FROM p GROUP BY 1""",
)
def peak_timing(spark, sf):
    h = tape(spark, sf).groupBy("channel", F.expr(f"ts_us div {DAY}").alias("day"), F.expr(f"(ts_us % {DAY}) div {HOUR}").alias("step")).agg(
        F.max_by("value", F.struct("ts_us", "seq")).alias("px")
    )
    p = h.groupBy("channel", "day").agg(F.min_by("step", F.struct(-F.col("px"), F.col("step"))).alias("peak"), F.min("step").alias("first"))
    return p.groupBy("channel").agg(
        F.count(F.lit(1)).alias("sessions"), F.round(F.avg(F.col("peak") - F.col("first")), 6).alias("mean_time_to_peak"),
        F.count(F.when(F.col("peak") >= 12, 1)).alias("late_peaks"),
    )


@query(
    "first_and_last_half_returns",
    f"""WITH {TAPE_SQL}, c AS (SELECT channel, ts_us // {DAY} AS day, arg_min(value, (ts_us, seq)) AS op, arg_max(value, (ts_us, seq)) FILTER (WHERE ts_us % {DAY} <= {6 * HOUR}) AS a, arg_max(value, (ts_us, seq)) FILTER (WHERE ts_us % {DAY} <= {18 * HOUR}) AS b, arg_max(value, (ts_us, seq)) AS cl FROM tape GROUP BY 1, 2),
    r AS (SELECT *, a / op - 1 AS first_r, cl / b - 1 AS last_r FROM c WHERE a IS NOT NULL AND b IS NOT NULL)
    SELECT channel, count(*) AS sessions, count(CASE WHEN sign(first_r) = sign(last_r) THEN 1 END) AS agree, round(avg(sign(first_r) * last_r), 6) AS sign_rule_mean, round(corr(first_r, last_r), 6) AS correlation FROM r GROUP BY 1""",
)
def first_and_last_half_returns(spark, sf):
    rows = tape(spark, sf).withColumn("day", F.expr(f"ts_us div {DAY}")).withColumn("clock", F.expr(f"ts_us % {DAY}"))
    order = F.struct("ts_us", "seq")

    def at(limit):
        return F.max_by("value", F.when(F.col("clock") <= limit, order))

    c = rows.groupBy("channel", "day").agg(
        F.min_by("value", order).alias("op"), at(6 * HOUR).alias("a"), at(18 * HOUR).alias("b"), F.max_by("value", order).alias("cl")
    ).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    f, l = divide("a", "op") - 1, divide("cl", "b") - 1
    return c.groupBy("channel").agg(
        F.count(F.lit(1)).alias("sessions"), F.count(F.when(sign(f) == sign(l), 1)).alias("agree"),
        F.round(F.avg(sign(f) * l), 6).alias("sign_rule_mean"), F.round(F.corr(f, l), 6).alias("correlation"),
    )


@query(
    "slices_by_year_and_weekday",
    """SELECT year(o_orderdate) AS year, dayofweek(o_orderdate) AS weekday, grouping(year(o_orderdate), dayofweek(o_orderdate)) AS level, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd FROM orders GROUP BY GROUPING SETS ((), (year(o_orderdate)), (dayofweek(o_orderdate)))""",
)
def slices_by_year_and_weekday(spark, sf):
    o = table(spark, sf, "orders").select(
        F.year("o_orderdate").cast("long").alias("year"), (F.dayofweek("o_orderdate") - 1).cast("long").alias("weekday"), "o_totalprice"
    )
    return o.groupingSets([[], ["year"], ["weekday"]], "year", "weekday").agg(
        F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"),
        F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd"),
    )
