"""Streaming queries over the events table, run to the end of what is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_folder
from ..streaming import feeds, stateful
from .asof_queries import PRINTS_SQL
from .bindings import DAY, HOUR, TAPE_SQL, TICK, table
from .registry import query


def live(spark, sf):
    """The events table, one file or a folder of files, followed as a stream; ``at`` is the event time."""
    schema = table(spark, sf, "events").schema
    # A pattern, as a stream takes a plain path for a folder.
    rows = feeds.follow_parquet(spark, f"{sf}/event[s].parquet", schema, files_per_trigger=int(spark.conf.get("spark.tapeloom.filesPerTrigger", "64")))
    at = F.col("ts").cast("timestamp")
    return rows.select(
        F.col("user_id").alias("instrument_id"), F.col("event_id").alias("seq"), F.unix_micros(at).alias("ts_us"), at.alias("at"),
        F.col("event_type").alias("channel"), "value",
    )


def drain(spark, stream, mode="update"):
    """Run a stream to the end of the available input; returns the output folder."""
    out, checkpoint = scratch_folder(spark, "out"), scratch_folder(spark, "state")
    spark.conf.set("spark.sql.streaming.stopTimeout", "60s")
    feeds.run_available(stream, out, checkpoint, mode)
    return out


@query(
    "stream_latest_per_instrument",
    f"WITH {TAPE_SQL} SELECT instrument_id, max(seq) AS seq, arg_max(channel, seq) AS channel, arg_max(value, seq) AS value, count(*) - 1 AS coalesced FROM tape GROUP BY 1",
)
def stream_latest_per_instrument(spark, sf):
    out = drain(spark, feeds.latest_value(live(spark, sf), ["instrument_id"], ["seq"], ["seq", "channel", "value"]))
    final = feeds.last_update(spark, out, ["instrument_id"])
    return final.select("instrument_id", "latest.seq", "latest.channel", "latest.value", "coalesced")


@query(
    "stream_tumbling_windows",
    f"WITH {TAPE_SQL} SELECT channel, ts_us // {6 * HOUR} * {6 * HOUR} AS window_start, count(*) AS rows, round(sum(value), 4) AS total FROM tape GROUP BY 1, 2",
)
def stream_tumbling_windows(spark, sf):
    agg = feeds.window_counts(live(spark, sf), "at", "1 day", "6 hours", None, ["channel"], "value")
    out = drain(spark, agg.select(F.unix_micros("w.start").alias("window_start"), "channel", "rows", "total"))
    return feeds.last_update(spark, out, ["channel", "window_start"]).withColumn("total", F.round("total", 4))


@query(
    "stream_sliding_windows",
    f"WITH {TAPE_SQL}, w AS (SELECT channel, unnest([ts_us // {6 * HOUR} * {6 * HOUR}, ts_us // {6 * HOUR} * {6 * HOUR} - {6 * HOUR}]) AS window_start, value FROM tape) SELECT channel, window_start, count(*) AS rows, round(sum(value), 4) AS total FROM w GROUP BY 1, 2",
)
def stream_sliding_windows(spark, sf):
    agg = feeds.window_counts(live(spark, sf), "at", "1 day", "12 hours", "6 hours", ["channel"], "value")
    out = drain(spark, agg.select(F.unix_micros("w.start").alias("window_start"), "channel", "rows", "total"))
    return feeds.last_update(spark, out, ["channel", "window_start"]).withColumn("total", F.round("total", 4))


@query(
    "stream_feed_health",
    f"WITH {TAPE_SQL}, n AS (SELECT max(ts_us) AS now FROM tape), l AS (SELECT instrument_id, max(ts_us) AS t FROM tape GROUP BY 1), s AS (SELECT CASE WHEN now - t > {3 * DAY} THEN 'dead' WHEN now - t > {DAY} THEN 'slow' ELSE 'live' END AS state, now - t AS age FROM l, n) SELECT state, count(*) AS instruments, max(age) AS worst_age_us FROM s GROUP BY 1",
)
def stream_feed_health(spark, sf):
    out = drain(spark, feeds.latest_value(live(spark, sf), ["instrument_id"], ["seq"], ["ts_us"]))
    latest = feeds.last_update(spark, out, ["instrument_id"]).select("instrument_id", F.col("latest.ts_us").alias("t"))
    now = latest.agg(F.max("t").alias("now"))
    aged = feeds.feed_health(latest.crossJoin(F.broadcast(now)), F.col("now"), "t", DAY, 3 * DAY)
    return aged.groupBy("state").agg(F.count(F.lit(1)).alias("instruments"), F.max("age_us").alias("worst_age_us"))


@query(
    "stream_tick_classification",
    f"""WITH {PRINTS_SQL}, s AS (SELECT *, lag(price) OVER w AS p0, lag(cumulative_volume) OVER w AS v0 FROM prints WINDOW w AS (PARTITION BY instrument_id ORDER BY ts_us, seq)),
    d AS (SELECT *, last_value(CASE WHEN price <> p0 THEN p0 END IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS q FROM s)
    SELECT instrument_id, seq, cumulative_volume - v0 AS volume_increment, CASE WHEN q IS NULL THEN 'unclassified' WHEN price > q THEN 'buy' ELSE 'sell' END AS tick_side FROM d WHERE cumulative_volume > v0""",
)
def stream_tick_classification(spark, sf):
    seq = F.col("seq")
    prints = live(spark, sf).where(F.col("channel").isin("purchase", "signup")).select(
        "instrument_id", "seq", "ts_us",
        ((1000 + F.floor(F.col("value") / 20) + seq % 5 - 2).cast("double") * F.lit(TICK)).alias("price"),
        F.when(seq % 37 == 0, seq * 10 - 5000).otherwise(seq * 10).alias("cumulative_volume"),
    )
    out = drain(spark, stateful.tick_classifier(prints, "instrument_id"), "append")
    return spark.read.parquet(out).select("instrument_id", "seq", "volume_increment", "tick_side")


@query(
    "stream_decayed_mean",
    f"""WITH RECURSIVE {TAPE_SQL}, o AS (SELECT instrument_id, seq, ts_us, value, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_us, seq) AS rn FROM tape),
    r AS (SELECT instrument_id, seq, ts_us, rn, value AS m FROM o WHERE rn = 1 UNION ALL SELECT o.instrument_id, o.seq, o.ts_us, o.rn, CASE WHEN o.ts_us - r.ts_us > {2 * DAY} THEN o.value ELSE pow(0.5, (o.ts_us - r.ts_us) / {float(6 * HOUR)}) * r.m + (1 - pow(0.5, (o.ts_us - r.ts_us) / {float(6 * HOUR)})) * o.value END FROM r JOIN o ON o.instrument_id = r.instrument_id AND o.rn = r.rn + 1)
    SELECT instrument_id, seq, round(m, 6) AS smoothed FROM r""",
)
def stream_decayed_mean(spark, sf):
    rows = live(spark, sf).select("instrument_id", "seq", "ts_us", "value")
    out = drain(spark, stateful.decayed_mean(rows, "instrument_id", "value", 6 * HOUR, 2 * DAY), "append")
    return spark.read.parquet(out).select("instrument_id", "seq", F.round("smoothed", 6).alias("smoothed"))


@query(
    "stream_signal_episodes",
    f"""WITH RECURSIVE {TAPE_SQL}, s AS (SELECT instrument_id, ts_us, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_us, seq) AS rn, value BETWEEN 35 AND 45 AS z,
      CASE WHEN seq % 17 = 0 THEN NULL WHEN value > 55 THEN 1 WHEN value < 25 THEN -1 ELSE 0 END AS g FROM tape),
    r AS (SELECT DISTINCT instrument_id, CAST(0 AS BIGINT) AS rn, 0 AS a_dir, CAST(0 AS BIGINT) AS a_open, CAST(0 AS BIGINT) AS a_conf, 0 AS shut, 0 AS astray, 0 AS p_dir, CAST(0 AS BIGINT) AS p_open, 0 AS p_n,
        CAST(NULL AS VARCHAR) AS outcome, CAST(0 AS BIGINT) AS o_open, CAST(0 AS BIGINT) AS o_conf, CAST(0 AS BIGINT) AS ended FROM s
      UNION ALL SELECT instrument_id, rn, CASE WHEN still THEN a_dir WHEN pn >= 2 THEN q ELSE 0 END, CASE WHEN still THEN a_open ELSE po END, CASE WHEN still THEN a_conf ELSE ts_us END,
        CASE WHEN still THEN t1 ELSE 0 END, CASE WHEN still THEN c1 ELSE 0 END, CASE WHEN still OR pn >= 2 THEN 0 ELSE q END, po, CASE WHEN pn >= 2 THEN 0 ELSE pn END, done, a_open, a_conf, ts_us
      FROM (SELECT *, CASE WHEN still OR q = 0 THEN 0 WHEN p_dir = q THEN p_n + 1 ELSE 1 END AS pn, CASE WHEN p_dir = q AND q <> 0 THEN p_open ELSE ts_us END AS po
        FROM (SELECT *, a_dir <> 0 AND done IS NULL AS still, coalesce(g, 0) AS q
          FROM (SELECT *, CASE WHEN a_dir = 0 THEN NULL WHEN g IS NULL THEN 'censored' WHEN t1 >= 2 THEN 'corrected' WHEN c1 >= 2 THEN 'invalidated' END AS done
            FROM (SELECT r.*  EXCLUDE (rn), s.rn, s.ts_us, s.g, CASE WHEN s.z THEN shut + 1 ELSE 0 END AS t1, CASE WHEN s.g = a_dir THEN 0 ELSE astray + 1 END AS c1 FROM r JOIN s ON s.instrument_id = r.instrument_id AND s.rn = r.rn + 1)))))
    SELECT instrument_id, o_open AS opened_ts, o_conf AS confirmed_ts, ended AS closed_ts, outcome FROM r WHERE outcome IS NOT NULL""",
)
def stream_signal_episodes(spark, sf):
    value, seen = F.col("value"), F.col("seq") % 17 != 0
    signal = F.when(seen, F.when(value > 55, 1.0).when(value < 25, -1.0).otherwise(0.0))
    rows = live(spark, sf).select("instrument_id", "seq", "ts_us", signal.alias("signal"), value.between(35, 45).alias("shut"))
    return spark.read.parquet(drain(spark, stateful.episode_machine(rows, "instrument_id", "signal", "shut", 2, 2), "append")).drop("batch")


@query(
    "stream_forecast_maturity",
    f"""WITH {TAPE_SQL}, p AS (SELECT instrument_id, ts_us, arg_max(value, seq) AS v FROM tape WHERE channel = 'view' GROUP BY 1, 2), c AS (SELECT instrument_id, max(ts_us) AS upto FROM p GROUP BY 1),
    f AS (SELECT instrument_id, seq, ts_us + {HOUR} AS t0, ts_us + {12 * HOUR} AS t1 FROM tape WHERE channel = 'signup')
    SELECT f.instrument_id, f.seq AS issued_seq, round(b.v - a.v, 6) AS realised FROM f JOIN c ON c.instrument_id = f.instrument_id AND c.upto >= f.t1
    ASOF JOIN p a ON a.instrument_id = f.instrument_id AND a.ts_us <= f.t0 ASOF JOIN p b ON b.instrument_id = f.instrument_id AND b.ts_us <= f.t1""",
)
def stream_forecast_maturity(spark, sf):
    rows = live(spark, sf).where(F.col("channel").isin("signup", "view")).select("instrument_id", "seq", "ts_us", "value", (F.col("channel") == "signup").alias("forecast"))
    out = drain(spark, stateful.settle_forecasts(rows, "instrument_id", HOUR, 12 * HOUR), "append")
    return spark.read.parquet(out).select("instrument_id", "issued_seq", F.round("realised", 6).alias("realised"))


@query(
    "stream_deduplicated_updates",
    f"WITH {TAPE_SQL} SELECT count(*) AS updates, CAST(sum(id) AS BIGINT) AS id_sum FROM (SELECT DISTINCT instrument_id * 100000 + ts_us // {6 * HOUR} AS id FROM tape)",
)
def stream_deduplicated_updates(spark, sf):
    ids = live(spark, sf).select((F.col("instrument_id") * 100000 + F.expr(f"ts_us div {6 * HOUR}")).alias("id"), "at")
    out = drain(spark, feeds.drop_repeats(ids, "at", "60 days", ["id"]), "append")
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("updates"), F.sum("id").alias("id_sum"))


REFRESH, STRIKES, IDLE = 12 * HOUR, 12, 2 * DAY


@query(
    "stream_surface_refresh",
    f"""WITH {TAPE_SQL}, r AS (SELECT channel, seq, ts_us, instrument_id % {STRIKES} AS strike, value AS y, lag(ts_us) OVER w AS before, -(-ts_us // {REFRESH}) * {REFRESH} AS g FROM tape WINDOW w AS (PARTITION BY channel ORDER BY ts_us, seq)),
    c AS (SELECT *, sum(CASE WHEN before IS NULL OR ts_us - before > {IDLE} THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY ts_us, seq) AS life, CAST(ceil(ts_us / CAST({REFRESH} AS DOUBLE)) AS BIGINT) * {REFRESH} AS grid FROM r),
    t AS (SELECT channel, grid, any_value(life) AS life, count(DISTINCT strike) AS changed FROM c GROUP BY 1, 2), m AS (SELECT channel, max(ts_us) AS til FROM c GROUP BY 1),
    k AS (SELECT t.channel, t.grid, t.changed, c.strike, arg_max(c.y, (c.ts_us, c.seq)) AS y FROM t JOIN m ON m.channel = t.channel AND t.grid < m.til JOIN c ON c.channel = t.channel AND c.ts_us <= t.grid AND c.life = t.life GROUP BY 1, 2, 3, 4),
    a AS (SELECT channel, grid, any_value(changed) AS changed, count(*) AS n, avg(strike) AS mx, avg(y) AS my, covar_pop(strike, y) AS xy, var_pop(strike) AS xx FROM k GROUP BY 1, 2),
    b AS (SELECT k.channel, k.grid, avg((strike - mx) ** 3) AS m3, avg((strike - mx) ** 4) AS m4, avg((strike - mx) ** 2 * (y - my)) AS m2y FROM k JOIN a ON a.channel = k.channel AND a.grid = k.grid GROUP BY 1, 2),
    q AS (SELECT a.*, (m2y * xx - xy * m3) / (xx * (m4 - xx * xx) - m3 * m3) AS cur, (xy * (m4 - xx * xx) - m2y * m3) / (xx * (m4 - xx * xx) - m3 * m3) AS slo FROM a JOIN b ON a.channel = b.channel AND a.grid = b.grid)
    SELECT channel, grid AS fit_ts, n AS members, changed, CASE WHEN n >= 3 THEN 'fit' ELSE 'too_few_members' END AS status, CASE WHEN n >= 3 THEN round(my - cur * xx - slo * mx + cur * mx * mx, 5) END AS level, CASE WHEN n >= 3 THEN round(slo - 2 * cur * mx, 5) END AS slope, CASE WHEN n >= 3 THEN round(cur, 5) END AS curvature FROM q""",
)
def stream_surface_refresh(spark, sf):
    """A parabola over the latest value of each strike of a channel, refitted twice a day where one changed."""
    rows = live(spark, sf).select("channel", "seq", "ts_us", "at", (F.col("instrument_id") % STRIKES).alias("strike"), "value")
    rows = rows.withColumn("x", F.col("strike").cast("double"))
    fits = stateful.refresh_fits(rows, "channel", "strike", "x", "value", every_us=REFRESH, idle_us=IDLE, watermark="1 hour", at="at")
    out = spark.read.parquet(drain(spark, fits, "append"))
    return out.select("channel", "fit_ts", "members", "changed", "status", *[F.round(c, 5).alias(c) for c in ("level", "slope", "curvature")])
