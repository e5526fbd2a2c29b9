"""Stationary bootstrap and permutation tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference as I
from ..operators import resampling as R
from ..operators.slices import Slices
from .bindings import DAY, HOUR, TAPE_SQL, tape, time_slices
from .registry import query

REPLICATES, MEAN_LENGTH = 40, 8

# A session is a channel's day; every place of every replicate is drawn as in the operator.
DRAWS_SQL = f"""{TAPE_SQL}, s AS (SELECT channel, ts_us // {DAY} AS day, value, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY channel, ts_us // {DAY}) AS n FROM tape WINDOW w AS (PARTITION BY channel, ts_us // {DAY} ORDER BY ts_us, seq)),
k AS (SELECT channel, day, n, p, r, '17:' || r || ':' || channel || '|' || day || ':' || p AS key FROM s, range(1, {REPLICATES + 1}) t(r)),
f AS (SELECT *, CASE WHEN p = 0 OR left(md5(key), 8) < '{(1 << 32) // MEAN_LENGTH:08x}' THEN p END AS p0, CAST('0x' || left(md5(key || ':s'), 15) AS BIGINT) % n AS start FROM k),
g AS (SELECT channel, day, n, p, r, last_value(p0 IGNORE NULLS) OVER w AS p0, last_value(CASE WHEN p0 IS NOT NULL THEN start END IGNORE NULLS) OVER w AS start FROM f WINDOW w AS (PARTITION BY channel, day, r ORDER BY p ROWS UNBOUNDED PRECEDING)),
i AS (SELECT channel, day, n, r, (start + p - p0) % n AS i FROM g)"""


def _means(spark, sf):
    rows = tape(spark, sf).withColumn("day", F.expr(f"ts_us div {DAY}"))
    return R.stationary_bootstrap_means(
        rows, ["channel"], ["day"], ["ts_us", "seq"], "value", time_slices(spark, sf), replicates=REPLICATES, mean_length=MEAN_LENGTH, seed=17
    )


@query(
    "stationary_bootstrap_means",
    f"WITH {DRAWS_SQL} SELECT i.channel, CAST(r AS INTEGER) AS replicate, count(*) AS n, round(avg(value), 6) AS mean FROM i JOIN s ON i.channel = s.channel AND i.day = s.day AND i.i = s.p GROUP BY 1, 2",
)
def stationary_bootstrap_means(spark, sf):
    return _means(spark, sf).select("channel", "replicate", "n", F.round("mean", 6).alias("mean"))


@query(
    "mean_three_ways",
    f"""WITH {DRAWS_SQL}, m AS (SELECT i.channel, r, avg(value) AS m FROM i JOIN s ON i.channel = s.channel AND i.day = s.day AND i.i = s.p GROUP BY 1, 2),
    st AS (SELECT channel, stddev_samp(m) AS se, quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper FROM m GROUP BY 1),
    o AS (SELECT channel, min(ts_us) AS t0 FROM tape GROUP BY 1), b AS (SELECT channel, CAST(floor((ts_us - t0) / {float(DAY)}) AS BIGINT) AS b, avg(value) AS m FROM tape JOIN o USING (channel) GROUP BY 1, 2), bl AS (SELECT channel, stddev_samp(m) / sqrt(count(*)) AS se FROM b GROUP BY 1),
    c AS (SELECT channel, ts_us, seq, value - avg(value) OVER (PARTITION BY channel) AS u FROM tape), l AS (SELECT *, {", ".join(f"lag(u, {k}) OVER w AS u{k}" for k in range(1, 9))} FROM c WINDOW w AS (PARTITION BY channel ORDER BY ts_us, seq)),
    nw AS (SELECT channel, count(*) AS n, sum(u * u) / count(*) + 2 * ({" + ".join(f"{1 - k / 9!r} * coalesce(sum(u * u{k}), 0)" for k in range(1, 9))}) / count(*) AS lr FROM l GROUP BY 1), a AS (SELECT channel, avg(value) AS mean FROM tape GROUP BY 1)
    SELECT channel, n, round(mean, 6) AS mean, round(sqrt(greatest(lr, 0) / n), 6) AS newey_west_se, round(bl.se, 6) AS block_se, round(st.se, 6) AS stationary_se, round(lower, 6) AS lower, round(upper, 6) AS upper FROM a JOIN nw USING (channel) JOIN bl USING (channel) JOIN st USING (channel)""",
)
def mean_three_ways(spark, sf):
    """A mean's error by Newey-West, by disjoint days and by the stationary bootstrap."""
    rows = tape(spark, sf)
    nw = I.newey_west_mean(rows, ["channel"], ["ts_us", "seq"], "value", 8, time_slices(spark, sf))
    block = I.block_means(rows, ["channel"], "ts_us", "value", DAY)
    drawn = R.replicate_interval(_means(spark, sf), ["channel"])
    out = nw.join(block, "channel").join(drawn.withColumnRenamed("standard_error", "stationary_se"), "channel")
    return out.select(
        "channel", "n", F.round("mean", 6).alias("mean"), F.round("standard_error", 6).alias("newey_west_se"),
        *[F.round(c, 6).alias(c) for c in ("block_se", "stationary_se", "lower", "upper")],
    )


@query(
    "stationary_multiplicities",
    f"""WITH {DRAWS_SQL}, c AS (SELECT channel, day, r, i, count(*) AS m FROM i GROUP BY ALL), d AS (SELECT channel, r, m, count(*) AS c FROM c GROUP BY ALL), a AS (SELECT channel, count(*) AS n FROM s GROUP BY 1),
    z AS (SELECT channel, r, n - sum(c) AS c FROM d JOIN a USING (channel) GROUP BY channel, r, n HAVING n > sum(c))
    SELECT channel, CAST(r AS INTEGER) AS replicate, m AS multiplicity, CAST(c AS BIGINT) AS rows FROM (SELECT channel, r, m, c FROM d UNION ALL SELECT channel, r, 0, c FROM z)""",
)
def stationary_multiplicities(spark, sf):
    """How many rows of a replicate are drawn how often."""
    sessions = tape(spark, sf).groupBy("channel", F.expr(f"ts_us div {DAY}").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    runs = R.stationary_runs(sessions, ["channel", "day"], REPLICATES, MEAN_LENGTH, 17)
    # Positions of a session: evenly cut, as no row has to be read for it.
    longest = sessions.agg(F.max("n")).first()[0] or 0
    cuts = Slices(tuple(float(longest * k // 4) for k in (1, 2, 3)))
    steps = R.multiplicity_steps(runs, ["channel", "day"], cuts)
    return steps.groupBy("channel", "replicate", "multiplicity").agg(F.sum(F.col("until") - F.col("position")).alias("rows")).where("rows > 0")


def _permutation_sql(strata: str, replicates: int, seed: int) -> str:
    by = f"channel{strata and ', ' + strata}"
    return f"""WITH {TAPE_SQL}, v AS (SELECT *, seq % 3 = 0 AS flag, ts_us // {6 * HOUR} % 4 AS part FROM tape),
    d AS (SELECT *, count(*) FILTER (WHERE flag) OVER (PARTITION BY {by}) AS m FROM v), k AS (SELECT channel, value, m, r, row_number() OVER (PARTITION BY {by}, r ORDER BY left(md5('{seed}:' || r || ':' || seq), 12), seq) AS place FROM d, range(1, {replicates + 1}) t(r)),
    p AS (SELECT channel, r, avg(value) FILTER (WHERE place <= m) - avg(value) FILTER (WHERE place > m) AS d FROM k GROUP BY 1, 2),
    o AS (SELECT channel, count(*) AS n, count(*) FILTER (WHERE flag) AS flagged, avg(value) FILTER (WHERE flag) - avg(value) FILTER (WHERE NOT flag) AS observed FROM v GROUP BY 1)
    SELECT channel, n, flagged, round(any_value(observed), 6) AS observed, count(*) FILTER (WHERE abs(d) >= abs(observed) - 1e-12) AS exceed, count(d) AS replicates, round(avg(d), 6) AS null_mean, round(stddev_samp(d), 6) AS null_sd, round(count(*) FILTER (WHERE abs(d) >= abs(observed) - 1e-12) / CAST(count(d) AS DOUBLE), 6) AS p_value FROM p JOIN o USING (channel) GROUP BY 1, 2, 3"""


def _permutation(spark, sf, strata, replicates, seed):
    rows = tape(spark, sf).withColumn("flag", F.col("seq") % 3 == 0).withColumn("part", F.expr(f"ts_us div {6 * HOUR} % 4"))
    out = R.permutation_test(rows, ["channel"], "value", "flag", "seq", replicates, seed, strata)
    return out.select("channel", "n", "flagged", "exceed", "replicates", *[F.round(c, 6).alias(c) for c in ("observed", "null_mean", "null_sd", "p_value")])


@query("permutation_mean_difference", _permutation_sql("", 100, 11))
def permutation_mean_difference(spark, sf):
    """Every third row against the others, labels shuffled in the whole channel."""
    return _permutation(spark, sf, [], 100, 11)


@query("permutation_mean_difference_stratified", _permutation_sql("part", 100, 13))
def permutation_mean_difference_stratified(spark, sf):
    """The same with labels shuffled within the quarter of the day."""
    return _permutation(spark, sf, ["part"], 100, 13)
