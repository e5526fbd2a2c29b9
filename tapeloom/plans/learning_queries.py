"""Walk-forward selection, time-varying coefficients, past neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import walkforward as W
from ..operators.kalman import kalman_path
from ..operators.past_neighbours import past_neighbours
from .bindings import HOUR, TAPE_SQL, micros, slices_for, table, tape, time_slices
from .registry import query
from .state_queries import grid, slot_slices

# ---- nested walk-forward: an order line is an observation, its ship date the session ----------------

LINES_SQL = "l AS (SELECT l_returnflag AS g, epoch_us(l_shipdate) AS day, l_quantity AS x1, l_discount AS x2, l_tax AS x3, l_extendedprice / 1000 AS y FROM lineitem)"


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("g"), micros("l_shipdate").alias("day"), F.col("l_quantity").alias("x1"),
        F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"), (F.col("l_extendedprice") / 1000).alias("y"),
    )


CANDIDATES = (
    W.Candidate("quantity", ("x1",)), W.Candidate("quantity, shrunk", ("x1",), 200.0), W.Candidate("discount", ("x2",)),
    W.Candidate("both", ("x1", "x2")), W.Candidate("both, shrunk", ("x1", "x2"), 200.0), W.Candidate("tax", ("x3",), 0.0, 0.1, True),
)
FOLDS, INNER, FIRST, EMBARGO = 4, 3, 60, 2
ALPHAS = (0.0, 500.0, 5000.0)

# Sessions are numbered; a train side is all sessions up to one, a test side those between two.
_SESSIONS = f"""{LINES_SQL}, s AS (SELECT g, day, row_number() OVER (PARTITION BY g ORDER BY day) AS i FROM (SELECT DISTINCT g, day FROM l)), r AS (SELECT l.*, i FROM l JOIN s USING (g, day)), n AS (SELECT g, max(i) AS n FROM s GROUP BY 1),
p AS (SELECT g, n, fold, {FIRST} + fold * greatest((n - {FIRST}) // {FOLDS}, 1) AS a, CASE WHEN fold = {FOLDS - 1} THEN n ELSE least(n, {FIRST} + (fold + 1) * greatest((n - {FIRST}) // {FOLDS}, 1)) END AS b FROM n, range({FOLDS}) t(fold)),
f AS (SELECT *, a - {EMBARGO} AS known FROM p WHERE a < n)"""


def _fit_sql(candidates: str, key: str) -> str:
    """Standardised ridge on one or two features from the moments of a train side (rows ``t``)."""
    return f"""m AS (SELECT {key}, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, stddev_pop(x3) AS s3, corr(x1, x2) AS r12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, covar_pop(x3, y) AS c3 FROM t GROUP BY ALL),
c(candidate, one, two, three, alpha) AS (VALUES {candidates}),
h AS (SELECT {key}, candidate, n, my, m1, m2, m3, s1, s2, s3, one, two, three, 1 + alpha / n AS d, CASE WHEN one AND two THEN r12 ELSE 0 END AS o, CASE WHEN one THEN c1 / s1 ELSE 0 END AS p1, CASE WHEN two THEN c2 / s2 ELSE 0 END AS p2, CASE WHEN three THEN c3 / s3 ELSE 0 END AS p3 FROM m, c),
k AS (SELECT {key}, candidate, n, my, (d * p1 - o * p2) / (d * d - o * o) / s1 AS b1, (d * p2 - o * p1) / (d * d - o * o) / s2 AS b2, p3 / d / s3 AS b3, my - (d * p1 - o * p2) / (d * d - o * o) / s1 * m1 - (d * p2 - o * p1) / (d * d - o * o) / s2 * m2 - p3 / d / s3 * m3 AS b0 FROM h)"""


@query(
    "nested_walk_forward",
    f"""WITH {_SESSIONS}, w AS (SELECT *, CAST(floor(known * (1 - 0.3)) AS BIGINT) AS cut FROM f), t AS (SELECT w.g, fold, x1, x2, x3, y FROM r JOIN w ON r.g = w.g AND i <= greatest(cut - {EMBARGO}, 0)),
    {_fit_sql(", ".join(f"('{c.name}', {'x1' in c.features}, {'x2' in c.features}, {'x3' in c.features}, {c.alpha})" for c in CANDIDATES), "g, fold")},
    v AS (SELECT k.g, k.fold, candidate, any_value(k.n) AS train_n, count(*) FILTER (WHERE i > a) AS support, corr(y, b0 + b1 * x1 + b2 * x2 + b3 * x3) FILTER (WHERE i > cut AND i <= known) AS validation_score, corr(y, b0 + b1 * x1 + b2 * x2 + b3 * x3) FILTER (WHERE i > a) AS outer_score FROM k JOIN w ON k.g = w.g AND k.fold = w.fold JOIN r ON r.g = k.g AND i > cut AND i <= b GROUP BY 1, 2, 3),
    q AS (SELECT *, abs(validation_score) >= max(abs(validation_score)) OVER (PARTITION BY g, fold, candidate = 'tax') * 0.9 AS selected FROM v)
    SELECT g, CAST(fold AS INTEGER) AS fold, candidate, CAST(train_n AS DOUBLE) AS train_n, CAST(support AS DOUBLE) AS support, round(validation_score, 6) AS validation_score, round(outer_score, 6) AS outer_score, selected,
    round(CASE WHEN selected THEN abs(validation_score) / sum(abs(validation_score)) FILTER (WHERE selected) OVER (PARTITION BY g, fold, candidate = 'tax') ELSE 0 END, 6) AS weight FROM q""",
)
def nested_walk_forward(spark, sf):
    """Six candidates for the price of a line, selected on inner and judged on outer sessions."""
    rows = lines(spark, sf)
    out = W.nested_walk_forward(
        rows, ["g"], "day", ["x1", "x2", "x3"], "y", CANDIDATES, slices_for(spark, sf, "lines.day", rows, "day"), folds=FOLDS, minimum_sessions=FIRST, embargo=EMBARGO
    )
    return out.select("g", "fold", "candidate", "train_n", "support", "selected", *[F.round(c, 6).alias(c) for c in ("validation_score", "outer_score", "weight")])


@query(
    "penalty_by_inner_folds",
    f"""WITH {_SESSIONS}, e AS (SELECT g, fold, a, b, known, j, CAST(floor(known * ({INNER} + j) / {2.0 * INNER}) AS BIGINT) AS lo, CAST(floor(known * ({INNER} + j + 1) / {2.0 * INNER}) AS BIGINT) AS hi FROM f, range({INNER}) t(j)),
    w AS (SELECT g, fold, j, greatest(lo - {EMBARGO}, 0) AS upto, lo, hi FROM e UNION ALL SELECT g, fold, -1, known, a, b FROM f), t AS (SELECT w.g, fold, j, x1, x2, x3, y FROM r JOIN w ON r.g = w.g AND i <= upto),
    {_fit_sql(", ".join(f"('{a}', true, true, false, {a})" for a in ALPHAS), "g, fold, j")},
    z AS (SELECT k.g, k.fold, k.j, candidate, count(*) AS n, sum((y - b0 - b1 * x1 - b2 * x2) ^ 2) AS sse, sum((y - my) ^ 2) AS sst FROM k JOIN w ON k.g = w.g AND k.fold = w.fold AND k.j = w.j JOIN r ON r.g = k.g AND i > lo AND i <= hi GROUP BY 1, 2, 3, 4),
    u AS (SELECT g, fold, candidate, sum(sse) FILTER (WHERE j >= 0) AS sse, sum(sst) FILTER (WHERE j >= 0) AS sst, max(n) FILTER (WHERE j < 0) AS test_n, max(1 - sse / sst) FILTER (WHERE j < 0) AS outer_r2 FROM z GROUP BY 1, 2, 3)
    SELECT g, CAST(fold AS INTEGER) AS fold, CAST(candidate AS DOUBLE) AS alpha, round(1 - sse / sst, 6) AS inner_r2, sse = min(sse) OVER (PARTITION BY g, fold) AS chosen, CAST(test_n AS DOUBLE) AS test_n, round(outer_r2, 6) AS outer_r2 FROM u""",
)
def penalty_by_inner_folds(spark, sf):
    rows = lines(spark, sf)
    out = W.penalty_by_inner_folds(
        rows, ["g"], "day", ["x1", "x2"], "y", ALPHAS, slices_for(spark, sf, "lines.day", rows, "day"), folds=FOLDS, inner=INNER, minimum_sessions=FIRST, embargo=EMBARGO
    )
    return out.select("g", "fold", "alpha", "chosen", "test_n", F.round("inner_r2", 6).alias("inner_r2"), F.round("outer_r2", 6).alias("outer_r2"))


# ---- Kalman coefficients on the hourly grid -----------------------------------------------------------

RHO, Q, NOISE, AHEAD = 0.98, 0.01, 0.5, 2


@query(
    "kalman_coefficients",
    f"""WITH RECURSIVE {TAPE_SQL}, g AS MATERIALIZED (SELECT channel, ts_us // {HOUR} AS slot, arg_max(value, (ts_us, seq)) AS v FROM tape GROUP BY 1, 2),
    d AS MATERIALIZED (SELECT a.channel, a.slot, (a.v - 50) / 25 AS z, (b.v - a.v) / 25 AS y FROM g a LEFT JOIN g b ON a.channel = b.channel AND b.slot = a.slot + {AHEAD}),
    u AS (SELECT d.channel, min(n.slot) AS pos, d.slot, z, y FROM d JOIN g n ON n.channel = d.channel AND n.slot >= d.slot + {AHEAD} + 1 AND n.slot <= d.slot + {AHEAD} + 1000 WHERE y IS NOT NULL GROUP BY ALL),
    ev AS MATERIALIZED (SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY pos, kind, slot) AS e, pos, kind, z, y FROM (SELECT channel, slot AS pos, unnest([0, 2]) AS kind, slot, z, y FROM d UNION ALL SELECT channel, pos, 1, slot, z, y FROM u)),
    k(channel, e, pos, kind, b1, b2, p11, p12, p22, prediction) AS (SELECT channel, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, NULL::DOUBLE FROM g GROUP BY 1
     UNION ALL SELECT x.channel, x.e, x.pos, x.kind,
      CASE x.kind WHEN 0 THEN {RHO} * b1 WHEN 1 THEN b1 + (p11 + p12 * z) / ((p11 + p12 * z) + z * (p12 + p22 * z) + {NOISE}) * (y - b1 - b2 * z) ELSE b1 END,
      CASE x.kind WHEN 0 THEN {RHO} * b2 WHEN 1 THEN b2 + (p12 + p22 * z) / ((p11 + p12 * z) + z * (p12 + p22 * z) + {NOISE}) * (y - b1 - b2 * z) ELSE b2 END,
      CASE x.kind WHEN 0 THEN {RHO * RHO!r} * p11 + {Q} WHEN 1 THEN p11 - (p11 + p12 * z) ** 2 / ((p11 + p12 * z) + z * (p12 + p22 * z) + {NOISE}) ELSE p11 END,
      CASE x.kind WHEN 0 THEN {RHO * RHO!r} * p12 WHEN 1 THEN p12 - (p11 + p12 * z) * (p12 + p22 * z) / ((p11 + p12 * z) + z * (p12 + p22 * z) + {NOISE}) ELSE p12 END,
      CASE x.kind WHEN 0 THEN {RHO * RHO!r} * p22 + {Q} WHEN 1 THEN p22 - (p12 + p22 * z) ** 2 / ((p11 + p12 * z) + z * (p12 + p22 * z) + {NOISE}) ELSE p22 END,
      CASE x.kind WHEN 2 THEN b1 + b2 * z END FROM k JOIN ev x ON x.channel = k.channel AND x.e = k.e + 1)
    SELECT channel, pos AS slot, round(prediction, 6) AS prediction FROM k WHERE kind = 2""",
)
def kalman_coefficients(spark, sf):
    """The change two hours ahead on level and constant, each label used once it is an hour old."""
    g = grid(spark, sf)
    # Ahead by a join on the exact slot: the grid is one row for each channel and hour.
    later = g.select("channel", (F.col("slot") - AHEAD).alias("slot"), F.col("v").alias("__later"))
    rows = g.join(later, ["channel", "slot"], "left").select(
        "channel", "slot", F.array(F.lit(1.0), (F.col("v") - 50) / 25).alias("x"), ((F.col("__later") - F.col("v")) / 25).alias("y"), (F.col("slot") + AHEAD + 1).alias("known")
    )
    out = kalman_path(rows.withColumn("tie", F.lit(0)), ["channel"], "slot", "tie", "x", "y", "known", slot_slices(spark, sf), width=2, rho=RHO, q=Q, observation_variance=NOISE)
    return out.select("channel", "slot", F.round("prediction", 6).alias("prediction"))


# ---- past neighbours ------------------------------------------------------------------------------------

NEIGHBOURS, HISTORY, LEAST, QUANTILE = 30, 200, 20, 0.91


@query(
    "past_neighbour_tails",
    f"""WITH {TAPE_SQL}, r AS (SELECT channel, seq, value / 20 AS a, (seq % 97) / 40.0 AS b, value - 50 AS v, row_number() OVER (PARTITION BY channel ORDER BY ts_us, seq) AS i FROM tape),
    d AS (SELECT x.channel, x.seq, x.i, abs(x.v) AS own, y.i AS j, abs(y.v) AS size, (y.a - x.a) * (y.a - x.a) + (y.b - x.b) * (y.b - x.b) AS d FROM r x JOIN r y ON x.channel = y.channel AND y.i < x.i AND y.i >= x.i - {HISTORY}),
    k AS (SELECT *, greatest(exp(-0.5 * d), 1e-12) AS w FROM d WHERE i > {LEAST} QUALIFY row_number() OVER (PARTITION BY channel, i ORDER BY d, j) <= {NEIGHBOURS}),
    c AS (SELECT *, sum(w) OVER (PARTITION BY channel, i ORDER BY size, j ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY channel, i) AS total FROM k),
    s AS (SELECT channel, i, min(size) FILTER (WHERE upto >= {QUANTILE} * total) AS uncertainty, (1 + coalesce(sum(w) FILTER (WHERE size >= own), 0)) / (1 + any_value(total)) AS tail_p, count(*) AS neighbour_rows, any_value(total) ^ 2 / sum(w * w) AS effective_n FROM c GROUP BY 1, 2)
    SELECT r.channel, seq, least(r.i - 1, {HISTORY}) AS history_rows, round(uncertainty, 6) AS uncertainty, round(tail_p, 6) AS tail_p, neighbour_rows, round(effective_n, 4) AS effective_n FROM r LEFT JOIN s ON r.channel = s.channel AND r.i = s.i""",
)
def past_neighbour_tails(spark, sf):
    """How unusual a print's distance from 50 is among the nearest earlier prints of its channel."""
    rows = tape(spark, sf).select("channel", "ts_us", "seq", (F.col("value") / 20).alias("a"), ((F.col("seq") % 97) / 40.0).alias("b"), (F.col("value") - 50).alias("v"))
    out = past_neighbours(
        rows, ["channel"], ["ts_us", "seq"], ("a", "b"), "v", time_slices(spark, sf),
        bandwidths=(1.0, 1.0), neighbours=NEIGHBOURS, history=HISTORY, least=LEAST, quantile=QUANTILE,
    )
    return out.select("channel", "seq", "history_rows", "neighbour_rows", F.round("uncertainty", 6).alias("uncertainty"), F.round("tail_p", 6).alias("tail_p"), F.round("effective_n", 4).alias("effective_n"))
