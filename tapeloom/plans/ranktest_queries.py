"""Rank tests, Fisher's exact test, joint F tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranktests as R
from .bindings import TAPE_SQL, slices_for, tape
from .learning_queries import LINES_SQL, lines
from .registry import query


def _tail(z: str) -> str:
    """Two-sided normal tail in SQL: the power series of the error function."""
    return f"CASE WHEN abs({z}) > 5.5 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda k: (-1) ** k * exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300) / sqrt(2)) - lgamma(k + 1)) / (2 * k + 1))) END"


# Values in tenths have many ties; 50 is the middle of the tape.
SIZES_SQL = f"{TAPE_SQL}, v AS (SELECT channel, seq, round(value - 50, 0) AS v FROM tape)"


def sizes(spark, sf):
    return tape(spark, sf).select("channel", "seq", F.round(F.col("value") - 50, 0).alias("v"))


@query(
    "wilcoxon_signed_rank",
    f"""WITH {SIZES_SQL}, r AS (SELECT channel, v, rank() OVER (PARTITION BY channel ORDER BY abs(v)) + (count(*) OVER (PARTITION BY channel, abs(v)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY channel, abs(v)) AS t FROM v WHERE v <> 0),
    s AS (SELECT channel, count(*) AS n, coalesce(sum(r) FILTER (WHERE v > 0), 0) AS wp, coalesce(sum(r) FILTER (WHERE v < 0), 0) AS wm, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY 1),
    z AS (SELECT *, (least(wp, wm) - CAST(n AS DOUBLE) * (n + 1) / 4) / sqrt((CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM s), o AS (SELECT channel, count(*) FILTER (WHERE v = 0) AS zeros FROM v GROUP BY 1)
    SELECT channel, n, zeros, wp AS w_plus, wm AS w_minus, least(wp, wm) AS statistic, round(z, 6) AS z, round({_tail("z")}, 6) AS p_value FROM z JOIN o USING (channel)""",
)
def wilcoxon_signed_rank(spark, sf):
    rows = sizes(spark, sf)
    cuts = slices_for(spark, sf, "tape.size", rows.select(F.abs("v").alias("__size")), "__size")
    out = R.wilcoxon_signed_rank(rows, ["channel"], "v", cuts)
    return out.withColumn("z", F.round("z", 6)).withColumn("p_value", F.round("p_value", 6))


@query(
    "mann_whitney",
    f"""WITH {SIZES_SQL}, r AS (SELECT channel, seq % 3 = 0 AS f, rank() OVER (PARTITION BY channel ORDER BY v) + (count(*) OVER (PARTITION BY channel, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY channel, v) AS t FROM v),
    s AS (SELECT channel, count(*) FILTER (WHERE f) AS n1, count(*) FILTER (WHERE NOT f) AS n2, CAST(sum(r) FILTER (WHERE f) AS DOUBLE) - CAST(count(*) FILTER (WHERE f) AS DOUBLE) * (count(*) FILTER (WHERE f) + 1) / 2 AS u1, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY 1),
    z AS (SELECT *, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))) AS z FROM s)
    SELECT channel, n1, n2, u1, n1 * n2 - u1 AS u2, round(z, 6) AS z, round(u1 / (n1 * n2), 6) AS superiority, round(CASE WHEN z <= 0 THEN 1 ELSE {_tail("z")} END, 6) AS p_value FROM z""",
)
def mann_whitney(spark, sf):
    """Every third print against the others."""
    rows = sizes(spark, sf)
    out = R.mann_whitney(rows, ["channel"], "v", F.col("seq") % 3 == 0, slices_for(spark, sf, "tape.v", rows, "v"))
    return out.select("channel", "n1", "n2", "u1", "u2", *[F.round(c, 6).alias(c) for c in ("z", "superiority", "p_value")])


@query(
    "fisher_exact",
    f"""WITH {TAPE_SQL}, t AS (SELECT channel, count(*) FILTER (WHERE x AND y) AS a, count(*) FILTER (WHERE x AND NOT y) AS b, count(*) FILTER (WHERE NOT x AND y) AS c, count(*) FILTER (WHERE NOT x AND NOT y) AS d FROM (SELECT channel, value > 80 AS x, instrument_id % 2 = 0 AS y FROM tape) GROUP BY 1),
    l AS (SELECT *, unnest(range(greatest(0, 2 * a + b + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS k FROM t),
    p AS (SELECT channel, a, b, c, d, k, lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) AS lp FROM l),
    q AS (SELECT *, max(lp) FILTER (WHERE k = a) OVER (PARTITION BY channel) AS own FROM p)
    SELECT channel, a, b, c, d, round(CASE WHEN b * c > 0 THEN a * d / CAST(b * c AS DOUBLE) END, 6) AS odds_ratio, round(least(1, sum(exp(lp)) FILTER (WHERE lp <= own + 1e-7)), 6) AS p_value FROM q GROUP BY channel, a, b, c, d""",
)
def fisher_exact(spark, sf):
    """Large prints by even instruments."""
    out = R.fisher_exact(tape(spark, sf), ["channel"], F.col("value") > 80, F.col("instrument_id") % 2 == 0)
    return out.withColumn("odds_ratio", F.round("odds_ratio", 6)).withColumn("p_value", F.round("p_value", 6))


@query(
    "joint_f_test",
    f"""WITH {LINES_SQL}, m AS (SELECT g, count(*) AS n, var_pop(y) AS vy, corr(x1, y) AS r1, regr_intercept(y, x1) AS i, regr_slope(y, x1) AS b, {", ".join(f"covar_pop({a}, {b}) AS c_{a}_{b}" for a, b in (("x1", "x1"), ("x1", "x2"), ("x1", "x3"), ("x2", "x2"), ("x2", "x3"), ("x3", "x3"), ("x1", "y"), ("x2", "y"), ("x3", "y")))} FROM l GROUP BY 1),
    e AS (SELECT *, c_x2_x2 - c_x1_x2 ** 2 / c_x1_x1 AS a, c_x2_x3 - c_x1_x2 * c_x1_x3 / c_x1_x1 AS o, c_x3_x3 - c_x1_x3 ** 2 / c_x1_x1 AS d, c_x2_y - c_x1_x2 * c_x1_y / c_x1_x1 AS p, c_x3_y - c_x1_x3 * c_x1_y / c_x1_x1 AS q FROM m),
    f AS (SELECT g, n, r1 * r1 AS reduced, r1 * r1 + (p * (p * d - q * o) + q * (q * a - p * o)) / (a * d - o * o) / vy AS full_ FROM e)
    SELECT g, CAST(n AS DOUBLE) AS n, round(full_, 8) AS r2_full, round(reduced, 8) AS r2_reduced, round((full_ - reduced) / 2 / ((1 - full_) / (n - 4)), 5) AS f, round((1 + 2 * ((full_ - reduced) / 2 / ((1 - full_) / (n - 4))) / (n - 4)) ** (-(n - 4) / 2.0), 6) AS p_value FROM f""",
)
def joint_f_test(spark, sf):
    """Whether discount and tax add to quantity; with two tested features the tail has a closed form."""
    out = R.joint_f_test(lines(spark, sf), ["g"], ["x1", "x2", "x3"], ["x2", "x3"], "y")
    return out.select("g", "n", F.round("r2_full", 8).alias("r2_full"), F.round("r2_reduced", 8).alias("r2_reduced"), F.round("f", 5).alias("f"), F.round("p_value", 6).alias("p_value"))
