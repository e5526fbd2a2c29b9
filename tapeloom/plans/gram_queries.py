"""Models of all 64 dimensions, usefulness of feature clusters, the nonlinear gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gate as T
from ..operators import gram as G
from ..operators.slices import ordered_scan, row_no
from ..session import cut_lineage
from .bindings import HOUR, TAPE_SQL, slices_for, table, tape, time_slices, train_until
from .registry import query

WIDTH = 64
ALPHAS, L1_RATIO = (0.02, 0.05, 0.1, 0.2), 0.5


def labelled(spark, sf):
    """All dimensions, the label as the number to forecast, blocks of vectors."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"), (F.col("vec_id") % 20).alias("block"), (F.col("vec_id") % 10 >= 7).cast("int").alias("side")
    )


def _paths(spark, sf, replicates):
    return G.elastic_net_paths(G.block_grams(labelled(spark, sf), "block", "x", "y", WIDTH), WIDTH, ALPHAS, L1_RATIO, replicates=replicates)


@query(
    "elastic_net_optimality",
    f"SELECT CAST(alpha AS DOUBLE) AS alpha, CAST(feature AS INTEGER) AS feature, true AS satisfied FROM (SELECT unnest([{', '.join(map(str, ALPHAS))}]) AS alpha), (SELECT DISTINCT unnest(range(len(embedding))) AS feature FROM embeddings)",
)
def elastic_net_optimality(spark, sf):
    """Every coefficient of every penalty meets the conditions of the minimum, checked on the rows."""
    paths = _paths(spark, sf, 0)
    return G.optimality(labelled(spark, sf), "x", "y", WIDTH, paths, L1_RATIO).select("alpha", "feature", "satisfied")


@query("elastic_net_selection_frequency")
def elastic_net_selection_frequency(spark, sf):
    """How often half samples of the blocks choose each dimension."""
    return G.selection_frequency(_paths(spark, sf, 40)).select("alpha", "feature", "frequency", "positive", F.round("coefficient", 8).alias("coefficient"))


@query(
    "logistic_optimality",
    "WITH t AS (SELECT count(*) AS n FROM embeddings WHERE label IS NOT NULL) SELECT CAST(term AS INTEGER) AS term, n, true AS flat FROM t, (SELECT 0 AS term UNION ALL SELECT DISTINCT unnest(range(len(embedding))) + 1 FROM embeddings)",
)
def logistic_optimality(spark, sf):
    """A logistic fit of large labels on all dimensions: the gradient over the rows vanishes in every term."""
    rows = labelled(spark, sf).withColumn("t", (F.col("y") >= 5).cast("double"))
    fit = G.logistic_fit(rows, "x", "t", WIDTH, 1.0)
    beta = fit["coefficients"]
    dot = F.aggregate(F.zip_with("x", F.array(*[F.lit(b) for b in beta[1:]]), lambda a, b: a * b), F.lit(beta[0]), lambda s, e: s + e)
    miss = F.col("t") - 1 / (1 + F.exp(-dot))
    long = rows.select(miss.alias("r"), F.posexplode(F.concat(F.array(F.lit(1.0)), "x")).alias("term", "v"))
    sums = long.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r") * F.col("v")).alias("g"))
    pull = F.when(F.col("term") > 0, F.get(F.array(*[F.lit(b) for b in beta]), F.col("term"))).otherwise(0.0)
    return sums.select("term", "n", (F.abs(F.col("g") - pull) < 1e-4).alias("flat"))


@query("logistic_wald")
def logistic_wald(spark, sf):
    """Coefficient, standard error and Wald z of each term of that fit."""
    rows = labelled(spark, sf).withColumn("t", (F.col("y") >= 5).cast("double"))
    fit = G.logistic_fit(rows, "x", "t", WIDTH, 1.0)
    terms = [(k, float(b), float(e), float(z)) for k, (b, e, z) in enumerate(zip(fit["coefficients"], fit["errors"] or [0.0] * (WIDTH + 1), fit["wald"] or [0.0] * (WIDTH + 1), strict=True))]
    return spark.createDataFrame(terms, "term int, coefficient double, error double, z double")


# ---- usefulness on the tape: instrument, hour and sequence features of the next value -----------------

CLUSTERS = ([0], [1, 2])
_FEATURES_SQL = f"""{TAPE_SQL}, f AS (SELECT seq, CAST(instrument_id % 7 AS DOUBLE) AS x1, CAST(ts_us // {HOUR} % 24 AS DOUBLE) AS x2, CAST(seq % 11 AS DOUBLE) AS x3, value AS y, ts_us <= (SELECT min(ts_us) + (max(ts_us) - min(ts_us)) * 7 // 10 FROM tape) AS train FROM tape)"""


def features(spark, sf):
    side = F.when(F.col("ts_us") <= train_until(spark, sf), 0).otherwise(1)
    x = F.array((F.col("instrument_id") % 7).cast("double"), F.expr(f"ts_us div {HOUR} % 24").cast("double"), (F.col("seq") % 11).cast("double"))
    return tape(spark, sf).select("seq", "ts_us", x.alias("x"), F.col("value").alias("y"), side.alias("side"))


_PAIRS = ("x1", "x2", "x3")
_FIT_SQL = f"""m AS (SELECT avg(y) AS my, {", ".join(f"avg({a}) AS m_{a}" for a in _PAIRS)}, {", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for i, a in enumerate(_PAIRS) for b in (*_PAIRS[i:], "y"))} FROM f WHERE train),
e AS (SELECT *, x2x2 - x1x2 ** 2 / x1x1 AS a, x2x3 - x1x2 * x1x3 / x1x1 AS o, x3x3 - x1x3 ** 2 / x1x1 AS d, x2y - x1x2 * x1y / x1x1 AS p, x3y - x1x3 * x1y / x1x1 AS q FROM m),
w AS (SELECT *, (p * d - q * o) / (a * d - o * o) AS b2, (q * a - p * o) / (a * d - o * o) AS b3 FROM e),
b AS (SELECT -1 AS cluster, my, m_x1, m_x2, m_x3, (x1y - b2 * x1x2 - b3 * x1x3) / x1x1 AS b1, b2, b3 FROM w
 UNION ALL SELECT 0, my, m_x1, m_x2, m_x3, 0, (x2y * x3x3 - x3y * x2x3) / (x2x2 * x3x3 - x2x3 ** 2), (x3y * x2x2 - x2y * x2x3) / (x2x2 * x3x3 - x2x3 ** 2) FROM w UNION ALL SELECT 1, my, m_x1, m_x2, m_x3, x1y / x1x1, 0, 0 FROM w)"""


@query(
    "cluster_usefulness",
    f"""WITH {_FEATURES_SQL}, {_FIT_SQL}, r AS (SELECT cluster, 1 - sum((y - my - b1 * (x1 - m_x1) - b2 * (x2 - m_x2) - b3 * (x3 - m_x3)) ^ 2) / sum((y - my) ^ 2) AS r2 FROM f, b WHERE NOT train GROUP BY 1)
    SELECT cluster, round((SELECT r2 FROM r WHERE cluster = -1), 8) AS full_r2, round(CASE WHEN cluster >= 0 THEN r2 END, 8) AS dropped_r2, round(CASE WHEN cluster >= 0 THEN (SELECT r2 FROM r WHERE cluster = -1) - r2 END, 8) AS delta FROM r""",
)
def cluster_usefulness(spark, sf):
    grams = G.block_grams(features(spark, sf), "side", "x", "y", 3)
    return G.cluster_usefulness(grams, 3, CLUSTERS, 0.0).select("cluster", *[F.round(c, 8).alias(c) for c in ("full_r2", "dropped_r2", "delta")])


BLOCK, REPEATS = 100, 5


@query(
    "permuted_cluster_usefulness",
    f"""WITH {_FEATURES_SQL}, {_FIT_SQL}, t AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS pos FROM f WHERE NOT train), k AS (SELECT pos // {BLOCK} AS block, count(*) AS n FROM t GROUP BY 1),
    d AS (SELECT *, row_number() OVER (PARTITION BY draw, n ORDER BY block) AS i, row_number() OVER (PARTITION BY draw, n ORDER BY md5('3:' || draw || ':' || block), block) AS j FROM k, range({len(CLUSTERS) * REPEATS}) t(draw)),
    v AS (SELECT x.draw, x.block, y.block AS source FROM d x JOIN d y ON x.draw = y.draw AND x.n = y.n AND x.i = y.j),
    s AS (SELECT v.draw, sum((o.y - my - b1 * (CASE WHEN draw < {REPEATS} THEN z.x1 ELSE o.x1 END - m_x1) - b2 * (CASE WHEN draw < {REPEATS} THEN o.x2 ELSE z.x2 END - m_x2) - b3 * (CASE WHEN draw < {REPEATS} THEN o.x3 ELSE z.x3 END - m_x3)) ^ 2) AS moved, sum((o.y - my - b1 * (o.x1 - m_x1) - b2 * (o.x2 - m_x2) - b3 * (o.x3 - m_x3)) ^ 2) AS sse, sum((o.y - my) ^ 2) AS sst
     FROM v JOIN t o ON o.pos // {BLOCK} = v.block JOIN t z ON z.pos // {BLOCK} = v.source AND z.pos % {BLOCK} = o.pos % {BLOCK}, b WHERE b.cluster = -1 GROUP BY 1)
    SELECT CAST(draw // {REPEATS} AS INTEGER) AS cluster, CAST(draw % {REPEATS} AS INTEGER) AS repeat, round(1 - sse / sst, 8) AS full_r2, round(1 - moved / sst, 8) AS permuted_r2, round(moved / sst - sse / sst, 8) AS delta FROM s""",
)
def permuted_cluster_usefulness(spark, sf):
    """The full model stays; whole blocks of a cluster's columns change places among the held-out rows."""
    rows = features(spark, sf)
    fit = G.cluster_usefulness(G.block_grams(rows, "side", "x", "y", 3), 3, CLUSTERS, 0.0).where("cluster = -1").first()
    held = rows.where("side = 1").withColumn("k", F.lit(0))
    placed = ordered_scan(held, ["k"], ["seq"], slices_for(spark, sf, "features.seq", held, "seq"), {"i": row_no()}).withColumn("at", F.col("i") - 1)
    mean = rows.where("side = 0").agg(F.avg("y")).first()[0]
    out = G.permuted_usefulness(placed, "at", "x", "y", 3, fit["coefficients"], mean, CLUSTERS, block=BLOCK, repeats=REPEATS, seed=3)
    return out.select("cluster", F.col("repeat").cast("int").alias("repeat"), *[F.round(c, 8).alias(c) for c in ("full_r2", "permuted_r2", "delta")])


# ---- nonlinear gate -----------------------------------------------------------------------------------

AHEAD = 6 * HOUR
_HEIGHT_SQL = f"""{TAPE_SQL}, l AS (SELECT *, (value - lag(value) OVER w) ^ 2 AS m1, (value - 50) ^ 2 AS base, (value - (lag(value) OVER w + lag(value, 2) OVER w) / 2) ^ 2 AS m2 FROM tape WINDOW w AS (PARTITION BY channel ORDER BY ts_us, seq)),
h AS (SELECT channel, seq, ts_us, value, sum(CASE WHEN m1 IS NOT NULL THEN m1 ELSE 0 END) OVER w AS s1, sum(CASE WHEN m1 IS NOT NULL THEN base ELSE 0 END) OVER w AS b1, sum(CASE WHEN m2 IS NOT NULL THEN m2 ELSE 0 END) OVER w AS s2, sum(CASE WHEN m2 IS NOT NULL THEN base ELSE 0 END) OVER w AS b2 FROM l WINDOW w AS (PARTITION BY channel ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND {AHEAD} FOLLOWING))"""


def heights(spark, sf):
    """Two forecasts of a print (the last one; the mean of the last two) against the middle of the tape."""
    from ..operators.slices import prev

    cuts = time_slices(spark, sf)
    one = ordered_scan(tape(spark, sf), ["channel"], ["ts_us", "seq"], cuts, {"p1": prev("value")})
    two = ordered_scan(one, ["channel"], ["ts_us", "seq"], cuts, {"p2": prev("p1")})
    rows = two.select(
        "channel", "ts_us", "seq", "value", ((F.col("value") - F.col("p1")) ** 2).alias("m1"),
        ((F.col("value") - (F.col("p1") + F.col("p2")) / 2) ** 2).alias("m2"), ((F.col("value") - 50) ** 2).alias("base"),
    )
    return T.forward_advantage(rows, ["channel"], "ts_us", "seq", [("m1", "base"), ("m2", "base")], AHEAD, cuts)


@query(
    "forward_model_advantage",
    f"""WITH {_HEIGHT_SQL} SELECT channel, seq, round(CASE WHEN b1 > 1e-12 AND b2 > 1e-12 THEN ((1 - s1 / b1) + (1 - s2 / b2)) / 2 WHEN b1 > 1e-12 THEN 1 - s1 / b1 WHEN b2 > 1e-12 THEN 1 - s2 / b2 END, 5) AS height FROM h""",
)
def forward_model_advantage(spark, sf):
    """How far forecasts beat the baseline over the next hours, by running sums."""
    return heights(spark, sf).select("channel", "seq", F.round("height", 5).alias("height"))


@query("nonlinear_gate")
def nonlinear_gate(spark, sf):
    """Chance that the forecasts win the next hours, from hinges of the print's own state."""
    cut = train_until(spark, sf)
    rows = heights(spark, sf).withColumn("split", F.when(F.col("ts_us") <= cut * 1.0 - AHEAD, "train").when(F.col("ts_us") > cut, "validation").otherwise("embargo"))
    # Cuts, means and knots of three columns read the rows a dozen times, so heights are worked out once.
    rows = cut_lineage(rows.withColumn("far", F.abs(F.col("value") - 50)).withColumn("hour", F.expr(f"ts_us div {HOUR} % 24").cast("double")))
    cuts = {c: slices_for(spark, sf, f"gate.{c}", rows, c) for c in ("value", "far", "hour")}
    out, _ = T.fit_gate(rows, ["value", "far", "hour"], "height", "split", (1.0, 10.0), [(0, 1), (1, 2)], cuts)
    return out.select("channel", "seq", "split", F.round("gate", 6).alias("gate"))
