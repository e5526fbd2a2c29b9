"""Splits, fits, errors, bootstraps, multiplicity and placebo queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.real import rounded
from ..operators import inference as I
from ..operators import regression as G
from ..operators.folds import embargoed_split, expanding_folds
from .bindings import DAY, HOUR, TAPE_SQL, slices_for, table, tape, time_slices, train_until
from .registry import query

VEC_SQL = "v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x1, CAST(embedding[2] AS DOUBLE) AS x2, CAST(embedding[3] AS DOUBLE) AS x3, CAST(embedding[4] AS DOUBLE) + 0.5 * CAST(embedding[1] AS DOUBLE) - 0.25 * CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


def vectors(spark, sf):
    x = [F.get("embedding", i).cast("double") for i in range(4)]
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", x[0].alias("x1"), x[1].alias("x2"), x[2].alias("x3"), (x[3] + 0.5 * x[0] - 0.25 * x[1]).alias("y")
    )


def vec_slices(spark, sf):
    return slices_for(spark, sf, "embeddings.vec", table(spark, sf, "embeddings").select("vec_id"), "vec_id")


@query(
    "chronological_embargoed_split",
    f"""WITH {TAPE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts_us, seq) AS i, count(*) OVER (PARTITION BY channel) AS n FROM tape), e AS (SELECT channel, ts_us AS edge FROM r WHERE i = greatest(1, CAST(floor(n * 0.7) AS BIGINT)))
    SELECT channel, CASE WHEN ts_us <= edge THEN 'train' WHEN ts_us <= edge + {6 * HOUR} THEN 'embargo' ELSE 'test' END AS split, count(*) AS rows, min(seq) AS first_seq, max(seq) AS last_seq FROM r JOIN e USING (channel) GROUP BY 1, 2""",
)
def chronological_embargoed_split(spark, sf):
    out = embargoed_split(tape(spark, sf), "channel", "ts_us", "seq", time_slices(spark, sf), embargo=6 * HOUR)
    return out.groupBy("channel", "split").agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(
    "expanding_walk_forward_folds",
    f"""WITH {TAPE_SQL}, s AS (SELECT DISTINCT ts_us // {DAY} AS day FROM tape), r AS (SELECT day, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM s), w AS (SELECT *, greatest((n - 10) // 4, 1) AS width FROM r),
    f AS (SELECT day, fold, CASE WHEN least(floor((i - 11) / CAST(width AS DOUBLE)), 3) = fold THEN 'test' WHEN i <= 10 + fold * width - 2 THEN 'train' END AS role FROM w, range(4) t(fold))
    SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS sessions, min(day) AS first_day, max(day) AS last_day FROM f WHERE role IS NOT NULL GROUP BY 1, 2""",
)
def expanding_walk_forward_folds(spark, sf):
    days = tape(spark, sf).select(F.expr(f"ts_us div {DAY}").alias("day")).distinct()
    folds = expanding_folds(days, "day", 4, 2, 10, slices_for(spark, sf, "trend.day", days, "day"))
    return folds.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("sessions"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(
    "newey_west_mean",
    f"""WITH {TAPE_SQL}, d AS (SELECT channel, ts_us // {HOUR} AS h, avg(value) AS v FROM tape GROUP BY 1, 2), c AS (SELECT channel, h, v - avg(v) OVER (PARTITION BY channel) AS u, v FROM d),
    l AS (SELECT *, lag(u, 1) OVER w AS u1, lag(u, 2) OVER w AS u2, lag(u, 3) OVER w AS u3 FROM c WINDOW w AS (PARTITION BY channel ORDER BY h)),
    s AS (SELECT channel, count(*) AS n, avg(v) AS m, sum(u * u) / count(*) + 2 * (0.75 * coalesce(sum(u * u1), 0) + 0.5 * coalesce(sum(u * u2), 0) + 0.25 * coalesce(sum(u * u3), 0)) / count(*) AS lr FROM l GROUP BY 1)
    SELECT channel, n, round(m, 6) AS mean, round(greatest(lr, 0), 3) AS long_run_variance, round(sqrt(greatest(lr, 0) / n), 6) AS standard_error, round(m / sqrt(greatest(lr, 0) / n), 5) AS t_statistic FROM s""",
)
def newey_west_mean(spark, sf):
    hourly = tape(spark, sf).groupBy("channel", F.expr(f"ts_us div {HOUR}").alias("h")).agg(F.avg("value").alias("v"))
    cuts = slices_for(spark, sf, "hourly.h", hourly, "h")
    out = I.newey_west_mean(hourly, ["channel"], ["h"], "v", 3, cuts)
    d = {"mean": 6, "long_run_variance": 3, "standard_error": 6, "t_statistic": 5}
    return out.select("channel", "n", *[F.round(c, k).alias(c) for c, k in d.items()])


@query(
    "disjoint_block_mean",
    f"""WITH {TAPE_SQL}, o AS (SELECT channel, min(ts_us) AS t0 FROM tape GROUP BY 1), b AS (SELECT channel, CAST(floor((ts_us - t0) / {float(DAY)}) AS BIGINT) AS b, avg(value) AS m FROM tape JOIN o USING (channel) GROUP BY 1, 2)
    SELECT channel, count(*) AS blocks, round(avg(m), 6) AS block_mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS block_se, round(avg(m) / (stddev_samp(m) / sqrt(count(*))), 5) AS block_t FROM b GROUP BY 1""",
)
def disjoint_block_mean(spark, sf):
    out = I.block_means(tape(spark, sf), ["channel"], "ts_us", "value", DAY)
    return out.select("channel", "blocks", F.round("block_mean", 6).alias("block_mean"), F.round("block_se", 6).alias("block_se"), F.round("block_t", 5).alias("block_t"))


@query("block_bootstrap_interval")
def block_bootstrap_interval(spark, sf):
    rows = tape(spark, sf).withColumn("block", F.expr(f"ts_us div {DAY}"))
    return I.block_bootstrap_mean(rows, ["channel"], ["block"], "value", 200, 17)


P_SQL = f"""{TAPE_SQL}, z AS (SELECT channel AS family, instrument_id AS id, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM tape GROUP BY 1, 2), p AS (SELECT family, id, CASE WHEN n >= 5 AND sd > 0 THEN round(1 / (1 + abs(m - 50) / (sd / sqrt(n))), 8) END AS p FROM z)"""


def hypotheses(spark, sf):
    """One hypothesis per (channel, instrument) with a deterministic p-value in (0, 1]."""
    z = tape(spark, sf).groupBy(F.col("channel").alias("family"), F.col("instrument_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd")
    )
    p = F.when((F.col("n") >= 5) & (F.col("sd") > 0), F.round(1 / (1 + F.abs(F.col("m") - 50) / (F.col("sd") / F.sqrt("n"))), 8))
    return z.select("family", "id", p.alias("p"))


@query(
    "multiplicity_adjustment",
    f"""WITH {P_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS r, count(*) OVER (PARTITION BY family) AS m FROM p WHERE p IS NOT NULL), h AS (SELECT *, sum(1.0 / r) OVER (PARTITION BY family) AS h FROM r),
    a AS (SELECT family, id, least(p * m, 1) AS bonferroni, max(least((m - r + 1) * p, 1)) OVER (PARTITION BY family ORDER BY r) AS holm, least(min(p * m / r) OVER (PARTITION BY family ORDER BY r DESC), 1) AS bh, least(min(p * m * h / r) OVER (PARTITION BY family ORDER BY r DESC), 1) AS by_ FROM h)
    SELECT p.family, p.id, p.p, round(bonferroni, 6) AS bonferroni, round(holm, 6) AS holm, round(bh, 6) AS benjamini_hochberg, round(by_, 6) AS benjamini_yekutieli FROM p LEFT JOIN a ON p.family = a.family AND p.id = a.id""",
)
def multiplicity_adjustment(spark, sf):
    out = I.adjust_p_values(hypotheses(spark, sf), ["family"], "p", "id")
    return out.select("family", "id", "p", *[F.round(c, 6).alias(c) for c in ("bonferroni", "holm", "benjamini_hochberg", "benjamini_yekutieli")])


@query(
    "hierarchical_adjustment",
    f"""WITH {P_SQL}, k AS (SELECT family || ':' || CAST(id AS VARCHAR) AS h, * FROM p WHERE p IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, h) AS rf, count(*) OVER (PARTITION BY family) AS mf, row_number() OVER (ORDER BY p, h) AS re, count(*) OVER () AS me FROM k)
    SELECT h AS hypothesis, family, round(least(min(p * mf / rf) OVER (PARTITION BY family ORDER BY rf DESC), 1), 6) AS family_adjusted, round(least(min(p * me / re) OVER (ORDER BY re DESC), 1), 6) AS experiment_adjusted FROM r""",
)
def hierarchical_adjustment(spark, sf):
    h = hypotheses(spark, sf).where(F.col("p").isNotNull()).select(F.concat("family", F.lit(":"), F.col("id").cast("string")).alias("hypothesis"), "family", "p")
    fam = I.adjust_p_values(h, ["family"], "p", "hypothesis").select("hypothesis", "family", F.round("benjamini_hochberg", 6).alias("family_adjusted"))
    exp = I.adjust_p_values(h.withColumn("e", F.lit(0)), ["e"], "p", "hypothesis").select("hypothesis", F.round("benjamini_hochberg", 6).alias("experiment_adjusted"))
    return fam.join(exp, "hypothesis")


@query(
    "max_t_step_down",
    """WITH o AS (SELECT label AS cell, avg(CAST(embedding[1] AS DOUBLE)) / (stddev_samp(CAST(embedding[1] AS DOUBLE)) / sqrt(count(*))) AS t FROM embeddings GROUP BY 1),
    b AS (SELECT i AS replicate, label AS cell, avg(CAST(embedding[i] AS DOUBLE)) / (stddev_samp(CAST(embedding[i] AS DOUBLE)) / sqrt(count(*))) AS t FROM embeddings, range(2, 65) r(i) GROUP BY 1, 2),
    k AS (SELECT cell, t, row_number() OVER (ORDER BY abs(t) DESC, cell) AS rank FROM o), s AS (SELECT b.replicate, b.cell, k.rank, abs(k.t) AS obs, max(abs(b.t)) OVER (PARTITION BY b.replicate ORDER BY k.rank DESC) AS mx FROM b JOIN k USING (cell)),
    c AS (SELECT cell, rank, (count(CASE WHEN mx >= obs THEN 1 END) + 1) / CAST(count(*) + 1 AS DOUBLE) AS p FROM s GROUP BY 1, 2) SELECT cell, CAST(rank AS INTEGER) AS rank, round(least(max(p) OVER (ORDER BY rank), 1), 6) AS adjusted_p FROM c""",
)
def max_t_step_down(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("cell"), F.posexplode("embedding").alias("i", "v"))
    t = e.groupBy("cell", (F.col("i") + 1).alias("replicate")).agg(
        (F.avg(F.col("v").cast("double")) / (F.stddev_samp(F.col("v").cast("double")) / F.sqrt(F.count(F.lit(1))))).alias("t")
    )
    out = I.step_down_max_t(t.where("replicate = 1").select("cell", "t"), t.where("replicate > 1"), "cell", "t", "replicate")
    return out.withColumn("adjusted_p", F.round("adjusted_p", 6))


@query(
    "standardised_least_squares",
    f"""WITH {VEC_SQL}, m AS (SELECT label, count(*) AS n, covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x2, x2) AS c, covar_pop(x1, y) AS p, covar_pop(x2, y) AS q, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(y) AS vy FROM v GROUP BY 1),
    s AS (SELECT *, (p * c - q * b) / (a * c - b * b) AS b1, (q * a - p * b) / (a * c - b * b) AS b2 FROM m)
    SELECT label, CAST(n AS DOUBLE) AS n, round(my - b1 * m1 - b2 * m2, 6) AS intercept, round(b1, 6) AS beta_x1, round(b2, 6) AS beta_x2, round((b1 * p + b2 * q) / vy, 6) AS r2 FROM s""",
)
def standardised_least_squares(spark, sf):
    f = G.fit(vectors(spark, sf), ["label"], ["x1", "x2"], "y")
    b = F.col("coefficients")
    return f.select("label", "n", *[F.round(F.get(b, i), 6).alias(n) for i, n in enumerate(("intercept", "beta_x1", "beta_x2"))], F.round("r2", 6).alias("r2"))


@query(
    "ridge_penalty_path",
    f"""WITH {VEC_SQL}, m AS (SELECT count(*) AS n, covar_pop(x1, y) / stddev_pop(x1) AS push, var_pop(x1) AS v, stddev_pop(x1) AS s, avg(x1) AS mx, avg(y) AS my FROM v), a AS (SELECT unnest([0.0, 10.0, 100.0]) AS alpha)
    SELECT CAST(alpha AS DOUBLE) AS alpha, round(push / (1 + alpha / n) / s, 6) AS beta, round(my - push / (1 + alpha / n) / s * mx, 6) AS intercept FROM m, a""",
)
def ridge_penalty_path(spark, sf):
    f = G.fit(vectors(spark, sf), [], ["x1"], "y", [0.0, 10.0, 100.0])
    return f.select("alpha", F.round(F.get("coefficients", 1), 6).alias("beta"), F.round(F.get("coefficients", 0), 6).alias("intercept"))


@query(
    "penalty_selection_out_of_sample",
    f"""WITH {VEC_SQL}, s AS (SELECT *, CASE WHEN vec_id % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM v), m AS (SELECT label, count(*) AS n, covar_pop(x1, y) / stddev_pop(x1) AS push, stddev_pop(x1) AS s, avg(x1) AS mx, avg(y) AS my FROM s WHERE split = 'train' GROUP BY 1), a AS (SELECT unnest([0.0, 20.0, 200.0]) AS alpha),
    b AS (SELECT label, alpha, push / (1 + alpha / n) / s AS beta, my - push / (1 + alpha / n) / s * mx AS b0, my FROM m, a), r AS (SELECT s.label, alpha, count(*) AS test_n, 1 - sum((y - b0 - beta * x1) ^ 2) / sum((y - my) ^ 2) AS r2 FROM s JOIN b USING (label) WHERE split = 'test' GROUP BY 1, 2)
    SELECT label, CAST(alpha AS DOUBLE) AS alpha, CAST(test_n AS DOUBLE) AS test_n, round(r2, 6) AS oos_r2, r2 = max(r2) OVER (PARTITION BY label) AS chosen FROM r""",
)
def penalty_selection_out_of_sample(spark, sf):
    rows = vectors(spark, sf)
    train = rows.where(F.col("vec_id") % 10 < 7)
    test = rows.where(F.col("vec_id") % 10 >= 7)
    fits = G.fit(train, ["label"], ["x1"], "y", [0.0, 20.0, 200.0])
    scores = G.score_from_moments(G.moments(test, ["label"], ["x1"], "y"), fits, ["label"], ["x1"])
    # The top is told from the same rows: scores worked out a second time may add up in another order.
    top = F.max("oos_r2").over(Window.partitionBy("label"))
    return scores.select("label", "alpha", "test_n", rounded("oos_r2", 6).alias("oos_r2"), (F.col("oos_r2") == top).alias("chosen"))


@query(
    "horse_race_cells",
    f"""WITH {TAPE_SQL}, k AS (SELECT (min(ts_us) + (max(ts_us) - min(ts_us)) * 7 // 10) // {HOUR} AS cut FROM tape), g AS MATERIALIZED (SELECT channel, ts_us // {HOUR} AS slot, arg_max(value, (ts_us, seq)) AS v FROM tape GROUP BY 1, 2), ww AS (SELECT a.channel, a.slot, w, a.slot - w AS ps, a.v FROM g a, (VALUES (1), (3)) ww(w)), pp AS (SELECT ww.channel, ww.slot, w, ww.v - p.v AS x, ww.v FROM ww JOIN g p ON p.channel = ww.channel AND p.slot = ww.ps),
    hh AS (SELECT pp.*, h, slot + h AS fs FROM pp, (VALUES (1), (2)) hh(h)), c AS MATERIALIZED (SELECT hh.channel, hh.slot, w, h, x, f.v - hh.v AS y FROM hh JOIN g f ON f.channel = hh.channel AND f.slot = hh.fs), t AS (SELECT channel, w, h, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS b0, avg(y) AS my FROM c WHERE slot < (SELECT cut FROM k) GROUP BY 1, 2, 3)
    SELECT c.channel, c.w AS "window", c.h AS horizon, CAST(any_value(t.n) AS DOUBLE) AS train_n, CAST(count(*) AS DOUBLE) AS test_n, round(1 - sum((y - b0 - b * x) ^ 2) / sum((y - my) ^ 2), 5) AS oos_r2 FROM c JOIN t ON c.channel = t.channel AND c.w = t.w AND c.h = t.h WHERE c.slot >= (SELECT cut + 6 FROM k) GROUP BY 1, 2, 3""",
)
def horse_race_cells(spark, sf):
    from ..operators.slices import sliding
    from .state_queries import grid, slot_slices

    windows, horizons = (1, 3), (1, 2)
    near = sliding(
        grid(spark, sf), ["channel"], "slot", slot_slices(spark, sf),
        {**{f"p{w}": (lambda f, w=w: F.max("v").over(f(-w, -w))) for w in windows}, **{f"f{h}": (lambda f, h=h: F.max("v").over(f(h, h))) for h in horizons}},
        back=max(windows), ahead=max(horizons),
    )
    cells = F.inline(
        F.array(
            *[
                F.struct(F.lit(w).alias("window"), F.lit(h).alias("horizon"), (F.col("v") - F.col(f"p{w}")).alias("x"), (F.col(f"f{h}") - F.col("v")).alias("y"))
                for w in windows for h in horizons
            ]
        )
    )
    long = near.select("channel", "slot", cells).dropna()
    keys = ["channel", "window", "horizon"]
    # One pass over the long table: train and test moments side by side, then a solve per cell.
    cut = train_until(spark, sf) // HOUR
    train = G.moments(long.where(F.col("slot") < cut), keys, ["x"], "y")
    test = G.moments(long.where(F.col("slot") >= cut + 6), keys, ["x"], "y")
    fits = G.solve_moments(train, ["x"])
    scored = G.score_from_moments(test, fits, keys, ["x"]).join(fits.select(*keys, F.col("n").alias("train_n")), keys)
    return scored.select(*keys, "train_n", "test_n", F.round("oos_r2", 5).alias("oos_r2"))


@query(
    "nested_feature_ladder",
    f"""WITH {VEC_SQL}, m AS (SELECT label, covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x2, x2) AS c, covar_pop(x1, y) AS p, covar_pop(x2, y) AS q, var_pop(y) AS vy FROM v GROUP BY 1)
    SELECT label, round(p * p / a / vy, 6) AS r2_1, round((p * (p * c - q * b) + q * (q * a - p * b)) / (a * c - b * b) / vy, 6) AS r2_2, round((p * (p * c - q * b) + q * (q * a - p * b)) / (a * c - b * b) / vy - p * p / a / vy, 6) AS increment FROM m""",
)
def nested_feature_ladder(spark, sf):
    rows = vectors(spark, sf)
    one = G.fit(rows, ["label"], ["x1"], "y").select("label", F.col("r2").alias("r2_1"))
    two = G.fit(rows, ["label"], ["x1", "x2"], "y").select("label", F.col("r2").alias("r2_2"))
    return one.join(two, "label").select(
        "label", F.round("r2_1", 6).alias("r2_1"), F.round("r2_2", 6).alias("r2_2"), F.round(F.col("r2_2") - F.col("r2_1"), 6).alias("increment")
    )


@query(
    "collinearity_summary",
    f"""WITH {VEC_SQL}, m AS (SELECT label, corr(x1, y) AS r FROM v GROUP BY 1) SELECT label, unnest(['x1', 'y']) AS feature, round(1 / (1 - r * r), 6) AS vif FROM m""",
)
def collinearity_summary(spark, sf):
    return G.variance_inflation(vectors(spark, sf), ["label"], ["x1", "y"]).withColumn("vif", F.round("vif", 6))


@query(
    "first_principal_component",
    f"""WITH {VEC_SQL}, m AS (SELECT label, var_pop(x1) AS a, covar_pop(x1, y) AS b, var_pop(y) AS c FROM v GROUP BY 1), l AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ^ 2 + b * b) AS top FROM m), w AS (SELECT *, b AS w1, top - a AS w2 FROM l), s AS (SELECT *, CASE WHEN w1 + w2 >= 0 THEN 1 ELSE -1 END AS sg FROM w)
    SELECT label, round(sg * w1 / (abs(w1) + abs(w2)), 6) AS weight_1, round(sg * w2 / (abs(w1) + abs(w2)), 6) AS weight_2, round(top / (a + c), 6) AS explained FROM s""",
)
def first_principal_component(spark, sf):
    out = G.first_component(vectors(spark, sf), ["label"], ["x1", "y"])
    return out.select("label", F.round(F.get("weights", 0), 6).alias("weight_1"), F.round(F.get("weights", 1), 6).alias("weight_2"), F.round("explained", 6).alias("explained"))


@query(
    "family_shrinkage",
    f"""WITH {TAPE_SQL}, e AS (SELECT channel AS family, instrument_id AS id, avg(value) AS effect, stddev_samp(value) / sqrt(count(*)) AS error FROM tape GROUP BY 1, 2 HAVING count(*) >= 4 AND stddev_samp(value) > 0), f AS (SELECT family, sum(effect / error ^ 2) / sum(1 / error ^ 2) AS fm, greatest(var_samp(effect) - avg(error ^ 2), 0) AS bt FROM e GROUP BY 1)
    SELECT e.family, id, round(fm + bt / (bt + error ^ 2) * (effect - fm), 5) AS shrunk FROM e JOIN f ON e.family = f.family""",
)
def family_shrinkage(spark, sf):
    e = tape(spark, sf).groupBy(F.col("channel").alias("family"), F.col("instrument_id").alias("id")).agg(
        F.avg("value").alias("effect"), (F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))).alias("error"), F.count(F.lit(1)).alias("n")
    ).where((F.col("n") >= 4) & (F.col("error") > 0))
    return G.shrink_families(e, "family", "effect", "error").select("family", "id", F.round("shrunk", 5).alias("shrunk"))


@query(
    "past_only_ensemble_weights",
    """WITH m AS (SELECT label AS g, 'a' AS model, avg(CAST(embedding[1] AS DOUBLE)) AS s FROM embeddings GROUP BY 1 UNION ALL SELECT label, 'b', avg(CAST(embedding[2] AS DOUBLE)) FROM embeddings GROUP BY 1), e AS (SELECT *, exp((s - max(s) OVER (PARTITION BY g)) / 0.1) AS x FROM m) SELECT g AS label, model, round(x / sum(x) OVER (PARTITION BY g), 6) AS weight FROM e""",
)
def past_only_ensemble_weights(spark, sf):
    v = vectors(spark, sf)
    long = v.select("label", F.inline(F.array(F.struct(F.lit("a").alias("model"), F.col("x1").alias("s")), F.struct(F.lit("b").alias("model"), F.col("x2").alias("s")))))
    return G.ensemble_weights(long, ["label"], "model", "s", 0.1).withColumn("weight", F.round("weight", 6))


@query(
    "t_and_welch_summaries",
    f"""WITH {TAPE_SQL}, s AS (SELECT channel, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd, count(CASE WHEN seq % 2 = 0 THEN 1 END) AS n1, count(CASE WHEN seq % 2 <> 0 THEN 1 END) AS n2, avg(CASE WHEN seq % 2 = 0 THEN value END) AS m1, avg(CASE WHEN seq % 2 <> 0 THEN value END) AS m2, var_samp(CASE WHEN seq % 2 = 0 THEN value END) AS v1, var_samp(CASE WHEN seq % 2 <> 0 THEN value END) AS v2 FROM tape GROUP BY 1)
    SELECT channel, n, round(m / (sd / sqrt(n)), 5) AS t, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 5) AS welch_t, round((v1 / n1 + v2 / n2) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v2 / n2) ^ 2 / (n2 - 1)), 4) AS welch_df, round((1.959963985 + 0.841621234) * sd / sqrt(n), 6) AS minimum_detectable, ceil(((1.959963985 + 0.841621234) * sd / 2.0) ^ 2) AS required_n FROM s""",
)
def t_and_welch_summaries(spark, sf):
    rows = tape(spark, sf)
    t = I.t_summary(rows, ["channel"], "value")
    w = I.welch_t(rows, ["channel"], "value", F.col("seq") % 2 == 0).select("channel", F.col("t").alias("wt"), F.col("df").alias("wdf"))
    return t.join(w, "channel").select(
        "channel", "n", F.round("t", 5).alias("t"), F.round("wt", 5).alias("welch_t"), F.round("wdf", 4).alias("welch_df"),
        F.round(I.minimum_detectable(F.col("sd"), F.col("n")), 6).alias("minimum_detectable"),
        I.required_sample(F.col("sd"), F.lit(2.0)).cast("double").alias("required_n"),
    )


@query("stoikov_microprice")
def stoikov_microprice(spark, sf):
    from .state_queries import stoikov_transitions

    return G.stoikov_adjustment(stoikov_transitions(spark, sf), until=train_until(spark, sf))


@query(
    "response_surface_neighbours",
    f"""WITH {TAPE_SQL}, c AS (SELECT CAST(instrument_id % 12 AS BIGINT) AS a, CAST(seq % 9 AS BIGINT) AS b, avg(value) - 50 AS m FROM tape GROUP BY 1, 2)
    SELECT x.a, x.b, count(y.m) AS neighbours, count(CASE WHEN sign(x.m) = sign(y.m) THEN 1 END) AS agreeing, count(CASE WHEN sign(x.m) = sign(y.m) THEN 1 END) = 0 AS isolated FROM c x LEFT JOIN c y ON abs(x.a - y.a) + abs(x.b - y.b) = 1 GROUP BY 1, 2""",
)
def response_surface_neighbours(spark, sf):
    from ..operators.surfaces import neighbour_agreement

    cells = tape(spark, sf).groupBy((F.col("instrument_id") % 12).alias("a"), (F.col("seq") % 9).alias("b")).agg((F.avg("value") - 50).alias("m"))
    return neighbour_agreement(cells, ["a", "b"], "m")


@query(
    "connected_regions",
    f"""WITH RECURSIVE {TAPE_SQL}, c AS (SELECT CAST(instrument_id % 12 AS BIGINT) AS a, CAST(seq % 9 AS BIGINT) AS b, avg(value) - 50 AS m FROM tape GROUP BY 1, 2), k AS (SELECT a, b, a * 100 + b AS id FROM c WHERE m > 0),
    r AS (SELECT id, id AS reach FROM k UNION SELECT r.id, y.id FROM r JOIN k x ON x.id = r.reach JOIN k y ON abs(x.a - y.a) + abs(x.b - y.b) = 1), m AS (SELECT id, min(reach) AS region FROM r GROUP BY 1)
    SELECT region, count(*) AS cells FROM m GROUP BY 1""",
)
def connected_regions(spark, sf):
    from ..operators.surfaces import connected_components, lattice_edges

    cells = tape(spark, sf).groupBy((F.col("instrument_id") % 12).alias("a"), (F.col("seq") % 9).alias("b")).agg((F.avg("value") - 50).alias("m"))
    positive = cells.where("m > 0").select("a", "b", (F.col("a") * 100 + F.col("b")).alias("id"))
    labels = connected_components(positive.select("id"), lattice_edges(positive, ["a", "b"], "id"), "id")
    return labels.groupBy(F.col("component").alias("region")).agg(F.count(F.lit(1)).alias("cells"))


@query(
    "circular_shift_null",
    f"""WITH {TAPE_SQL}, d AS (SELECT channel, ts_us // {DAY} AS day, avg(value) AS x, avg(seq % 100) AS y FROM tape GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY channel) AS n FROM d)
    SELECT a.channel, CAST(s AS INTEGER) AS shift, count(*) AS n, round(corr(a.x, b.y), 6) AS correlation FROM r a, range(0, 5) t(s), r b WHERE a.channel = b.channel AND b.i = (a.i + s * 3) % a.n GROUP BY 1, 2""",
)
def circular_shift_null(spark, sf):
    from ..operators.nulls import circular_shift_correlations

    d = tape(spark, sf).groupBy("channel", F.expr(f"ts_us div {DAY}").alias("day")).agg(F.avg("value").alias("x"), F.avg(F.col("seq") % 100).alias("y"))
    out = circular_shift_correlations(d, ["channel"], ["day"], "x", "y", [0, 3, 6, 9, 12], slices_for(spark, sf, "trend.day", d, "day"))
    return out.select("channel", (F.col("offset") / 3).cast("int").alias("shift"), "n", F.round("correlation", 6).alias("correlation"))


@query(
    "axis_grid_expansion",
    "SELECT w AS \"window\", h AS horizon, m AS model, count(*) OVER () AS cells FROM (VALUES (1), (5), (10)) a(w), (VALUES (1), (5), (30), (60)) b(h), (SELECT DISTINCT p_type AS m FROM part) c",
)
def axis_grid_expansion(spark, sf):
    models = table(spark, sf, "part").select(F.col("p_type").alias("model")).distinct()
    out = models.select("model", F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w in (1, 5, 10) for h in (1, 5, 30, 60)])).alias("c"))
    n = models.agg((F.count(F.lit(1)) * 12).alias("cells"))
    return out.select(F.col("c.w").alias("window"), F.col("c.h").alias("horizon"), "model").crossJoin(F.broadcast(n))


@query(
    "winners_curse_and_stability",
    f"""WITH {TAPE_SQL}, s AS (SELECT instrument_id, CASE WHEN ts_us % 2 = 0 THEN 'a' ELSE 'b' END AS half, avg(value) AS m FROM tape GROUP BY 1, 2), w AS (SELECT instrument_id, max(CASE WHEN half = 'a' THEN m END) AS ma, max(CASE WHEN half = 'b' THEN m END) AS mb FROM s GROUP BY 1)
    SELECT count(*) AS cells, arg_max(instrument_id, (ma, -instrument_id)) AS winner, round(max(ma) - arg_max(mb, (ma, -instrument_id)), 6) AS winners_gap, round(corr(ma, mb), 6) AS stability, count(CASE WHEN sign(ma - 50) = sign(mb - 50) THEN 1 END) AS sign_consistent FROM w""",
)
def winners_curse_and_stability(spark, sf):
    half = F.when(F.col("ts_us") % 2 == 0, "a").otherwise("b")
    w = tape(spark, sf).groupBy("instrument_id").agg(
        F.avg(F.when(half == "a", F.col("value"))).alias("ma"), F.avg(F.when(half == "b", F.col("value"))).alias("mb")
    )
    order = F.struct("ma", -F.col("instrument_id"))
    return w.agg(
        F.count(F.lit(1)).alias("cells"), F.max_by("instrument_id", order).alias("winner"),
        F.round(F.max("ma") - F.max_by("mb", order), 6).alias("winners_gap"), F.round(F.corr("ma", "mb"), 6).alias("stability"),
        F.count(F.when(F.signum(F.col("ma") - 50) == F.signum(F.col("mb") - 50), 1)).alias("sign_consistent"),
    )


@query(
    "lifecycle_decay_runs",
    f"""WITH {TAPE_SQL}, d AS (SELECT channel, ts_us // {DAY} AS day, avg(value) AS m FROM tape GROUP BY 1, 2), f AS (SELECT *, m < 50 AS failing, row_number() OVER (PARTITION BY channel ORDER BY day) AS i FROM d),
    g AS (SELECT *, max(CASE WHEN NOT failing THEN i END) OVER (PARTITION BY channel ORDER BY day ROWS UNBOUNDED PRECEDING) AS last_ok FROM f), r AS (SELECT channel, day, failing, i - coalesce(last_ok, 0) AS run FROM g)
    SELECT channel, day, run, CASE WHEN run = 0 THEN 'healthy' WHEN run < 3 THEN 'watch' ELSE 'decayed' END AS status FROM r""",
)
def lifecycle_decay_runs(spark, sf):
    from ..operators.slices import last, ordered_scan, row_no

    d = tape(spark, sf).groupBy("channel", F.expr(f"ts_us div {DAY}").alias("day")).agg(F.avg("value").alias("m"))
    cuts = slices_for(spark, sf, "trend.day", d, "day")
    n = ordered_scan(d, ["channel"], ["day"], cuts, {"i": row_no()})
    r = ordered_scan(n, ["channel"], ["day"], cuts, {"ok": last(F.when(F.col("m") >= 50, F.col("i")))})
    run = F.col("i") - F.coalesce(F.col("ok"), F.lit(0))
    return r.select("channel", "day", run.alias("run"), F.when(run == 0, "healthy").when(run < 3, "watch").otherwise("decayed").alias("status"))
