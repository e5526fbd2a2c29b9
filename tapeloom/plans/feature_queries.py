"""Feature quality, matching, clusters, ladders and model jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import flow
from ..operators.matching import nearest_control, relocations
from ..operators.quantiles import quantiles
from ..operators.slices import ordered_scan, prev, row_no
from ..session import cut_lineage
from .bindings import DAY, HOUR, TAPE_SQL, slices_for, table, tape, time_slices
from .book_queries import ATOMIC_SQL, FAR, OVERLAP, atomic, moves
from .registry import query
from .state_queries import GRID_SQL, grid, slot_slices

WIDTH = 64
NAMES = [f"f{i}" for i in range(1, WIDTH + 1)]


def wide(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", *[F.get("embedding", i).cast("double").alias(n) for i, n in enumerate(NAMES)])


@query(
    "feature_quality_gates",
    """WITH l AS (SELECT 'f' || CAST(i AS VARCHAR) AS feature, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) t(i) WHERE vec_id % 10 < 7), a AS (SELECT feature, count(*) AS rows, count(CASE WHEN value NOT BETWEEN -0.35 AND 0.35 THEN 1 END) AS out_of_range, stddev_pop(CASE WHEN value BETWEEN -0.35 AND 0.35 THEN value END) AS sd FROM l GROUP BY 1)
    SELECT feature, rows, out_of_range, round(sd, 6) AS sd, CASE WHEN out_of_range > 0 THEN 'out_of_range' WHEN sd < 0.001 THEN 'near_constant' END AS reason FROM a""",
)
def feature_quality_gates(spark, sf):
    train = wide(spark, sf).where(F.col("vec_id") % 10 < 7)
    out = X.quality_gates(X.unpivot_features(train, ["vec_id"], NAMES), low=-0.35, high=0.35, minimum_coverage=0.9, minimum_sd=0.001)
    return out.select("feature", "rows", "out_of_range", F.round("sd", 6).alias("sd"), "reason")


@query(
    "interaction_features",
    f"""WITH {TAPE_SQL} SELECT channel, round(sum(value * (seq % 13)), 3) AS product_sum, CAST(sum(greatest(ts_us, ts_us - seq % 7)) AS DOUBLE) / 1e15 AS availability FROM tape GROUP BY 1""",
)
def interaction_features(spark, sf):
    value, at = X.interaction(F.col("value"), F.col("seq") % 13, F.col("ts_us"), F.col("ts_us") - F.col("seq") % 7)
    rows = tape(spark, sf).select("channel", value.alias("v"), at.alias("at"))
    return rows.groupBy("channel").agg(
        F.round(F.sum("v"), 3).alias("product_sum"), (F.sum(F.col("at").cast("decimal(38,0)")).cast("double") / 1e15).alias("availability")
    )


@query(
    "winsorised_correlation",
    f"""WITH {TAPE_SQL}, b AS (SELECT channel, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM tape GROUP BY 1) SELECT t.channel, round(corr(least(greatest(value, lo), hi), CAST(seq % 101 AS DOUBLE) + value / 10), 6) AS correlation FROM tape t JOIN b ON t.channel = b.channel GROUP BY 1""",
)
def winsorised_correlation(spark, sf):
    rows = tape(spark, sf)
    b = quantiles(rows, ["channel"], "value", {"lo": 0.05, "hi": 0.95}, slices_for(spark, sf, "tape.value", rows, "value"))
    v = X.winsorise(F.col("value"), F.col("lo"), F.col("hi"))
    return rows.join(b, "channel").groupBy("channel").agg(
        F.round(F.corr(v, F.col("seq") % 101 + F.col("value") / 10), 6).alias("correlation")
    )


@query(
    "multi_sign_buckets",
    f"""WITH {GRID_SQL}, l AS (SELECT channel, v, lag(v, 1) OVER w AS a, lag(v, 2) OVER w AS b, lag(v, 3) OVER w AS c FROM grid WINDOW w AS (PARTITION BY channel ORDER BY slot)), s AS (SELECT CASE WHEN v > a THEN '+' WHEN v < a THEN '-' ELSE '0' END || CASE WHEN a > b THEN '+' WHEN a < b THEN '-' ELSE '0' END || CASE WHEN b > c THEN '+' WHEN b < c THEN '-' ELSE '0' END AS word FROM l WHERE c IS NOT NULL)
    SELECT word, count(*) AS n FROM s GROUP BY 1""",
)
def multi_sign_buckets(spark, sf):
    cuts = slot_slices(spark, sf)
    one = ordered_scan(grid(spark, sf), ["channel"], ["slot"], cuts, {"a": prev("v")})
    two = ordered_scan(one, ["channel"], ["slot"], cuts, {"b": prev("a")})
    three = ordered_scan(two, ["channel"], ["slot"], cuts, {"c": prev("b")}).where(F.col("c").isNotNull())
    word = X.sign_word([F.col("v") - F.col("a"), F.col("a") - F.col("b"), F.col("b") - F.col("c")])
    return three.groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "acceptance_policy_failures",
    f"""WITH {TAPE_SQL}, d AS (SELECT ts_us // {DAY} AS day, count(*) AS n, count(DISTINCT instrument_id) AS ins, max(value) AS mx, max(ts_us) - min(ts_us) AS span FROM tape GROUP BY 1)
    SELECT day, concat_ws(',', CASE WHEN n < 340 THEN 'too_few_rows' END, CASE WHEN ins < 130 THEN 'thin_universe' END, CASE WHEN mx > 300 THEN 'range' END, CASE WHEN span < {23 * HOUR} THEN 'short_coverage' END) AS failures FROM d""",
)
def acceptance_policy_failures(spark, sf):
    d = tape(spark, sf).groupBy(F.expr(f"ts_us div {DAY}").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("instrument_id").alias("ins"), F.max("value").alias("mx"), (F.max("ts_us") - F.min("ts_us")).alias("span")
    )
    rules = {"too_few_rows": F.col("n") < 340, "thin_universe": F.col("ins") < 130, "range": F.col("mx") > 300, "short_coverage": F.col("span") < 23 * HOUR}
    return d.select("day", F.array_join(X.failing_rules(rules), ",").alias("failures"))


@query(
    "frozen_variance_forecast",
    f"""WITH {TAPE_SQL}, d AS (SELECT channel, ts_us // {DAY} AS day, var_pop(value) AS rv, avg(value) AS lv FROM tape GROUP BY 1, 2) SELECT channel, day, round(exp(0.4 + 0.35 * ln(rv) + 0.2 * ln(lv)), 5) AS forecast, round(rv / exp(0.4 + 0.35 * ln(rv) + 0.2 * ln(lv)), 6) AS ratio FROM d WHERE rv > 0 AND lv > 0""",
)
def frozen_variance_forecast(spark, sf):
    d = tape(spark, sf).groupBy("channel", F.expr(f"ts_us div {DAY}").alias("day")).agg(F.var_pop("value").alias("rv"), F.avg("value").alias("lv"))
    f = X.frozen_variance_forecast([0.4, 0.35, 0.2], [F.col("rv"), F.col("lv")])
    return d.where((F.col("rv") > 0) & (F.col("lv") > 0)).select("channel", "day", F.round(f, 5).alias("forecast"), F.round(F.col("rv") / f, 6).alias("ratio"))


@query(
    "burst_signed_magnitude",
    f"""WITH {ATOMIC_SQL} SELECT seq, count(*) AS events, sum(CASE WHEN kind IN ('addition', 'quantity_increase', 'order_count_increase') THEN 1 ELSE -1 END * CASE WHEN side = 'bid' THEN 1 ELSE -1 END * magnitude) AS signed, sum(magnitude) AS gross FROM atomic GROUP BY 1""",
)
def burst_signed_magnitude(spark, sf):
    signed = X.signed_magnitude(F.col("kind"), F.col("side"), F.col("magnitude"))
    return atomic(spark, sf).groupBy("seq").agg(F.count(F.lit(1)).alias("events"), F.sum(signed).alias("signed"), F.sum("magnitude").alias("gross"))


@query(
    "forecast_quintile_ladder",
    """WITH f AS (SELECT CAST(embedding[1] AS DOUBLE) AS p, CAST(embedding[2] AS DOUBLE) + CAST(embedding[1] AS DOUBLE) / 4 AS y FROM embeddings), e AS (SELECT quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS q FROM f), b AS (SELECT p, y, 1 + CASE WHEN p >= q[4] THEN 4 WHEN p >= q[3] THEN 3 WHEN p >= q[2] THEN 2 WHEN p >= q[1] THEN 1 ELSE 0 END AS quintile FROM f, e)
    SELECT quintile, count(*) AS n, round(avg(y), 6) AS mean, round(median(y), 6) AS median, round(avg(CASE WHEN y < 0 THEN 1.0 ELSE 0 END), 6) AS failure_rate FROM b GROUP BY 1""",
)
def forecast_quintile_ladder(spark, sf):
    x = [F.get("embedding", i).cast("double") for i in range(2)]
    rows = table(spark, sf, "embeddings").select(x[0].alias("p"), (x[1] + x[0] / 4).alias("y"))
    edges = quantiles(rows, [], "p", {f"q{i}": i / 5 for i in range(1, 5)}, slices_for(spark, sf, "ladder.p", rows, "p"))
    quintile = F.lit(1)
    for i in range(1, 5):
        quintile = quintile + (F.col("p") >= F.col(f"q{i}")).cast("int")
    binned = rows.crossJoin(F.broadcast(edges)).select(quintile.alias("quintile"), "y")
    med = quantiles(binned, ["quintile"], "y", {"median": 0.5}, slices_for(spark, sf, "ladder.y", rows, "y"))
    base = binned.groupBy("quintile").agg(F.round(F.avg("y"), 6).alias("mean"), F.round(F.avg(F.when(F.col("y") < 0, 1.0).otherwise(0.0)), 6).alias("failure_rate"))
    return base.join(med, "quintile").withColumn("median", F.round("median", 6))


@query(
    "edge_proximity",
    f"""WITH {ATOMIC_SQL}, r AS (SELECT kind, max(distance) AS rim FROM atomic GROUP BY 1) SELECT a.kind, count(*) AS events, count(CASE WHEN rim - distance <= 0.1001 THEN 1 END) AS near_edge, round(sum(CASE WHEN rim - distance <= 0.1001 THEN magnitude ELSE 0 END) / sum(magnitude), 6) AS edge_mass FROM atomic a JOIN r ON a.kind = r.kind GROUP BY 1""",
)
def edge_proximity(spark, sf):
    # Changes of one distance stand or fall together, so the rim is found among their sums and the changes are read once.
    rows = atomic(spark, sf).groupBy("kind", "distance").agg(F.count(F.lit(1)).alias("n"), F.sum("magnitude").alias("mass"))
    rows = cut_lineage(rows)
    rim = rows.groupBy("kind").agg(F.max("distance").alias("rim"))
    near = F.col("rim") - F.col("distance") <= 0.1001
    return rows.join(rim, "kind").groupBy("kind").agg(
        F.sum("n").alias("events"), F.sum(F.when(near, F.col("n")).otherwise(0)).alias("near_edge"),
        F.round(F.sum(F.when(near, F.col("mass")).otherwise(0.0)) / F.sum("mass"), 6).alias("edge_mass"),
    )


@query(
    "latest_change_per_expiry",
    f"""WITH {GRID_SQL}, fr AS (SELECT slot, dense_rank() OVER (ORDER BY slot) AS frame, channel AS expiry, v FROM grid), m AS (SELECT max(frame) AS top FROM fr) SELECT a.frame, a.expiry, round(a.v - b.v, 6) AS change FROM fr a LEFT JOIN fr b ON b.expiry = a.expiry AND b.frame = a.frame - 1""",
)
def latest_change_per_expiry(spark, sf):
    g = grid(spark, sf)
    frames = ordered_scan(g.select("slot").distinct().withColumn("k", F.lit(0)), ["k"], ["slot"], slot_slices(spark, sf), {"frame": row_no()})
    fr = g.join(frames.select("slot", "frame"), "slot").select("frame", F.col("channel").alias("expiry"), "v")
    before = fr.select((F.col("frame") + 1).alias("frame"), "expiry", F.col("v").alias("pv"))
    return fr.join(before, ["frame", "expiry"], "left").select("frame", "expiry", F.round(F.col("v") - F.col("pv"), 6).alias("change"))


@query(
    "cluster_representative",
    """WITH s AS (SELECT p_brand AS cluster, p_partkey, p_size, p_retailprice FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS i FROM s) SELECT cluster, p_partkey AS representative FROM r WHERE i = 1""",
)
def cluster_representative(spark, sf):
    p = table(spark, sf, "part")
    best = F.struct("p_size", "p_retailprice", -F.col("p_partkey"))
    return p.groupBy(F.col("p_brand").alias("cluster")).agg(F.max_by("p_partkey", best).alias("representative"))


@query(
    "matched_controls",
    """WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority AS stratum, o_totalprice AS a, CAST(o_custkey AS DOUBLE) AS b, o_orderkey % 5 <> 0 AS quiet FROM orders),
    e AS (SELECT o_orderkey AS event_id, stratum, a, b FROM o WHERE o_orderstatus = 'F'), c AS (SELECT o_orderkey AS control_id, stratum, a, b, quiet FROM o WHERE o_orderstatus = 'P'),
    r AS (SELECT stratum, count(*) FILTER (WHERE quiet) AS n, min(a) FILTER (WHERE quiet) AS la, max(a) FILTER (WHERE quiet) AS ha, min(b) FILTER (WHERE quiet) AS lb, max(b) FILTER (WHERE quiet) AS hb FROM c GROUP BY 1),
    s AS (SELECT e.*, n, coalesce(nullif(greatest(ha, a) - least(la, a), 0), 1) AS sa, coalesce(nullif(greatest(hb, b) - least(lb, b), 0), 1) AS sb FROM e LEFT JOIN r ON r.stratum = e.stratum),
    d AS (SELECT s.event_id, c.control_id, ((s.a - c.a) / sa) ^ 2 + ((s.b - c.b) / sb) ^ 2 AS d FROM s JOIN c ON s.stratum = c.stratum AND c.quiet),
    m AS (SELECT event_id, arg_min(control_id, (d, control_id)) AS control_id, round(min(d), 8) AS distance FROM d GROUP BY 1)
    SELECT s.event_id, m.control_id, m.distance, CASE WHEN n IS NULL THEN 'no_same_stratum_candidates' WHEN n = 0 THEN 'no_quiet_same_stratum_candidates' END AS reason FROM s LEFT JOIN m ON m.event_id = s.event_id""",
)
def matched_controls(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("stratum"), F.col("o_totalprice").alias("a"), F.col("o_custkey").cast("double").alias("b"))
    events = o.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("event_id"), "stratum", "a", "b")
    controls = o.where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("control_id"), "stratum", "a", "b", (F.col("o_orderkey") % 5 != 0).alias("quiet"))
    out = nearest_control(events, controls, ["stratum"], ["a", "b"], "event_id", "control_id", "quiet")
    return out.select("event_id", "control_id", F.round("distance", 8).alias("distance"), "reason")


@query("relocation_pairs")
def relocation_pairs(spark, sf):
    valid = moves(spark, sf).where(F.col("invalid").isNull())
    bids, asks = (relocations(valid, ["instrument_id", "seq", "ts_us"], side, FAR, overlap=OVERLAP) for side in ("bids", "asks"))
    return bids.unionByName(asks)


@query(
    "correlation_clusters",
    """WITH RECURSIVE l AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)), p AS (SELECT a.i AS a, b.i AS b, corr(a.v, b.v) AS r FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2),
    e AS (SELECT a AS s, b AS d FROM p WHERE abs(r) >= 0.15 UNION ALL SELECT b, a FROM p WHERE abs(r) >= 0.15), g AS (SELECT i AS n, i AS reach FROM range(1, 65) t(i) UNION SELECT g.n, e.d FROM g JOIN e ON e.s = g.reach)
    SELECT n AS feature, min(reach) AS component FROM g GROUP BY 1""",
)
def correlation_clusters(spark, sf):
    from ..operators.association import correlations
    from ..operators.surfaces import correlation_clusters as clusters

    pairs = correlations(table(spark, sf, "embeddings"), "embedding")
    return clusters(pairs.where("a < b"), 0.15)


@query(
    "rolling_causal_fit",
    f"""WITH {GRID_SQL}, c AS (SELECT channel, slot, v, v - lag(v) OVER w AS x, lead(v) OVER w - v AS y FROM grid WINDOW w AS (PARTITION BY channel ORDER BY slot)) SELECT channel, slot, count(y) OVER f AS train_rows, CASE WHEN count(y) OVER f >= 10 THEN round(regr_slope(y, x) OVER f, 5) END AS slope FROM c WHERE x IS NOT NULL AND y IS NOT NULL WINDOW f AS (PARTITION BY channel ORDER BY slot RANGE BETWEEN 72 PRECEDING AND 2 PRECEDING)""",
)
def rolling_causal_fit(spark, sf):
    from ..operators.slices import nxt

    cuts = slot_slices(spark, sf)
    g = ordered_scan(grid(spark, sf), ["channel"], ["slot"], cuts, {"p": prev("v"), "n": nxt("v")}).select(
        "channel", "slot", (F.col("v") - F.col("p")).alias("x"), (F.col("n") - F.col("v")).alias("y")
    ).dropna()
    out = X.rolling_fit(g, ["channel"], "slot", "x", "y", 2, 72, cuts)
    return out.select("channel", "slot", "train_rows", F.when(F.col("train_rows") >= 10, F.round("slope", 5)).alias("slope"))


@query(
    "walk_forward_blocks",
    f"""WITH {TAPE_SQL}, o AS (SELECT min(ts_us) AS t0 FROM tape), b AS (SELECT CAST(floor((ts_us - t0) / {float(5 * DAY)}) AS BIGINT) AS block, ts_us, t0 FROM tape, o), k AS (SELECT DISTINCT block, t0 + block * {5 * DAY} AS start FROM b)
    SELECT k.block, (SELECT count(*) FROM b WHERE b.block = k.block) AS test_rows, (SELECT count(*) FROM tape WHERE ts_us <= start - {DAY}) AS train_rows FROM k""",
)
def walk_forward_blocks(spark, sf):
    from ..operators.asof import asof

    rows = tape(spark, sf).withColumn("k", F.lit(0))
    cuts = time_slices(spark, sf)
    origin = rows.agg(F.min("ts_us").alias("t0"))
    blocks = rows.crossJoin(F.broadcast(origin)).groupBy(F.floor((F.col("ts_us") - F.col("t0")) / float(5 * DAY)).alias("block"), "t0", "k").agg(F.count(F.lit(1)).alias("test_rows"))
    edges = blocks.withColumn("edge", F.col("t0") + F.col("block") * (5 * DAY) - DAY)
    counted = ordered_scan(rows.select("k", "ts_us", "seq"), ["k"], ["ts_us", "seq"], cuts, {"i": row_no()})
    out = asof(edges, counted, keys=["k"], left_ts="edge", right_ts="ts_us", values=["i"], slices=cuts, right_ties=["seq"])
    return out.select("block", "test_rows", F.coalesce("m_i", F.lit(0)).alias("train_rows"))


@query(
    "evidence_snapshot",
    f"""WITH {TAPE_SQL}, e AS (SELECT channel, count(*) AS n, min(seq) AS first FROM tape GROUP BY 1) SELECT channel, '{{"channel":"' || channel || '","first":' || CAST(first AS VARCHAR) || ',"n":' || CAST(n AS VARCHAR) || '}}' AS event, sha256('{{"channel":"' || channel || '","first":' || CAST(first AS VARCHAR) || ',"n":' || CAST(n AS VARCHAR) || '}}') AS identity FROM e""",
)
def evidence_snapshot(spark, sf):
    e = tape(spark, sf).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    event = F.to_json(F.struct("channel", "first", "n"))
    return e.select("channel", event.alias("event"), F.sha2(event, 256).alias("identity"))


@query(
    "dummy_design_moments",
    """SELECT CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END AS d_final, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0 END AS d_urgent, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(avg(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0 END), 6) AS interaction FROM orders GROUP BY 1, 2""",
)
def dummy_design_moments(spark, sf):
    a = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    b = F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)
    return table(spark, sf, "orders").groupBy(a.alias("d_final"), b.alias("d_urgent")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.avg(a * b), 6).alias("interaction")
    )


@query(
    "second_cross_structure",
    f"""WITH {TAPE_SQL}, s AS (SELECT channel, ts_us // {DAY} AS day, ts_us, seq, CASE WHEN value > 50 THEN 1 ELSE -1 END AS side FROM tape), c AS (SELECT *, CASE WHEN side <> lag(side) OVER (PARTITION BY channel, day ORDER BY ts_us, seq) THEN 1 ELSE 0 END AS x FROM s), d AS (SELECT channel, day, sum(x) AS crosses FROM c GROUP BY 1, 2)
    SELECT channel, CASE WHEN crosses = 0 THEN 'none' WHEN crosses = 1 THEN 'single' ELSE 'repeated' END AS structure, count(*) AS sessions FROM d GROUP BY 1, 2""",
)
def second_cross_structure(spark, sf):
    s = tape(spark, sf).select("channel", F.expr(f"ts_us div {DAY}").alias("day"), "ts_us", "seq", F.when(F.col("value") > 50, 1).otherwise(-1).alias("side"))
    c = ordered_scan(s, ["channel", "day"], ["ts_us", "seq"], time_slices(spark, sf), {"p": prev("side")})
    d = c.groupBy("channel", "day").agg(F.count(F.when(F.col("side") != F.col("p"), 1)).alias("crosses"))
    label = F.when(F.col("crosses") == 0, "none").when(F.col("crosses") == 1, "single").otherwise("repeated")
    return d.groupBy("channel", label.alias("structure")).agg(F.count(F.lit(1)).alias("sessions"))


def _assembled(spark, sf):
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    rows = wide(spark, sf).withColumn("y", F.col("f4") + 0.5 * F.col("f1") - 0.25 * F.col("f2")).withColumn("up", (F.col("y") > 0).cast("double"))
    rows = rows.withColumn("f3", F.when(F.col("vec_id") % 11 != 0, F.col("f3")))
    train = rows.where(F.col("vec_id") % 10 < 7)
    cols = ["f1", "f2", "f3"]
    from pyspark.ml import Pipeline

    prepared = Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=cols, outputCols=[f"i_{c}" for c in cols]),
            VectorAssembler(inputCols=[f"i_{c}" for c in cols], outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        ]
    ).fit(train)
    return prepared.transform(train), prepared.transform(rows.where(F.col("vec_id") % 10 >= 7))


@query("elastic_net_forecast")
def elastic_net_forecast(spark, sf):
    from pyspark.ml.regression import LinearRegression

    train, test = _assembled(spark, sf)
    model = LinearRegression(featuresCol="features", labelCol="y", regParam=0.001, elasticNetParam=0.5).fit(train)
    return model.transform(test).select("vec_id", "y", F.round("prediction", 6).alias("prediction"))


@query("logistic_direction")
def logistic_direction(spark, sf):
    from pyspark.ml.regression import GeneralizedLinearRegression

    train, test = _assembled(spark, sf)
    model = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features", labelCol="up").fit(train)
    return model.transform(test).select("vec_id", "up", F.round("prediction", 6).alias("probability"))


@query("shallow_boosted_trees")
def shallow_boosted_trees(spark, sf):
    from pyspark.ml.regression import GBTRegressor

    train, test = _assembled(spark, sf)
    model = GBTRegressor(featuresCol="features", labelCol="y", maxDepth=2, maxIter=10, seed=3).fit(train)
    return model.transform(test).select("vec_id", "y", F.round("prediction", 6).alias("prediction"))
