"""Distribution summaries, quantile conventions, grouping sets, rollups, audits and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.evaluation import net_of_cost_pnl, past_mirror_verdict, sign_accuracy
from ..operators.quantiles import LINEAR, NEAREST_RANK, ROUNDED_INDEX, auc_by_rank, quantiles, rank_correlation, weighted_quantile
from ..operators.slices import ordered_scan, prev, row_no
from .asof_queries import CLASSIFIED_SQL, stored_prints
from .bindings import DAY, HOUR, KEYS, TAPE_SQL, slices_for, table, tape, time_slices
from .registry import query


def value_slices(spark, sf):
    return slices_for(spark, sf, "tape.value", tape(spark, sf), "value")


@query(
    "magnitude_summary",
    f"""WITH {TAPE_SQL} SELECT channel, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90,
      round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS maximum FROM tape GROUP BY 1""",
)
def magnitude_summary(spark, sf):
    rows = tape(spark, sf)
    base = rows.groupBy("channel").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("maximum"))
    q = quantiles(rows, ["channel"], "value", {"median": 0.5, "p90": 0.9, "p99": 0.99}, value_slices(spark, sf))
    return base.join(q, "channel").select(
        "channel", "n", "mean", *[F.round(c, 6).alias(c) for c in ("median", "p90", "p99")], "maximum"
    )


@query(
    "quantiles_linear",
    f"""WITH {TAPE_SQL} SELECT instrument_id, count(*) AS n, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.33), 6) AS p33, round(quantile_cont(value, 0.95), 6) AS p95 FROM tape GROUP BY 1""",
)
def quantiles_linear(spark, sf):
    q = quantiles(tape(spark, sf), KEYS, "value", {"p05": 0.05, "p33": 0.33, "p95": 0.95}, value_slices(spark, sf), LINEAR)
    return q.select(*KEYS, "n", *[F.round(c, 6).alias(c) for c in ("p05", "p33", "p95")])


@query(
    "quantiles_nearest_rank",
    f"""WITH {TAPE_SQL} SELECT channel, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99 FROM tape GROUP BY 1""",
)
def quantiles_nearest_rank(spark, sf):
    return quantiles(tape(spark, sf), ["channel"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, value_slices(spark, sf), NEAREST_RANK)


@query(
    "quantiles_rounded_index",
    f"""WITH {TAPE_SQL}, l AS (SELECT channel, list_sort(list(value)) AS v, count(*) AS n FROM tape GROUP BY 1)
    SELECT channel, n, v[CAST(round_even((n - 1) * 0.05, 0) AS BIGINT) + 1] AS p05, v[CAST(round_even((n - 1) * 0.25, 0) AS BIGINT) + 1] AS p25,
      v[CAST(round_even((n - 1) * 0.75, 0) AS BIGINT) + 1] AS p75 FROM l""",
)
def quantiles_rounded_index(spark, sf):
    return quantiles(tape(spark, sf), ["channel"], "value", {"p05": 0.05, "p25": 0.25, "p75": 0.75}, value_slices(spark, sf), ROUNDED_INDEX)


@query(
    "weighted_quantile",
    f"""WITH {TAPE_SQL}, c AS (SELECT channel, value, sum(1 + seq % 7) OVER (PARTITION BY channel ORDER BY value) AS cum, sum(1 + seq % 7) OVER (PARTITION BY channel) AS tot FROM tape)
    SELECT channel, min(value) AS weighted_quantile FROM c WHERE cum >= 0.8 * tot GROUP BY 1""",
)
def weighted_quantile_query(spark, sf):
    rows = tape(spark, sf).withColumn("w", 1 + F.col("seq") % 7)
    return weighted_quantile(rows, ["channel"], "value", "w", 0.8, value_slices(spark, sf))


@query(
    "fixed_edge_histogram",
    f"""WITH {TAPE_SQL} SELECT channel, CASE WHEN value < 2 THEN '[0,2)' WHEN value < 10 THEN '[2,10)' WHEN value < 50 THEN '[10,50)' WHEN value < 100 THEN '[50,100)' WHEN value < 150 THEN '[100,150)' WHEN value < 200 THEN '[150,200)' ELSE '[200,inf)' END AS bin,
      count(*) AS n, round(sum(value), 2) AS total FROM tape GROUP BY 1, 2""",
)
def fixed_edge_histogram(spark, sf):
    from ..functions.book import TOUCH_SPREAD_EDGES, edge_label

    return tape(spark, sf).groupBy("channel", edge_label(F.col("value"), TOUCH_SPREAD_EDGES).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


_AGE = "CASE WHEN quote_age_ms IS NULL THEN 'missing' WHEN quote_age_ms <= 3600000 THEN 'fresh' WHEN quote_age_ms <= 14400000 THEN 'ageing' ELSE 'old' END"


@query(
    "alignment_grouping_sets",
    f"""WITH {CLASSIFIED_SQL}, o AS (SELECT *, coalesce(quote_channel, 'none') AS tier, CAST(((ts_us + 19800000000) % {DAY}) // {6 * HOUR} AS BIGINT) AS bucket, {_AGE} AS age_band FROM classified)
    SELECT tier, bucket, age_band, instrument_id, grouping(tier, bucket, age_band, instrument_id) AS level, count(*) AS prints, count(CASE WHEN side = 'buy' THEN 1 END) AS buys, count(CASE WHEN side = 'sell' THEN 1 END) AS sells,
      count(CASE WHEN degraded THEN 1 END) AS degraded_count, count(CASE WHEN coalesced THEN 1 END) AS coalesced_count, CAST(sum(volume_increment) AS BIGINT) AS increment_volume, CAST(sum(last_quantity) AS BIGINT) AS last_quantity_volume,
      round(sum(last_quantity) / CAST(sum(volume_increment) AS DOUBLE), 6) AS coverage FROM o GROUP BY GROUPING SETS ((), (tier), (bucket), (age_band), (instrument_id))""",
)
def alignment_grouping_sets(spark, sf):
    age = (
        F.when(F.col("quote_age_ms").isNull(), "missing").when(F.col("quote_age_ms") <= 3600000, "fresh")
        .when(F.col("quote_age_ms") <= 14400000, "ageing").otherwise("old")
    )
    rows = stored_prints(spark, sf).select(
        F.coalesce("quote_channel", F.lit("none")).alias("tier"),
        F.expr(f"((ts_us + 19800000000) % {DAY}) div {6 * HOUR}").alias("bucket"),
        age.alias("age_band"), "instrument_id", "side", "degraded", "coalesced", "volume_increment", "last_quantity",
    )
    keys = ["tier", "bucket", "age_band", "instrument_id"]
    return rows.groupingSets([[], *[[k] for k in keys]], *keys).agg(
        F.grouping_id().cast("long").alias("level"),
        F.count(F.lit(1)).alias("prints"),
        F.count(F.when(F.col("side") == "buy", 1)).alias("buys"),
        F.count(F.when(F.col("side") == "sell", 1)).alias("sells"),
        F.count(F.when(F.col("degraded"), 1)).alias("degraded_count"),
        F.count(F.when(F.col("coalesced"), 1)).alias("coalesced_count"),
        F.sum("volume_increment").alias("increment_volume"),
        F.sum("last_quantity").alias("last_quantity_volume"),
        F.round(F.sum("last_quantity") / F.sum("volume_increment"), 6).alias("coverage"),
    )


@query(
    "coverage_rollup",
    f"""WITH {TAPE_SQL}, g AS (SELECT channel, ts_us, ts_us - lag(ts_us) OVER (PARTITION BY channel ORDER BY ts_us, seq) AS gap FROM tape)
    SELECT channel, count(*) AS rows, min(ts_us) AS first_ts, max(ts_us) AS last_ts, max(gap) AS largest_gap, count(CASE WHEN gap > {2 * HOUR} THEN 1 END) AS long_gaps FROM g GROUP BY ROLLUP (channel)""",
)
def coverage_rollup(spark, sf):
    g = ordered_scan(tape(spark, sf), ["channel"], ["ts_us", "seq"], time_slices(spark, sf), {"p": prev("ts_us")}).withColumn(
        "gap", F.col("ts_us") - F.col("p")
    )
    return g.rollup("channel").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts_us").alias("first_ts"), F.max("ts_us").alias("last_ts"),
        F.max("gap").alias("largest_gap"), F.count(F.when(F.col("gap") > 2 * HOUR, 1)).alias("long_gaps"),
    )


@query(
    "time_of_day_rollup",
    f"""WITH {TAPE_SQL} SELECT channel, CAST(((ts_us + 19800000000) % {DAY}) // {HOUR} AS BIGINT) AS hour, count(*) AS n, round(avg(value), 6) AS mean FROM tape GROUP BY ROLLUP (1, 2)""",
)
def time_of_day_rollup(spark, sf):
    rows = tape(spark, sf).withColumn("hour", F.expr(f"((ts_us + 19800000000) % {DAY}) div {HOUR}"))
    return rows.rollup("channel", "hour").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    "replay_audit",
    f"""WITH {TAPE_SQL}, e AS (SELECT *, 1 + CAST(sum(CASE WHEN channel = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM tape)
    SELECT epoch, count(*) AS rows, min(seq) AS first_sequence, max(seq) AS last_sequence, min(ts_us) AS first_ts, max(ts_us) AS last_ts, count(DISTINCT instrument_id) AS instruments,
      count(CASE WHEN seq % 41 = 0 THEN 1 END) AS crossed_rows, count(CASE WHEN seq % 53 = 0 THEN 1 END) AS partial_rows FROM e GROUP BY 1""",
)
def replay_audit(spark, sf):
    from ..operators.slices import run_sum

    flag = F.when(F.col("channel") == "error", 1).otherwise(0).cast("long")
    rows = ordered_scan(tape(spark, sf), [], ["ts_us", "seq"], time_slices(spark, sf), {"e": run_sum(flag)})
    seq = F.col("seq")
    return rows.groupBy((F.col("e") + 1).alias("epoch")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first_sequence"), F.max("seq").alias("last_sequence"),
        F.min("ts_us").alias("first_ts"), F.max("ts_us").alias("last_ts"), F.count_distinct("instrument_id").alias("instruments"),
        F.count(F.when(seq % 41 == 0, 1)).alias("crossed_rows"), F.count(F.when(seq % 53 == 0, 1)).alias("partial_rows"),
    )


@query(
    "replication_receipt",
    f"""WITH {TAPE_SQL}, a AS (SELECT count(*) AS rows, count(CASE WHEN channel = 'view' THEN 1 END) AS depth20_rows, count(CASE WHEN channel = 'click' THEN 1 END) AS depth200_rows, count(DISTINCT instrument_id) AS instruments,
      (max(ts_us) - min(ts_us)) / 1000000.0 AS coverage_s FROM tape)
    SELECT rows, depth20_rows, depth200_rows, instruments, round(coverage_s, 3) AS coverage_s, CASE WHEN depth20_rows = 0 THEN 'missing_depth20' WHEN depth200_rows = 0 THEN 'missing_depth200' WHEN coverage_s < 86400 THEN 'short_coverage' WHEN instruments < 10 THEN 'thin_universe' ELSE 'accepted' END AS verdict FROM a""",
)
def replication_receipt(spark, sf):
    a = tape(spark, sf).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col("channel") == "view", 1)).alias("depth20_rows"),
        F.count(F.when(F.col("channel") == "click", 1)).alias("depth200_rows"),
        F.count_distinct("instrument_id").alias("instruments"),
        ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("coverage_s"),
    )
    from ..operators.orders import first_failing

    verdict = F.coalesce(
        first_failing(
            [
                ("missing_depth20", F.col("depth20_rows") == 0),
                ("missing_depth200", F.col("depth200_rows") == 0),
                ("short_coverage", F.col("coverage_s") < 86400),
                ("thin_universe", F.col("instruments") < 10),
            ]
        ),
        F.lit("accepted"),
    )
    return a.withColumn("verdict", verdict).withColumn("coverage_s", F.round("coverage_s", 3))


FORECAST_SQL = """f AS (SELECT vec_id AS row_id, label, CAST(embedding[1] AS DOUBLE) AS predicted, CAST(embedding[2] AS DOUBLE) + CAST(embedding[1] AS DOUBLE) / 4 AS actual,
  abs(CAST(embedding[3] AS DOUBLE)) / 2 AS spread FROM embeddings)"""


def forecasts(spark, sf):
    """Forecast rows: one per vector, the label is the tape."""
    e = F.col("embedding")
    x1, x2, x3 = (F.get(e, i).cast("double") for i in range(3))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), "label", x1.alias("predicted"), (x2 + x1 / 4).alias("actual"), (F.abs(x3) / 2).alias("spread")
    )


@query(
    "sign_accuracy",
    f"""WITH {FORECAST_SQL}, p AS (SELECT label, 'all_rows' AS panel, sign(predicted) AS p, sign(actual) AS y FROM f UNION ALL SELECT label, 'non_zero_moves', sign(predicted), sign(actual) FROM f WHERE actual <> 0),
    a AS (SELECT label, panel, count(*) AS n, count(CASE WHEN p = y THEN 1 END) AS hits, avg(CASE WHEN y > 0 THEN 1.0 ELSE 0 END) AS up, avg(CASE WHEN y < 0 THEN 1.0 ELSE 0 END) AS down, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0 END) AS flat FROM p GROUP BY 1, 2)
    SELECT label, panel, n, hits, round(hits / CAST(n AS DOUBLE), 6) AS hit_rate, round(greatest(up, down, flat), 6) AS majority_class_share, round(hits / CAST(n AS DOUBLE) - 0.5, 6) AS excess_over_coin_flip,
      round(hits / CAST(n AS DOUBLE) - greatest(up, down, flat), 6) AS excess_over_majority_class, round(sqrt(hits / CAST(n AS DOUBLE) * (1 - hits / CAST(n AS DOUBLE)) / n), 6) AS binomial_standard_error FROM a""",
)
def sign_accuracy_query(spark, sf):
    out = sign_accuracy(forecasts(spark, sf), ["label"], "predicted", "actual")
    rounded = ("hit_rate", "majority_class_share", "excess_over_coin_flip", "excess_over_majority_class", "binomial_standard_error")
    return out.select("label", "panel", "n", "hits", *[F.round(c, 6).alias(c) for c in rounded])


@query(
    "net_of_cost_pnl",
    f"""WITH {FORECAST_SQL}, s AS (SELECT *, CASE WHEN abs(predicted) > spread THEN sign(predicted) ELSE 0 END AS pos FROM f), t AS (SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY label ORDER BY row_id), 0)) AS turn FROM s),
    x AS (SELECT t.*, arm, pos * actual - CASE WHEN pos <> 0 AND half THEN spread ELSE 0 END AS net FROM t, (VALUES ('gross', false), ('half_spread_only', true)) a(arm, half))
    SELECT label, arm AS cost_arm, count(*) AS n, count(CASE WHEN pos <> 0 THEN 1 END) AS trades, round(sum(turn), 4) AS turnover, round(sum(net), 6) AS total_pnl, round(avg(CASE WHEN pos <> 0 THEN net END), 6) AS mean_pnl_per_trade,
      round(avg(net) / stddev_samp(net), 6) AS pnl_per_unit_risk FROM x GROUP BY 1, 2""",
)
def net_of_cost_pnl_query(spark, sf):
    rows = forecasts(spark, sf)
    cuts = slices_for(spark, sf, "embeddings.id", rows, "row_id")
    out = net_of_cost_pnl(rows, ["label"], ["row_id"], "predicted", "actual", "spread", cuts)
    return out.select(
        "label", "cost_arm", "n", "trades", F.round("turnover", 4).alias("turnover"), F.round("total_pnl", 6).alias("total_pnl"),
        F.round("mean_pnl_per_trade", 6).alias("mean_pnl_per_trade"), F.round("pnl_per_unit_risk", 6).alias("pnl_per_unit_risk"),
    )


@query(
    "association_table",
    """WITH v AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS f1, CAST(embedding[2] AS DOUBLE) AS f2, CAST(embedding[3] AS DOUBLE) AS f3, CAST(embedding[10] AS DOUBLE) + CAST(embedding[1] AS DOUBLE) AS t1, CAST(embedding[11] AS DOUBLE) - CAST(embedding[2] AS DOUBLE) AS t2 FROM embeddings),
    l AS (SELECT label, feature, target, fv, tv FROM (SELECT label, vec_id, unnest(['f1', 'f2', 'f3']) AS feature, unnest([f1, f2, f3]) AS fv, t1, t2 FROM v) x, LATERAL (SELECT unnest(['t1', 't2']) AS target, unnest([t1, t2]) AS tv) y)
    SELECT label, feature, target, count(*) AS n, round(corr(fv, tv), 6) AS pearson FROM l GROUP BY GROUPING SETS ((label, feature, target), (feature, target))""",
)
def association_table(spark, sf):
    from ..operators.association import pearson_table

    e = F.col("embedding")
    x = [F.get(e, i).cast("double") for i in range(11)]
    rows = table(spark, sf, "embeddings").select(
        "label", x[0].alias("f1"), x[1].alias("f2"), x[2].alias("f3"), (x[9] + x[0]).alias("t1"), (x[10] - x[1]).alias("t2")
    )
    by_label = pearson_table(rows, ["label"], ["f1", "f2", "f3"], ["t1", "t2"])
    overall = pearson_table(rows, [], ["f1", "f2", "f3"], ["t1", "t2"]).withColumn("label", F.lit(None).cast("int"))
    both = by_label.unionByName(overall)
    return both.select("label", "feature", "target", "n", F.round("pearson", 6).alias("pearson"))


@query(
    "spearman_association",
    f"""WITH {TAPE_SQL}, p AS (SELECT channel, floor(value) AS x, seq % 97 + floor(value / 10) AS y FROM tape),
    r AS (SELECT channel, (rank() OVER (PARTITION BY channel ORDER BY x)) + (count(*) OVER (PARTITION BY channel, x) - 1) / 2.0 AS rx, (rank() OVER (PARTITION BY channel ORDER BY y)) + (count(*) OVER (PARTITION BY channel, y) - 1) / 2.0 AS ry FROM p)
    SELECT channel, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1""",
)
def spearman_association(spark, sf):
    rows = tape(spark, sf).select("channel", F.floor("value").alias("x"), (F.col("seq") % 97 + F.floor(F.col("value") / 10)).alias("y"))
    out = rank_correlation(
        rows, ["channel"], "x", "y", slices_for(spark, sf, "spearman.x", rows, "x"), slices_for(spark, sf, "spearman.y", rows, "y")
    )
    return out.withColumn("spearman", F.round("spearman", 6))


@query(
    "rank_trend_against_index",
    f"""WITH {TAPE_SQL}, d AS (SELECT channel, ts_us // {DAY} AS day, avg(value) AS m FROM tape GROUP BY 1, 2), r AS (SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY day) AS i,
      (rank() OVER (PARTITION BY channel ORDER BY m)) + (count(*) OVER (PARTITION BY channel, m) - 1) / 2.0 AS r FROM d)
    SELECT channel, count(*) AS n, round(corr(i, r), 6) AS spearman FROM r GROUP BY 1""",
)
def rank_trend_against_index(spark, sf):
    daily = tape(spark, sf).groupBy("channel", F.expr(f"ts_us div {DAY}").alias("day")).agg(F.avg("value").alias("m"))
    out = rank_correlation(
        daily, ["channel"], "day", "m", slices_for(spark, sf, "trend.day", daily, "day"), slices_for(spark, sf, "trend.m", daily, "m")
    )
    return out.withColumn("spearman", F.round("spearman", 6))


@query(
    "classifier_diagnostics",
    f"""WITH {TAPE_SQL}, s AS (SELECT channel, seq, 1 / (1 + exp(-(value - 50) / 40)) AS p, CASE WHEN (value + seq % 60) > 70 THEN 1 ELSE 0 END AS y FROM tape),
    r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY p, seq) AS rk FROM s)
    SELECT channel, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc, round(avg((p - y) * (p - y)), 6) AS brier FROM r GROUP BY 1""",
)
def classifier_diagnostics(spark, sf):
    p = 1 / (1 + F.exp(-(F.col("value") - 50) / 40))
    y = F.when(F.col("value") + F.col("seq") % 60 > 70, 1).otherwise(0)
    rows = tape(spark, sf).select("channel", "seq", p.alias("p"), y.alias("y"))
    auc = auc_by_rank(rows, ["channel"], "p", "seq", "y", slices_for(spark, sf, "classifier.p", rows, "p"))
    brier = rows.groupBy("channel").agg(F.round(F.avg((F.col("p") - F.col("y")) ** 2), 6).alias("brier"))
    return auc.join(brier, "channel").withColumn("auc", F.round("auc", 6))


@query(
    "calibration_quintiles",
    f"""WITH {TAPE_SQL}, s AS (SELECT value AS p, CASE WHEN (value + seq % 60) > 70 THEN 1 ELSE 0 END AS y FROM tape), e AS (SELECT quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS q FROM s),
    b AS (SELECT p, y, 1 + CASE WHEN p >= q[4] THEN 4 WHEN p >= q[3] THEN 3 WHEN p >= q[2] THEN 2 WHEN p >= q[1] THEN 1 ELSE 0 END AS quintile FROM s, e)
    SELECT quintile, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS positive_rate FROM b GROUP BY 1""",
)
def calibration_quintiles(spark, sf):
    rows = tape(spark, sf).select(F.col("value").alias("p"), F.when(F.col("value") + F.col("seq") % 60 > 70, 1).otherwise(0).alias("y"))
    edges = quantiles(rows, [], "p", {f"q{i}": i / 5 for i in range(1, 5)}, value_slices(spark, sf))
    # One row of four edges: its size does not depend on the data.
    joined = rows.crossJoin(F.broadcast(edges))
    quintile = F.lit(1)
    for i in range(1, 5):
        quintile = quintile + (F.col("p") >= F.col(f"q{i}")).cast("int")
    return joined.groupBy(quintile.alias("quintile")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_score"), F.round(F.avg("y"), 6).alias("positive_rate")
    )


@query(
    "support_by_tape_and_split",
    """WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings), c AS (SELECT *, CASE WHEN rn <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS split FROM r)
    SELECT label, count(CASE WHEN split = 'train' THEN 1 END) AS train, count(CASE WHEN split = 'test' THEN 1 END) AS test FROM c GROUP BY 1""",
)
def support_by_tape_and_split(spark, sf):
    from ..operators.slices import total

    rows = table(spark, sf, "embeddings").select("label", "vec_id")
    cuts = slices_for(spark, sf, "embeddings.vec", rows, "vec_id")
    r = ordered_scan(rows, ["label"], ["vec_id"], cuts, {"rn": row_no(), "n": total(F.lit(1))})
    split = F.when(F.col("rn") <= F.floor(F.col("n") * 0.7), "train").otherwise("test")
    return r.groupBy("label").agg(
        F.count(F.when(split == "train", 1)).alias("train"), F.count(F.when(split == "test", 1)).alias("test")
    )


@query(
    "two_proportion_test",
    f"""WITH {TAPE_SQL}, c AS (SELECT CASE WHEN instrument_id % 2 = 0 THEN 'a' ELSE 'b' END AS arm, count(*) AS n, count(CASE WHEN value > 60 THEN 1 END) AS s FROM tape GROUP BY 1),
    p AS (SELECT max(CASE WHEN arm = 'a' THEN n END) AS n1, max(CASE WHEN arm = 'b' THEN n END) AS n2, max(CASE WHEN arm = 'a' THEN s END) AS s1, max(CASE WHEN arm = 'b' THEN s END) AS s2 FROM c)
    SELECT round(s1 / CAST(n1 AS DOUBLE), 6) AS rate_a, round(s2 / CAST(n2 AS DOUBLE), 6) AS rate_b,
      round((s1 / CAST(n1 AS DOUBLE) - s2 / CAST(n2 AS DOUBLE)) / sqrt(((s1 + s2) / CAST(n1 + n2 AS DOUBLE)) * (1 - (s1 + s2) / CAST(n1 + n2 AS DOUBLE)) * (1.0 / n1 + 1.0 / n2)), 6) AS z FROM p""",
)
def two_proportion_test(spark, sf):
    from ..operators.association import two_proportion_z

    a, hit = F.col("instrument_id") % 2 == 0, F.col("value") > 60
    c = tape(spark, sf).agg(
        F.count(F.when(a, 1)).alias("n1"), F.count(F.when(~a, 1)).alias("n2"),
        F.count(F.when(a & hit, 1)).alias("s1"), F.count(F.when(~a & hit, 1)).alias("s2"),
    )
    return c.select(
        F.round(F.col("s1") / F.col("n1"), 6).alias("rate_a"), F.round(F.col("s2") / F.col("n2"), 6).alias("rate_b"),
        F.round(two_proportion_z("s1", "n1", "s2", "n2"), 6).alias("z"),
    )


@query(
    "past_mirror_verdicts",
    """WITH c AS (SELECT label, corr(CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE)) AS fut, corr(CAST(embedding[1] AS DOUBLE), CAST(embedding[3] AS DOUBLE)) AS past FROM embeddings GROUP BY 1)
    SELECT label, CASE WHEN fut IS NULL OR past IS NULL THEN 'unevaluable' WHEN abs(fut) > abs(past) THEN 'passes' ELSE 'fails_past_mirror' END AS verdict, CASE WHEN fut > past THEN 'passes' ELSE 'fails_past_mirror' END AS signed_verdict FROM c""",
)
def past_mirror_verdicts(spark, sf):
    x = [F.get("embedding", i).cast("double") for i in range(3)]
    c = table(spark, sf, "embeddings").groupBy("label").agg(F.corr(x[0], x[1]).alias("fut"), F.corr(x[0], x[2]).alias("past"))
    return c.select(
        "label", past_mirror_verdict(F.col("fut"), F.col("past"), two_sided=True).alias("verdict"),
        past_mirror_verdict(F.col("fut"), F.col("past")).alias("signed_verdict"),
    )


@query(
    "effective_sample_size",
    f"""WITH {TAPE_SQL}, d AS (SELECT channel, ts_us // {DAY} AS day, avg(value) AS v FROM tape GROUP BY 1, 2), l AS (SELECT channel, v, lag(v, 1) OVER w AS l1, lag(v, 2) OVER w AS l2, lag(v, 3) OVER w AS l3 FROM d WINDOW w AS (PARTITION BY channel ORDER BY day)),
    c AS (SELECT channel, count(*) AS n, corr(v, l1) AS r1, corr(v, l2) AS r2, corr(v, l3) AS r3 FROM l GROUP BY 1)
    SELECT channel, n, round(n / greatest(1 + 2 * (0.75 * r1 + 0.5 * r2 + 0.25 * r3), 1.0 / n), 6) AS effective_n FROM c""",
)
def effective_sample_size(spark, sf):
    from ..operators.inference import effective_size

    daily = tape(spark, sf).groupBy("channel", F.expr(f"ts_us div {DAY}").alias("day")).agg(F.avg("value").alias("v"))
    out = effective_size(daily, ["channel"], ["day"], "v", 3, slices_for(spark, sf, "trend.day", daily, "day"))
    return out.select("channel", "n", F.round("effective_n", 6).alias("effective_n"))


@query(
    "latest_row_per_instrument",
    f"""WITH {TAPE_SQL} SELECT instrument_id, max(seq) AS seq, arg_max(channel, seq) AS channel, arg_max(value, seq) AS value, count(*) - 1 AS coalesced FROM tape GROUP BY 1""",
)
def latest_row_per_instrument(spark, sf):
    return (
        tape(spark, sf).groupBy("instrument_id")
        .agg(F.max_by(F.struct("seq", "channel", "value"), "seq").alias("r"), (F.count(F.lit(1)) - 1).alias("coalesced"))
        .select("instrument_id", "r.*", "coalesced")
    )


@query(
    "first_row_per_grid_bucket",
    f"""WITH {TAPE_SQL} SELECT instrument_id, ts_us // {5 * HOUR} AS bucket, min(seq) AS first_seq, arg_min(value, (ts_us, seq)) AS first_value, arg_max(value, (ts_us, seq)) AS last_value FROM tape GROUP BY 1, 2""",
)
def first_row_per_grid_bucket(spark, sf):
    order = F.struct("ts_us", "seq")
    return tape(spark, sf).groupBy("instrument_id", F.expr(f"ts_us div {5 * HOUR}").alias("bucket")).agg(
        F.min("seq").alias("first_seq"), F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value")
    )


@query(
    "round_robin_universe",
    """WITH c AS (SELECT p_partkey, p_size AS strike, p_type AS expiry FROM part WHERE p_size BETWEEN 25 * 0.5 AND 25 * 1.5), r AS (SELECT *, row_number() OVER (PARTITION BY expiry ORDER BY abs(strike - 25), p_partkey) AS rn FROM c)
    SELECT p_partkey, strike, expiry FROM r ORDER BY rn, expiry LIMIT 60""",
)
def round_robin_universe(spark, sf):
    from ..operators.ranking import round_robin

    parts = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("strike"), F.col("p_type").alias("expiry"))
    near = parts.where(F.col("strike").between(25 * 0.5, 25 * 1.5)).withColumn("distance", F.abs(F.col("strike") - 25))
    return round_robin(near, "expiry", ["distance", "p_partkey"], 60).select("p_partkey", "strike", "expiry")


@query(
    "cell_rankings",
    f"""WITH {TAPE_SQL}, c AS (SELECT channel, instrument_id, round(avg(value), 6) AS metric FROM tape GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY metric DESC, instrument_id) AS rank FROM c)
    SELECT channel, instrument_id, metric, rank FROM r WHERE rank <= 5""",
)
def cell_rankings(spark, sf):
    from ..operators.ranking import top_k

    c = tape(spark, sf).groupBy("channel", "instrument_id").agg(F.round(F.avg("value"), 6).alias("metric"))
    return top_k(c, ["channel"], [("metric", False), ("instrument_id", True)], 5)


@query(
    "threshold_grid_selection",
    """WITH q AS (SELECT o_custkey AS expiry, CAST(o_orderdate AS DATE) AS date, o_orderkey, o_totalprice / 500000 AS q, CAST(round(o_totalprice * 100) AS BIGINT) - 15000000 AS pnl FROM orders), t AS (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS threshold),
    s AS (SELECT CAST(threshold AS DOUBLE) AS threshold, expiry, arg_min(pnl, (date, o_orderkey)) AS pnl FROM q, t WHERE q < threshold GROUP BY 1, 2)
    SELECT threshold, count(*) AS n, CAST(sum(pnl - 200000) AS DOUBLE) / 100000 AS total, round(CAST(sum(pnl - 200000) AS DOUBLE) / count(*) / 100000, 6) AS mean, round(avg(CASE WHEN pnl > 200000 THEN 1.0 ELSE 0 END), 6) AS win_rate FROM s GROUP BY 1""",
)
def threshold_grid_selection(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("expiry"), F.to_date("o_orderdate").alias("date"), "o_orderkey",
        (F.col("o_totalprice") / 500000).alias("q"), (F.round(F.col("o_totalprice") * 100).cast("long") - 15_000_000).alias("pnl"),
    )
    passing = F.filter(F.array(*[F.lit(t) for t in (0.2, 0.4, 0.6, 0.8)]), lambda t: F.col("q") < t)
    first = o.withColumn("threshold", F.explode(passing)).groupBy("threshold", "expiry").agg(
        F.min_by("pnl", F.struct("date", "o_orderkey")).alias("pnl")
    )
    # Profits are whole hundred-thousandths, so that sums are exact in any order.
    net = F.col("pnl") - 200_000
    total = F.sum(net).cast("double")
    return first.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n"), (total / 100_000).alias("total"), F.round(total / F.count(F.lit(1)) / 100_000, 6).alias("mean"),
        F.round(F.avg(F.when(net > 0, 1.0).otherwise(0.0)), 6).alias("win_rate"),
    )


@query(
    "common_sample_intersection",
    """WITH u AS (SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') SELECT id FROM u""",
)
def common_sample_intersection(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_linestatus") == "O").alias("o")
    )
    ok = table(spark, sf, "orders").where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("id"))
    return li.where("a AND o").select("id").join(ok, "id", "left_semi")


@query(
    "complete_family_check",
    """WITH e AS (SELECT c_custkey AS id FROM customer), o AS (SELECT DISTINCT o_custkey + 3 AS id FROM orders),
    g AS (SELECT 'missing' AS problem, id FROM (SELECT id FROM e EXCEPT SELECT id FROM o) UNION ALL SELECT 'unexpected', id FROM (SELECT id FROM o EXCEPT SELECT id FROM e))
    SELECT problem, count(*) AS ids FROM g GROUP BY 1""",
)
def complete_family_check(spark, sf):
    from ..operators.grids import family_gaps

    expected = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    observed = table(spark, sf, "orders").select((F.col("o_custkey") + 3).alias("id"))
    return family_gaps(expected, observed, ["id"]).groupBy("problem").agg(F.count(F.lit(1)).alias("ids"))


@query(
    "paired_loss_comparison",
    """WITH a AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS p, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings WHERE vec_id % 9 <> 0), b AS (SELECT vec_id, CAST(embedding[3] AS DOUBLE) AS p, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings WHERE vec_id % 7 <> 0)
    SELECT count(*) AS common_rows, round(avg((a.p - a.y) * (a.p - a.y)), 6) AS loss_a, round(avg((b.p - b.y) * (b.p - b.y)), 6) AS loss_b, round(avg((a.p - a.y) * (a.p - a.y) - (b.p - b.y) * (b.p - b.y)), 6) AS mean_difference,
      round(avg(CASE WHEN abs(a.p - a.y) < abs(b.p - b.y) THEN 1.0 ELSE 0 END), 6) AS a_better FROM a JOIN b USING (vec_id)""",
)
def paired_loss_comparison(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", *[F.get("embedding", i).cast("double").alias(f"x{i}") for i in range(3)])
    a = e.where(F.col("vec_id") % 9 != 0).select("vec_id", (F.col("x0") - F.col("x1")).alias("ea"))
    b = e.where(F.col("vec_id") % 7 != 0).select("vec_id", (F.col("x2") - F.col("x1")).alias("eb"))
    la, lb = F.col("ea") ** 2, F.col("eb") ** 2
    return a.join(b, "vec_id").agg(
        F.count(F.lit(1)).alias("common_rows"), F.round(F.avg(la), 6).alias("loss_a"), F.round(F.avg(lb), 6).alias("loss_b"),
        F.round(F.avg(la - lb), 6).alias("mean_difference"),
        F.round(F.avg(F.when(F.abs("ea") < F.abs("eb"), 1.0).otherwise(0.0)), 6).alias("a_better"),
    )
