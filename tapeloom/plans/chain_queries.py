"""Option-chain queries over a minute panel derived from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import options as O
from ..operators import chain as K
from ..operators.slices import nxt, ordered_scan
from .bindings import slices_for, table
from .registry import query

QUOTES_SQL = """raw AS (SELECT strftime(l_shipdate, '%Y-%m') AS date, year(l_shipdate) * 12 + month(l_shipdate) AS m, CASE WHEN l_suppkey % 2 = 0 THEN '09:20' ELSE '15:29' END AS clock,
  CASE WHEN l_linenumber % 2 = 0 THEN 'CALL' ELSE 'PUT' END AS side, CAST(20000 + 50 * (l_partkey % 31 - 15) AS DOUBLE) AS strike, l_quantity AS oi, l_extendedprice AS volume, l_discount, l_tax FROM lineitem),
spots AS (SELECT *, CAST(20000 + (m * 37) % 700 - 350 AS DOUBLE) AS spot FROM raw),
priced AS (SELECT date, clock, side, strike, spot, volume, oi, greatest(CASE WHEN side = 'CALL' THEN spot - strike ELSE strike - spot END, 0) + 20 + round(l_discount * 100) AS close, 10 + round(l_tax * 100) + abs(strike - spot) / 100 AS iv FROM spots),
panel AS (SELECT date, clock, side, strike, b.volume AS volume, b.close AS close, b.iv AS iv, b.oi AS oi, b.spot AS spot FROM (SELECT date, clock, side, strike, max({'volume': volume, 'close': close, 'iv': iv, 'oi': oi, 'spot': spot}) AS b FROM priced GROUP BY 1, 2, 3, 4)),
pairs AS (SELECT date, clock, strike, any_value(spot) AS spot, max(CASE WHEN side = 'CALL' THEN close END) AS c, max(CASE WHEN side = 'PUT' THEN close END) AS p FROM panel GROUP BY 1, 2, 3)"""


def quotes(spark, sf):
    """Row-wise option quotes: month as session, line number as side, part as strike."""
    t = F.col("l_shipdate")
    m = F.year(t) * 12 + F.month(t)
    spot = (F.lit(20000) + (m * 37) % 700 - 350).cast("double")
    strike = (20000 + 50 * (F.col("l_partkey") % 31 - 15)).cast("double")
    side = F.when(F.col("l_linenumber") % 2 == 0, "CALL").otherwise("PUT")
    intrinsic = F.greatest(F.when(side == "CALL", spot - strike).otherwise(strike - spot), F.lit(0.0))
    return table(spark, sf, "lineitem").select(
        F.date_format(t, "yyyy-MM").alias("date"),
        F.when(F.col("l_suppkey") % 2 == 0, "09:20").otherwise("15:29").alias("clock"),
        side.alias("side"), strike.alias("strike"), spot.alias("spot"),
        F.col("l_extendedprice").alias("volume"), F.col("l_quantity").alias("oi"),
        (intrinsic + 20 + F.round(F.col("l_discount") * 100)).alias("close"),
        (10 + F.round(F.col("l_tax") * 100) + F.abs(strike - spot) / 100).alias("iv"),
    )


KEY = ["date", "clock", "side", "strike"]


def panel(spark, sf):
    return K.best_quote_per_minute(quotes(spark, sf), KEY, "volume", ["volume", "close", "iv", "oi", "spot"])


def strike_slices(spark, sf):
    return slices_for(spark, sf, "chain.strike", quotes(spark, sf).select("strike"), "strike")


@query("best_quote_per_contract_minute", f"WITH {QUOTES_SQL} SELECT * FROM panel")
def best_quote_per_contract_minute(spark, sf):
    return panel(spark, sf)


@query(
    "parity_pairs",
    f"WITH {QUOTES_SQL} SELECT date, clock, strike, round(strike + c - p, 4) AS parity_forward, round(c - p, 4) AS call_minus_put FROM pairs WHERE c IS NOT NULL AND p IS NOT NULL",
)
def parity_pairs(spark, sf):
    s = K.sides(panel(spark, sf), ["date", "clock"], ["close"]).where(F.col("call_close").isNotNull() & F.col("put_close").isNotNull())
    d = F.col("call_close") - F.col("put_close")
    return s.select("date", "clock", "strike", F.round(F.col("strike") + d, 4).alias("parity_forward"), F.round(d, 4).alias("call_minus_put"))


@query(
    "nearest_listed_strike",
    f"WITH {QUOTES_SQL} SELECT date, clock, arg_min(strike, (abs(strike - spot), strike)) AS atm_strike FROM pairs WHERE c IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2",
)
def nearest_listed_strike(spark, sf):
    return K.nearest_listed_strike(panel(spark, sf), ["date", "clock"])


@query(
    "straddle_pnl",
    f"""WITH {QUOTES_SQL}, a AS (SELECT date, arg_min(strike, (abs(strike - spot), strike)) AS atm FROM pairs WHERE clock = '09:20' AND c IS NOT NULL AND p IS NOT NULL GROUP BY 1)
    SELECT a.date, atm AS atm_strike, e.c + e.p AS entry_premium, x.c + x.p AS exit_premium, x.c + x.p - e.c - e.p AS buyer_pnl, round(100 * (x.c + x.p - e.c - e.p) / (e.c + e.p), 6) AS buyer_return_pct
    FROM a JOIN pairs e ON e.date = a.date AND e.strike = atm AND e.clock = '09:20' JOIN pairs x ON x.date = a.date AND x.strike = atm AND x.clock = '15:29' WHERE x.c IS NOT NULL AND x.p IS NOT NULL""",
)
def straddle_pnl(spark, sf):
    return K.straddle_pnl(panel(spark, sf), "09:20", "15:29").withColumn("buyer_return_pct", F.round("buyer_return_pct", 6))


@query(
    "overnight_straddle",
    f"""WITH {QUOTES_SQL}, d AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM panel)), a AS (SELECT date, arg_min(strike, (abs(strike - spot), strike)) AS atm FROM pairs WHERE clock = '15:29' AND c IS NOT NULL AND p IS NOT NULL GROUP BY 1)
    SELECT a.date, nd AS next_date, atm AS atm_strike, e.c + e.p AS entry_premium, x.c + x.p AS exit_premium, e.c + e.p - x.c - x.p AS seller_pnl FROM a JOIN d ON a.date = d.date JOIN pairs e ON e.date = a.date AND e.strike = atm AND e.clock = '15:29'
    JOIN pairs x ON x.date = nd AND x.strike = atm AND x.clock = '09:20' WHERE x.c IS NOT NULL AND x.p IS NOT NULL""",
)
def overnight_straddle(spark, sf):
    p = panel(spark, sf)
    dates = p.select("date", F.replace("date", F.lit("-"), F.lit("")).cast("long").alias("d")).distinct().withColumn("k", F.lit(0))
    calendar = ordered_scan(dates, ["k"], ["d"], slices_for(spark, sf, "chain.date", dates, "d"), {"next_date": nxt("date")})
    atm = K.nearest_listed_strike(p.where(F.col("clock") == "15:29"), ["date"])
    both = K.sides(p, ["date", "clock"], ["close"]).withColumn("premium", F.col("call_close") + F.col("put_close"))
    entry = both.where(F.col("clock") == "15:29").select("date", F.col("strike").alias("atm_strike"), F.col("premium").alias("entry_premium"))
    leave = both.where(F.col("clock") == "09:20").select(F.col("date").alias("next_date"), F.col("strike").alias("atm_strike"), F.col("premium").alias("exit_premium"))
    out = atm.join(calendar.select("date", "next_date"), "date").join(entry, ["date", "atm_strike"]).join(leave, ["next_date", "atm_strike"])
    return out.where(F.col("exit_premium").isNotNull()).select(
        "date", "next_date", "atm_strike", "entry_premium", "exit_premium", (F.col("entry_premium") - F.col("exit_premium")).alias("seller_pnl")
    )


@query(
    "put_call_ratio",
    f"WITH {QUOTES_SQL}, s AS (SELECT date, sum(CASE WHEN side = 'CALL' THEN oi END) AS c, sum(CASE WHEN side = 'PUT' THEN oi END) AS p FROM panel WHERE clock = '09:20' GROUP BY 1) SELECT date, c AS call_oi, p AS put_oi, round(p / c, 6) AS pcr FROM s WHERE c > 0 AND p > 0",
)
def put_call_ratio(spark, sf):
    return K.put_call_ratio(panel(spark, sf).where(F.col("clock") == "09:20"), ["date"]).withColumn("pcr", F.round("pcr", 6))


@query(
    "max_pain",
    f"""WITH {QUOTES_SQL}, o AS (SELECT date, strike, coalesce(sum(CASE WHEN side = 'CALL' THEN oi END), 0) AS c, coalesce(sum(CASE WHEN side = 'PUT' THEN oi END), 0) AS p FROM panel WHERE clock = '09:20' GROUP BY 1, 2),
    l AS (SELECT a.date, a.strike, sum(b.c * greatest(a.strike - b.strike, 0) + b.p * greatest(b.strike - a.strike, 0)) AS loss FROM o a JOIN o b ON a.date = b.date GROUP BY 1, 2)
    SELECT date, arg_min(strike, (round(loss, 6), strike)) AS max_pain, round(min(loss), 4) AS payout FROM l GROUP BY 1""",
)
def max_pain(spark, sf):
    return K.max_pain(panel(spark, sf).where(F.col("clock") == "09:20"), ["date"], strike_slices(spark, sf))


@query(
    "forward_consensus",
    f"""WITH {QUOTES_SQL}, x AS (SELECT date, clock, strike + c - p AS f FROM pairs WHERE c IS NOT NULL AND p IS NOT NULL AND (strike - floor(spot / 50 + 0.5) * 50) / 50 IN (-4, -3, -2, -1, 1, 2, 3, 4)),
    a AS (SELECT date, clock, count(*) AS pairs, median(f) AS m, max(f) - min(f) AS d FROM x GROUP BY 1, 2)
    SELECT date, clock, pairs, CASE WHEN pairs >= 5 THEN round(m, 6) END AS forward, CASE WHEN pairs >= 5 THEN round(d, 6) END AS dispersion, CASE WHEN pairs < 5 THEN 'fewer_than_five_fresh_exatm_pairs' END AS reason FROM a""",
)
def forward_consensus(spark, sf):
    s = K.sides(panel(spark, sf), ["date", "clock", "spot"], ["close"])
    out = K.forward_consensus(s, ["date", "clock"], "spot")
    return out.withColumn("forward", F.round("forward", 6)).withColumn("dispersion", F.round("dispersion", 6))


@query(
    "forward_selection",
    f"""WITH {QUOTES_SQL}, fut AS (SELECT DISTINCT date, clock, spot + 5 AS future FROM panel WHERE CAST(substr(date, 6, 2) AS INTEGER) % 3 = 0), par AS (SELECT date, clock, arg_min(strike + c - p, (abs(c - p), strike)) AS pf FROM pairs WHERE c IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2)
    SELECT coalesce(fut.date, par.date) AS date, coalesce(fut.clock, par.clock) AS clock, round(coalesce(future, pf), 6) AS forward, CASE WHEN future IS NOT NULL THEN 'future' WHEN pf IS NOT NULL THEN 'parity' ELSE 'unresolved' END AS source FROM fut FULL JOIN par ON fut.date = par.date AND fut.clock = par.clock""",
)
def forward_selection(spark, sf):
    p = panel(spark, sf)
    futures = p.where(F.substring("date", 6, 2).cast("int") % 3 == 0).select("date", "clock", (F.col("spot") + 5).alias("future")).distinct()
    out = K.select_forward(futures, K.sides(p, ["date", "clock"], ["close"]), ["date", "clock"])
    return out.withColumn("forward", F.round("forward", 6))


@query(
    "gamma_exposure_by_width",
    f"""WITH {QUOTES_SQL}, g AS (SELECT date, side, abs(round((strike - floor(spot / 50 + 0.5) * 50) / 50)) AS o, exp(-0.5 * ((ln(spot / strike) + (0.065 + 0.5 * (iv / 100) ^ 2) * 0.05) / (iv / 100 * sqrt(0.05))) ^ 2) / sqrt(2 * pi()) / (spot * iv / 100 * sqrt(0.05)) * oi * spot * spot * 0.01 AS g FROM panel WHERE clock = '09:20'),
    w AS (SELECT date, width, coalesce(sum(CASE WHEN side = 'CALL' AND o <= width THEN g END), 0) AS c, coalesce(sum(CASE WHEN side = 'PUT' AND o <= width THEN g END), 0) AS p FROM g, (VALUES (5), (10), (15)) v(width) GROUP BY 1, 2)
    SELECT date, width, round(c, 3) AS gamma_call, round(p, 3) AS gamma_put, round(c - p, 3) AS net, CASE WHEN c + p > 0 THEN round((c - p) / (c + p), 6) END AS imbalance FROM w""",
)
def gamma_exposure_by_width(spark, sf):
    out = K.gamma_exposure(panel(spark, sf).where(F.col("clock") == "09:20"), ["date"], 0.05, 0.065, [5, 10, 15])
    return out.select("date", "width", *[F.round(c, 3).alias(c) for c in ("gamma_call", "gamma_put", "net")], F.round("imbalance", 6).alias("imbalance"))


@query(
    "strike_side_pivot",
    f"WITH {QUOTES_SQL} SELECT date, strike, max(CASE WHEN side = 'CALL' THEN oi END) AS call_oi, max(CASE WHEN side = 'PUT' THEN oi END) AS put_oi, max(CASE WHEN side = 'CALL' THEN iv END) AS call_iv, max(CASE WHEN side = 'PUT' THEN iv END) AS put_iv FROM panel WHERE clock = '15:29' GROUP BY 1, 2",
)
def strike_side_pivot(spark, sf):
    return K.sides(panel(spark, sf).where(F.col("clock") == "15:29"), ["date"], ["oi", "iv"])


@query(
    "opening_iv_by_clock_pivot",
    f"WITH {QUOTES_SQL} SELECT date, round(avg(CASE WHEN clock = '09:20' THEN iv END), 6) AS iv_0920, round(avg(CASE WHEN clock = '15:29' THEN iv END), 6) AS iv_1529 FROM panel WHERE abs(strike - spot) <= 100 GROUP BY 1",
)
def opening_iv_by_clock_pivot(spark, sf):
    near = panel(spark, sf).where(F.abs(F.col("strike") - F.col("spot")) <= 100)
    wide = near.groupBy("date").pivot("clock", ["09:20", "15:29"]).agg(F.round(F.avg("iv"), 6))
    return wide.select("date", F.col("`09:20`").alias("iv_0920"), F.col("`15:29`").alias("iv_1529"))


@query(
    "volume_flow_features",
    f"""WITH {QUOTES_SQL}, s AS (SELECT date, strike, sum(volume) AS v FROM panel GROUP BY 1, 2), h AS (SELECT date, count(*) AS items, sum(v * v) / (sum(v) * sum(v)) AS hh FROM s GROUP BY 1), f AS (SELECT date, ln(1 + sum(volume)) AS lv, sum(CASE WHEN side = 'CALL' THEN volume ELSE 0 END) / sum(volume) AS cs, sum(oi) AS oi FROM panel GROUP BY 1),
    d AS (SELECT *, oi - lag(oi) OVER (ORDER BY date) AS oi_change FROM f) SELECT d.date, items, round(hh, 8) AS herfindahl, round(lv, 6) AS log_volume, round(cs, 6) AS call_share, oi_change FROM d JOIN h ON d.date = h.date""",
)
def volume_flow_features(spark, sf):
    from ..operators.slices import prev

    p = panel(spark, sf)
    h = K.concentration(p, ["date"], ["strike"], "volume")
    f = p.groupBy("date").agg(
        F.log(1 + F.sum("volume")).alias("lv"), (F.sum(F.when(F.col("side") == "CALL", F.col("volume")).otherwise(0.0)) / F.sum("volume")).alias("cs"), F.sum("oi").alias("oi"),
    ).withColumn("d", F.replace("date", F.lit("-"), F.lit("")).cast("long")).withColumn("k", F.lit(0))
    stepped = ordered_scan(f, ["k"], ["d"], slices_for(spark, sf, "chain.date", f, "d"), {"before": prev("oi")})
    return stepped.join(h, "date").select(
        "date", "items", F.round("herfindahl", 8).alias("herfindahl"), F.round("lv", 6).alias("log_volume"), F.round("cs", 6).alias("call_share"),
        (F.col("oi") - F.col("before")).alias("oi_change"),
    )


@query(
    "option_eligibility_ladder",
    f"""WITH {QUOTES_SQL}, r AS (SELECT CASE WHEN close <= 25 THEN 'price_too_small' WHEN abs(strike - spot) > 500 THEN 'outside_strike_window' WHEN iv <= 0 THEN 'non_positive_iv' WHEN oi < 10 THEN 'thin_open_interest' ELSE 'eligible' END AS reason FROM panel) SELECT reason, count(*) AS contracts FROM r GROUP BY 1""",
)
def option_eligibility_ladder(spark, sf):
    reason = K.eligibility(
        [
            ("price_too_small", F.col("close") <= 25),
            ("outside_strike_window", F.abs(F.col("strike") - F.col("spot")) > 500),
            ("non_positive_iv", F.col("iv") <= 0),
            ("thin_open_interest", F.col("oi") < 10),
        ]
    )
    return panel(spark, sf).groupBy(F.coalesce(reason, F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("contracts"))


@query(
    "gamma_column",
    f"""WITH {QUOTES_SQL} SELECT date, clock, side, strike, round(1000 * exp(-0.5 * ((ln(spot / strike) + (0.065 + 0.5 * (iv / 100) ^ 2) * 0.05) / (iv / 100 * sqrt(0.05))) ^ 2) / sqrt(2 * pi()) / (spot * iv / 100 * sqrt(0.05)), 8) AS gamma FROM panel""",
)
def gamma_column(spark, sf):
    g = O.gamma(F.col("spot"), F.col("strike"), F.lit(0.05), F.lit(0.065), F.col("iv") / 100.0)
    return panel(spark, sf).select(*KEY, F.round(1000 * g, 8).alias("gamma"))


@query(
    "put_call_parity_of_model_prices",
    f"""WITH {QUOTES_SQL} SELECT DISTINCT date, clock, strike, round(exp(-0.055 * 0.05) * (spot - strike), 5) AS call_minus_put FROM panel""",
)
def put_call_parity_of_model_prices(spark, sf):
    rows = panel(spark, sf).groupBy("date", "clock", "strike", "spot").agg(F.max("iv").alias("iv"))
    years, rate, vol = F.lit(0.05), F.lit(0.055), F.col("iv") / 100.0
    c = O.black76(F.col("spot"), F.col("strike"), years, vol, rate, F.lit(True))
    p = O.black76(F.col("spot"), F.col("strike"), years, vol, rate, F.lit(False))
    priced = rows.withColumn("c", c).withColumn("p", p)
    return priced.select("date", "clock", "strike", F.round(F.col("c") - F.col("p"), 5).alias("call_minus_put"))


@query(
    "implied_volatility_round_trip",
    f"WITH {QUOTES_SQL} SELECT date, clock, side, strike, round(iv / 100, 5) AS implied_volatility FROM panel",
)
def implied_volatility_round_trip(spark, sf):
    years, rate = F.lit(0.05), F.lit(0.055)
    # Out-of-the-money prices carry the volatility; parity moves the rest there first.
    otm = F.when(F.col("spot") >= F.col("strike"), F.lit(False)).otherwise(F.lit(True))
    rows = panel(spark, sf).withColumn("otm", otm).withColumn("v", F.col("iv") / 100.0)
    priced = rows.withColumn("price", O.black76(F.col("spot"), F.col("strike"), years, F.col("v"), rate, F.col("otm")))
    iv = O.implied_vol(F.col("price"), F.col("spot"), F.col("strike"), years, rate, F.col("otm"))
    return priced.withColumn("x", iv).select(*KEY, F.round("x", 5).alias("implied_volatility"))


PARAM_SQL = f"""{QUOTES_SQL}, dates AS (SELECT DISTINCT date, CAST(replace(date, '-', '') AS BIGINT) AS d FROM panel),
params AS (SELECT date, 0.01 + (d % 7) * 0.002 AS theta, -0.1 - (d % 5) * 0.1 AS rho, 0.06 + (d % 4) * 0.01 AS psi FROM dates)"""


def params(spark, sf):
    d = F.replace("date", F.lit("-"), F.lit("")).cast("long")
    return panel(spark, sf).select("date").distinct().select(
        "date", (0.01 + (d % 7) * 0.002).alias("theta"), (-0.1 - (d % 5) * 0.1).alias("rho"), (0.06 + (d % 4) * 0.01).alias("psi")
    )


@query(
    "surface_total_variance",
    f"""WITH {PARAM_SQL}, g AS (SELECT p.date, theta, rho, psi, strike, ln(strike / spot) AS k FROM params p JOIN (SELECT DISTINCT date, strike, spot FROM panel) q ON p.date = q.date)
    SELECT date, strike, round(0.5 * (theta + rho * psi * k + sqrt((psi * k + theta * rho) ^ 2 + theta ^ 2 * (1 - rho ^ 2))), 8) AS total_variance, psi * (1 + abs(rho)) <= 4 AND psi ^ 2 * (1 + abs(rho)) <= 4 * theta AS arbitrage_free, round(sqrt(theta / 0.05), 6) AS atm_level,
      round(rho * psi / (2 * sqrt(theta / 0.05) * 0.05), 6) AS atm_skew FROM g""",
)
def surface_total_variance(spark, sf):
    strikes = panel(spark, sf).select("date", "strike", "spot").distinct()
    theta, rho, psi = F.col("theta"), F.col("rho"), F.col("psi")
    k = F.log(F.col("strike") / F.col("spot"))
    shape = O.atm_shape(theta, rho, psi, F.lit(0.05))
    return strikes.join(params(spark, sf), "date").select(
        "date", "strike", F.round(O.total_variance(k, theta, rho, psi), 8).alias("total_variance"),
        O.slice_is_arbitrage_free(theta, rho, psi).alias("arbitrage_free"),
        F.round(shape["level"], 6).alias("atm_level"), F.round(shape["skew"], 6).alias("atm_skew"),
    )


@query("surface_slice_fit", f"WITH {PARAM_SQL} SELECT date, round(theta, 3) AS theta, round(rho, 2) AS rho, round(psi, 3) AS psi FROM params")
def surface_slice_fit(spark, sf):
    """Fit recovers the parameters that generated each session's total variances."""
    strikes = panel(spark, sf).select("date", "strike", "spot").distinct()
    k = F.log(F.col("strike") / F.col("spot"))
    points = strikes.join(params(spark, sf), "date").select(
        "date", k.alias("k"), O.total_variance(k, F.col("theta"), F.col("rho"), F.col("psi")).alias("w")
    )
    fits = K.fit_slices(points, ["date"], "k", "w")
    return fits.select("date", F.round("theta", 3).alias("theta"), F.round("rho", 2).alias("rho"), F.round("psi", 3).alias("psi"))


@query(
    "calendar_and_butterfly_checks",
    f"""WITH {PARAM_SQL}, g AS (SELECT date, theta, rho, psi, i / 50.0 AS k FROM params, range(-10, 11) t(i)), w AS (SELECT *, 0.5 * (theta + rho * psi * k + sqrt((psi * k + theta * rho) ^ 2 + theta ^ 2 * (1 - rho ^ 2))) AS w FROM g),
    n AS (SELECT *, lag(w) OVER (PARTITION BY date ORDER BY k) AS wl, lead(w) OVER (PARTITION BY date ORDER BY k) AS wr FROM w), d AS (SELECT *, (wr - wl) / 0.04 AS w1, (wr - 2 * w + wl) / 0.0004 AS w2 FROM n WHERE wl IS NOT NULL AND wr IS NOT NULL)
    SELECT date, count(*) AS points, round(min((1 - k * w1 / (2 * w)) ^ 2 - w1 * w1 / 4 * (1 / w + 0.25) + w2 / 2), 5) AS least_density FROM d GROUP BY 1""",
)
def calendar_and_butterfly_checks(spark, sf):
    k = F.col("i") / 50.0
    theta, rho, psi = F.col("theta"), F.col("rho"), F.col("psi")
    grid = params(spark, sf).withColumn("i", F.explode(F.sequence(F.lit(-9), F.lit(9))))
    w, wl, wr = (O.total_variance(x, theta, rho, psi) for x in (k, k - 0.02, k + 0.02))
    rows = grid.select("date", k.alias("k"), w.alias("w"), ((wr - wl) / 0.04).alias("w1"), ((wr - 2 * w + wl) / 0.0004).alias("w2"))
    g = O.butterfly_density(F.col("k"), F.col("w"), F.col("w1"), F.col("w2"))
    return rows.groupBy("date").agg(F.count(F.lit(1)).alias("points"), F.round(F.min(g), 5).alias("least_density"))


@query(
    "parity_feature_columns",
    f"""WITH {QUOTES_SQL}, b AS (SELECT date, strike, c, p, spot, spot - (strike + c - p) AS raw, strike - 20000 AS slow FROM pairs WHERE clock = '09:20' AND c IS NOT NULL AND p IS NOT NULL)
    SELECT date, strike, round(raw, 6) AS basis, round(-(raw - slow), 6) AS pressure, round(-(raw - slow) / (c + 0.25), 6) AS fair_quality, CASE WHEN sign(raw) = sign(slow) THEN 1.0 ELSE 0.0 END AS agreement, floor(spot / 50 + 0.5) * 50 AS atm_strike,
      round((p - c) - 0.5 * (spot - strike), 6) AS hedged_markout, round(10000 * (c - p) / spot, 6) AS difference_bp FROM b""",
)
def parity_feature_columns(spark, sf):
    s = K.sides(panel(spark, sf).where(F.col("clock") == "09:20"), ["date", "spot"], ["close"]).where(
        F.col("call_close").isNotNull() & F.col("put_close").isNotNull()
    )
    c, p, spot, k = F.col("call_close"), F.col("put_close"), F.col("spot"), F.col("strike")
    raw, slow = O.basis(spot, k + c - p), k - 20000
    pressure = O.parity_pressure(raw, slow)
    return s.select(
        "date", "strike", F.round(raw, 6).alias("basis"), F.round(pressure, 6).alias("pressure"), F.round(O.fair_quality(pressure, c), 6).alias("fair_quality"),
        O.sign_agreement(raw, slow).alias("agreement"), O.nearest_strike(spot).alias("atm_strike"),
        F.round(O.hedged_markout(c, p, F.lit(0.5), k, spot), 6).alias("hedged_markout"), F.round(O.basis_points(c, p) / spot, 6).alias("difference_bp"),
    )


@query(
    "leg_costs",
    f"""WITH {QUOTES_SQL} SELECT date, side, round(sum(20 + close * oi * 0.00035 + CASE WHEN side = 'PUT' THEN close * oi * 0.001 ELSE 0 END), 2) AS cost, round(avg(100 * (20 + close * oi * 0.00035 + CASE WHEN side = 'PUT' THEN close * oi * 0.001 ELSE 0 END) / (close * oi)), 6) AS cost_pct FROM panel GROUP BY 1, 2""",
)
def leg_costs(spark, sf):
    cost = O.leg_cost(F.col("close"), F.col("oi"), 20.0, 0.00035, 0.001, F.col("side") == "PUT")
    return panel(spark, sf).groupBy("date", "side").agg(
        F.round(F.sum(cost), 2).alias("cost"), F.round(F.avg(O.cost_fraction(cost, F.col("close"), F.col("oi"))), 6).alias("cost_pct")
    )


@query(
    "snapshot_union_cache",
    f"""WITH {QUOTES_SQL}, u AS (SELECT date, clock, side, strike, close, volume FROM priced WHERE clock = '09:20' UNION ALL SELECT date, '09:20', side, strike, close, volume + 1 FROM priced WHERE clock = '15:29')
    SELECT date, clock, side, strike, b.volume AS volume, b.close AS close FROM (SELECT date, clock, side, strike, max({{'volume': volume, 'close': close}}) AS b FROM u GROUP BY 1, 2, 3, 4)""",
)
def snapshot_union_cache(spark, sf):
    q = quotes(spark, sf).select("date", "clock", "side", "strike", "close", "volume")
    late = q.where(F.col("clock") == "15:29").withColumn("clock", F.lit("09:20")).withColumn("volume", F.col("volume") + 1)
    both = q.where(F.col("clock") == "09:20").unionByName(late)
    return K.best_quote_per_minute(both, KEY, "volume", ["volume", "close"])


@query(
    "sessions_to_expiry",
    """WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), n AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM s), e AS (SELECT date, i FROM n WHERE dayofweek(date) = 4)
    SELECT n.date, e.date AS expiry, e.i - n.i AS sessions, n.date = e.date AS is_expiry FROM n ASOF LEFT JOIN e ON n.date <= e.date""",
)
def sessions_to_expiry(spark, sf):
    from ..operators.slices import first_from, row_no

    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    d = d.withColumn("d", F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long")).withColumn("k", F.lit(0))
    cuts = slices_for(spark, sf, "orders.day", d, "d")
    n = ordered_scan(d, ["k"], ["d"], cuts, {"i": row_no()})
    e = ordered_scan(n, ["k"], ["d"], cuts, {"e": first_from(F.when(F.dayofweek("date") == 5, F.struct("date", "i")))})
    return e.select(
        "date", F.col("e.date").alias("expiry"), (F.col("e.i") - F.col("i")).alias("sessions"), (F.col("date") == F.col("e.date")).alias("is_expiry")
    )
