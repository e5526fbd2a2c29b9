"""Quantile conventions, inference, regressions and option numbers against independent formulas."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import options as O
from tapeloom.operators import inference as I
from tapeloom.operators import nulls as N
from tapeloom.operators import quantiles as Q
from tapeloom.operators import regression as G
from tapeloom.operators.chain import fit_slices
from tapeloom.operators.folds import embargoed_split, expanding_folds
from tapeloom.operators.history import past_session_percentiles
from tapeloom.operators.slices import Slices
from tapeloom.operators.surfaces import connected_components, correlation_clusters


def test_three_quantile_conventions(spark):
    rng = random.Random(1)
    values = [float(rng.randrange(30)) for _ in range(101)] + [5.0] * 60
    df = spark.createDataFrame([(v,) for v in values], "v double")
    cuts, s, n = Slices.plan(df, "v", rows_per_slice=20), sorted(values), len(values)
    p = {"a": 0.05, "b": 0.5, "c": 0.93}
    lin = Q.quantiles(df, [], "v", p, cuts, Q.LINEAR).first()
    near = Q.quantiles(df, [], "v", p, cuts, Q.NEAREST_RANK).first()
    idx = Q.quantiles(df, [], "v", p, cuts, Q.ROUNDED_INDEX).first()
    for k, x in p.items():
        assert lin[k] == pytest.approx(np.quantile(values, x))
        assert near[k] == s[max(math.ceil(x * n) - 1, 0)]
        assert idx[k] == s[round((n - 1) * x)]


def test_rank_correlation_with_ties(spark):
    rng = random.Random(2)
    rows = [(g, float(rng.randrange(8)), float(rng.randrange(8))) for g in ("u", "w") for _ in range(80)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r["spearman"] for r in Q.rank_correlation(df, ["g"], "x", "y", Slices((2.0, 5.0)), Slices((3.0,))).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(part["x"].rank().corr(part["y"].rank()))


def test_newey_west(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=60)) * 0.2 + rng.normal(size=60)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "g int, t long, v double")
    r = I.newey_west_mean(df, ["g"], ["t"], "v", 4, Slices((10.0, 40.0))).first()
    u, n = x - x.mean(), len(x)
    lr = u @ u / n + sum(2 * (1 - k / 5) * (u[k:] @ u[:-k]) / n for k in range(1, 5))
    assert r["long_run_variance"] == pytest.approx(lr) and r["standard_error"] == pytest.approx(math.sqrt(lr / n))


def test_multiplicity(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005, None])], "family string, id int, p double")
    r = {x["id"]: x for x in I.adjust_p_values(df, ["family"], "p", "id").collect()}
    assert [round(r[i]["holm"], 6) for i in range(4)] == [0.03, 0.06, 0.06, 0.02]
    assert [round(r[i]["benjamini_hochberg"], 6) for i in range(4)] == [0.02, 0.04, 0.04, 0.02]
    assert r[4]["holm"] is None
    h = sum(1 / k for k in range(1, 5))
    assert r[3]["benjamini_yekutieli"] == pytest.approx(min(0.005 * 4 * h, 0.01 * 4 * h / 2, 1.0))


def test_bootstrap_is_sane_and_repeatable(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([("g", int(b), int(i), float(v)) for i, (b, v) in enumerate(zip(np.repeat(range(60), 5), rng.normal(1.0, 2.0, 300)))], "g string, b int, i long, v double")
    one = I.block_bootstrap_mean(df, ["g"], ["b"], "v", 400, 7).first()
    two = I.block_bootstrap_mean(df.repartition(3), ["g"], ["b"], "v", 400, 7).first()
    assert one["bootstrap_se"] == pytest.approx(two["bootstrap_se"])
    means = df.groupBy("b").agg(F.avg("v").alias("m")).toPandas()["m"]
    assert one["bootstrap_se"] == pytest.approx(means.std() / math.sqrt(60), rel=0.2)
    assert one["lower"] < one["mean"] < one["upper"]


def test_shuffle_within_bucket_is_a_permutation(spark):
    df = spark.createDataFrame([(i % 3, i, float(i)) for i in range(90)], "b int, i long, v double")
    out = N.shuffle_within_bucket(df, ["b"], "i", "v", 5, Slices((2**29, 2**30)))
    rows = out.collect()
    assert sorted(r["v"] for r in rows) == [float(i) for i in range(90)]
    assert all(int(r["v"]) % 3 == r["b"] for r in rows) and any(r["v"] != r["i"] for r in rows)


def test_regression_from_moments(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 2))
    y = 1.5 + x @ np.array([2.0, -1.0]) + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(int(i % 4 == 0), float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "s int, a double, b double, y double")
    train, test = df.where("s = 0"), df.where("s = 1")
    fits = G.fit(train, [], ["a", "b"], "y", [0.0, 5.0])
    beta = fits.where("alpha = 0").first()["coefficients"]
    mask = np.arange(200) % 4 != 0
    want = np.linalg.lstsq(np.column_stack([np.ones(mask.sum()), x[mask]]), y[mask], rcond=None)[0]
    assert beta == pytest.approx(list(want), rel=1e-8)
    s = G.score_from_moments(G.moments(test, [], ["a", "b"], "y"), fits.where("alpha = 0"), [], ["a", "b"]).first()
    pred = want[0] + x[~mask] @ want[1:]
    assert s["oos_r2"] == pytest.approx(1 - np.sum((y[~mask] - pred) ** 2) / np.sum((y[~mask] - y[mask].mean()) ** 2))
    flat = df.withColumn("b", F.col("a") * 2)
    assert G.fit(flat, [], ["a", "b"], "y").first()["coefficients"] is None


def test_splits_leave_an_embargo(spark):
    df = spark.createDataFrame([("t", i, i) for i in range(100)], "tape string, ts long, seq long")
    out = embargoed_split(df, "tape", "ts", "seq", Slices((30.0, 60.0)), train_fraction=0.7, embargo=10).groupBy("split").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    assert {r["split"]: (r["a"], r["b"]) for r in out.collect()} == {"train": (0, 69), "embargo": (70, 79), "test": (80, 99)}
    folds = expanding_folds(df.select(F.col("ts").alias("s")), "s", 3, 2, 40, Slices((50.0,))).toPandas()
    for _, part in folds.groupby("fold"):
        assert part[part.role == "train"].s.max() <= part[part.role == "test"].s.min() - 3
    assert folds[folds.role == "test"].s.is_unique


def test_past_sessions_only(spark):
    rng = random.Random(6)
    data = [("g", s, float(rng.randrange(6))) for s in range(5) for _ in range(40)]
    df = spark.createDataFrame(data, "g string, s long, v double")
    for r in past_session_percentiles(df, ["g"], "s", "v", Slices((2.0, 4.0))).collect():
        past = [v for _, s, v in data if s < r["s"]]
        assert r["history_n"] == len(past) and r["at_or_below"] == sum(v <= r["v"] for v in past)


def test_options(spark):
    df = spark.createDataFrame([(100.0, 105.0, 0.25, 0.3, 0.05, True), (100.0, 95.0, 0.25, 0.3, 0.05, False)], "f double, k double, t double, v double, r double, c boolean")
    args = [F.col(x) for x in ("f", "k", "t")]
    p = df.withColumn("p", O.black76(*args, F.col("v"), F.col("r"), F.col("c")))
    back = p.withColumn("iv", O.implied_vol(F.col("p"), *args, F.col("r"), F.col("c"))).collect()
    for row in back:
        d1 = math.log(row["f"] / row["k"]) / (0.3 * 0.5) + 0.5 * 0.3 * 0.5
        cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
        sgn = 1 if row["c"] else -1
        want = math.exp(-0.05 * 0.25) * sgn * (row["f"] * cdf(sgn * d1) - row["k"] * cdf(sgn * (d1 - 0.15)))
        assert row["p"] == pytest.approx(want) and row["iv"] == pytest.approx(0.3)
    bad = df.withColumn("iv", O.implied_vol(F.lit(200.0), *args, F.col("r"), F.col("c"))).collect()
    assert all(r["iv"] is None for r in bad)


def test_surface_fit_refuses_thin_slices(spark):
    k = np.linspace(-0.2, 0.2, 9)
    w = 0.5 * (0.04 - 0.3 * 0.2 * k + np.sqrt((0.2 * k - 0.04 * 0.3) ** 2 + 0.04**2 * (1 - 0.09)))
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(k, w)] + [("b", 0.0, 0.04)], "g string, k double, w double")
    got = {r["g"]: r for r in fit_slices(df, ["g"], "k", "w").collect()}
    assert (got["a"]["theta"], got["a"]["rho"], got["a"]["psi"]) == pytest.approx((0.04, -0.3, 0.2), rel=1e-3)
    assert got["b"]["theta"] is None and got["b"]["reason"] == "fewer_than_five_usable_strikes"


def test_components_and_clusters(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "n long")
    chain = [(i, i + 1) for i in range(0, 30)] + [(35, 36)]
    edges = spark.createDataFrame(chain + [(b, a) for a, b in chain], "src long, dst long")
    got = {r["n"]: r["component"] for r in connected_components(nodes, edges, "n").collect()}
    assert all(got[i] == 0 for i in range(31)) and got[36] == 35 and got[33] == 33
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.95), ("c", "d", 0.1)], "a string, b string, r double")
    clusters = {r["feature"]: r["component"] for r in correlation_clusters(pairs, 0.8).collect()}
    assert clusters == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_error_function_and_literal_option_values(spark):
    import math

    x = np.linspace(-7, 7, 20_011)
    assert np.abs(O._erf(x) - np.array([math.erf(v) for v in x])).max() < 4e-16
    assert np.isnan(O._erf(np.array([np.nan]))[0])
    rows = spark.createDataFrame([(100.0, 100.0, 1.0, 0.2, 0.05, True), (105.0, 100.0, 0.5, 0.3, 0.02, False)], "f double, k double, t double, v double, r double, c boolean")
    got = rows.select(O.black76(*[F.col(c) for c in "fktvrc"]).alias("p")).collect()
    assert got[0].p == pytest.approx(7.577082146427274, abs=1e-12) and got[1].p == pytest.approx(6.32173589008192, abs=1e-12)


def test_nearest_quiet_control_equals_brute_force(spark):
    from tapeloom.operators.matching import nearest_control

    rng = np.random.default_rng(3)
    events = [(i, int(rng.integers(0, 6)), float(rng.normal(0, 3)), float(rng.normal())) for i in range(150)]
    controls = [(1000 + i, int(rng.integers(0, 4)), float(np.round(rng.normal(), 1)), 2.5 if i % 3 else float(rng.normal()), bool(rng.random() < 0.6)) for i in range(300)]
    controls += [(2000, 4, 0.0, 0.0, False)]
    e = spark.createDataFrame(events, "e long, g int, a double, b double")
    c = spark.createDataFrame(controls, "c long, g int, a double, b double, quiet boolean")
    got = {r.e: (r.c, r.distance, r.reason) for r in nearest_control(e, c, ["g"], ["a", "b"], "e", "c", "quiet").collect()}
    assert len(got) == len(events)
    for i, g, *x in events:
        same = [r for r in controls if r[1] == g]
        calm = [r for r in same if r[4]]
        if not calm:
            assert got[i] == (None, None, "no_quiet_same_stratum_candidates" if same else "no_same_stratum_candidates")
            continue
        spans = [max(x[j], *[r[2 + j] for r in calm]) - min(x[j], *[r[2 + j] for r in calm]) or 1.0 for j in range(2)]
        best = min((sum(((x[j] - r[2 + j]) / spans[j]) ** 2 for j in range(2)), r[0]) for r in calm)
        assert got[i][0] == best[1] and got[i][1] == pytest.approx(best[0]) and got[i][2] is None


def test_chain_fit_keeps_to_training_and_leaks_to_dropped_states(spark):
    from tapeloom.operators.regression import stoikov_adjustment

    rows = [("a", "b", 1.0, 5)] * 10 + [("a", "z", 0.0, 5)] * 10 + [("b", "a", -1.0, 5)] * 5 + [("b", "z", 2.0, 5)] * 15 + [("z", "a", 0.0, 5)] * 3
    rows += [("a", "a", 99.0, 10)] * 50
    frame = spark.createDataFrame(rows, "state string, next_state string, mid_change_ticks double, resolved_ts long")
    got = {r.state: r for r in stoikov_adjustment(frame, until=10).collect()}
    want = np.linalg.solve(np.eye(2) - np.array([[0, 0.5], [0.25, 0]]), [0.5, 1.25])
    assert [got[s].adjustment for s in "ab"] == pytest.approx(list(want))
    assert (got["a"].transitions, got["z"].estimated, got["z"].adjustment, got["a"].converged) == (20, False, None, True)
    endless = spark.createDataFrame([("a", "a", 1.0, 1)] * 12, frame.schema)
    r = stoikov_adjustment(endless).first()
    assert (r.converged, r.adjustment) == (False, 1.0)


def test_order_events_need_their_pending_change(spark):
    from tapeloom.operators.orders import illegal_transitions
    from tapeloom.operators.slices import Slices

    story = [
        ("acknowledged", "BrokerAcknowledged"), ("acknowledged", "CancelRequested"), ("cancelled", "CancelAccepted"), ("cancelled", "CancelAccepted"),
        ("acknowledged", "BrokerAcknowledged"), ("acknowledged", "ModifyAccepted"), ("acknowledged", "ModifyRequested"), ("acknowledged", "CancelRequested"),
        ("acknowledged", "ModifyRejected"), ("filled", "FillUpdate"), ("filled", "CancelAccepted"),
    ]
    rows = [(1, i, s, e) for i, (s, e) in enumerate(story[:4])] + [(2, i, s, e) for i, (s, e) in enumerate(story[4:])]
    frame = spark.createDataFrame(rows, "k long, n long, s string, e string")
    bad = illegal_transitions(frame, "k", "n", "s", "e", Slices((2.0, 4.0))).collect()
    # The refused cancel request of order 2 still stands in the given events, so its late cancel is known.
    assert sorted((r.k, r.e, r.pending) for r in bad) == [(2, "CancelRequested", "modify"), (2, "ModifyAccepted", "none"), (2, "ModifyRejected", "cancel")]
