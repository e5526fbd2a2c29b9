"""Gram-matrix models against plain solvers."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import gram as G

P = 6


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, P)) @ (np.eye(P) + 0.4 * rng.normal(size=(P, P))) + 2.0
    y = x[:, 0] - 0.7 * x[:, 3] + rng.normal(size=240)
    rows = [(i, i % 8, int(i >= 160), x[i].tolist(), float(y[i])) for i in range(240)]
    odd = [(900, 1, 0, None, 1.0), (901, 1, 0, [1.0], 1.0), (902, 1, 0, [1.0] * 5 + [float("nan")], 1.0), (903, 1, 0, [1.0] * 6, None), (904, 1, 0, [1.0] * 5 + [None], 1.0)]
    return x, y, spark.createDataFrame(rows + odd, "i long, b int, side int, x array<double>, y double").repartition(5)


def test_grams_are_cross_products(data):
    x, y, df = data
    got = {r.block: np.array(r.gram).reshape(P + 2, P + 2) for r in G.block_grams(df, "b", "x", "y", P).collect()}
    z = np.c_[np.ones(240), x, y]
    assert set(got) == set(range(8))
    for b, g in got.items():
        assert np.allclose(g, z[b::8].T @ z[b::8])


def plain_net(x, y, alpha, ratio):
    z, t = (x - x.mean(axis=0)) / x.std(axis=0), y - y.mean()
    b = np.zeros(x.shape[1])
    for _ in range(5000):
        before = b.copy()
        for j in range(len(b)):
            rest = z[:, j] @ (t - z @ b + z[:, j] * b[j]) / len(t)
            b[j] = np.sign(rest) * max(abs(rest) - alpha * ratio, 0) / (1 + alpha * (1 - ratio))
        if np.abs(b - before).max() < 1e-12:
            break
    return b


def test_paths_and_frequencies_equal_plain_descent(data):
    x, y, df = data
    grams = G.block_grams(df, "b", "x", "y", P)
    paths = G.elastic_net_paths(grams, P, [0.02, 0.3], 0.5, replicates=5)
    got = {(r.replicate, r.alpha, r.feature): r.coefficient for r in paths.collect()}
    assert len(got) == 6 * 2 * P
    chosen = {0: set(range(8))}
    for r in range(1, 6):
        chosen[r] = set(sorted(range(8), key=lambda b: md5(f"7:{r}:{b}".encode()).hexdigest())[:4])
    for r, blocks in chosen.items():
        at = np.isin(np.arange(240) % 8, list(blocks))
        for alpha in (0.02, 0.3):
            want = plain_net(x[at], y[at], alpha, 0.5)
            assert np.allclose([got[r, alpha, j] for j in range(P)], want, atol=1e-7)
    for f in G.selection_frequency(paths).collect():
        assert f.frequency == np.mean([got[r, f.alpha, f.feature] != 0 for r in range(1, 6)]) and f.coefficient == got[0, f.alpha, f.feature]
    checks = G.optimality(df, "x", "y", P, paths, 0.5).collect()
    assert len(checks) == 2 * P and all(c.satisfied for c in checks) and any(c.active for c in checks) and any(not c.active for c in checks)
    worse = paths.withColumn("raw", F.col("raw") + F.when(F.col("feature") == 0, 0.1).otherwise(0.0))
    assert not all(c.satisfied for c in G.optimality(df, "x", "y", P, worse, 0.5).collect())


def plain_ridge(x, y, alpha):
    scale = x.std(axis=0)
    z = (x - x.mean(axis=0)) / scale
    b = np.linalg.solve(z.T @ z / len(y) + alpha / len(y) * np.eye(x.shape[1]), z.T @ (y - y.mean()) / len(y)) / scale
    return y.mean() - b @ x.mean(axis=0), b


@pytest.mark.parametrize("alpha", [0.0, 12.0])
def test_dropped_clusters_equal_refits(data, alpha):
    x, y, df = data
    clusters = [[0], [1, 2], [3, 4, 5]]
    got = {r.cluster: r for r in G.cluster_usefulness(G.block_grams(df, "side", "x", "y", P), P, clusters, alpha).collect()}
    mean = y[:160].mean()

    def r2(keep):
        a, b = plain_ridge(x[:160][:, keep], y[:160], alpha)
        return 1 - ((y[160:] - a - x[160:][:, keep] @ b) ** 2).sum() / ((y[160:] - mean) ** 2).sum()

    full = r2(list(range(P)))
    assert got[-1].full_r2 == pytest.approx(full)
    for k, c in enumerate(clusters):
        want = r2([j for j in range(P) if j not in c])
        assert got[k].dropped_r2 == pytest.approx(want) and got[k].delta == pytest.approx(full - want)
    assert got[0].delta > got[1].delta


def test_permuted_blocks_equal_moved_rows(spark, data):
    x, y, df = data
    clusters, beta, mean = [[0, 1], [3]], [0.5, 1.0, 0.2, 0.0, -0.6, 0.1, 0.0], 1.5
    n, block, repeats, seed = 87, 10, 3, 5
    rows = df.where(f"i < {n}")
    got = {(r.cluster, r.repeat): r for r in G.permuted_usefulness(rows, "i", "x", "y", P, beta, mean, clusters, block=block, repeats=repeats, seed=seed).collect()}
    assert len(got) == 6
    xs, ys = x[:n], y[:n]
    sst = ((ys - mean) ** 2).sum()
    full = 1 - ((ys - beta[0] - xs @ beta[1:]) ** 2).sum() / sst
    for c, members in enumerate(clusters):
        for r in range(repeats):
            whole = list(range(n // block))
            drawn = sorted(whole, key=lambda b: md5(f"{seed}:{c * repeats + r}:{b}".encode()).hexdigest())
            moved = xs.copy()
            for to, source in zip(whole, drawn, strict=True):
                moved[to * block : (to + 1) * block, members] = xs[source * block : (source + 1) * block][:, members]
            want = 1 - ((ys - beta[0] - moved @ beta[1:]) ** 2).sum() / sst
            assert got[c, r].full_r2 == pytest.approx(full) and got[c, r].permuted_r2 == pytest.approx(want)


def test_logistic_fit_stands_where_the_gradient_is_zero(spark, data):
    x, y, df = data
    both = df.withColumn("up", (F.col("y") > 0.6).cast("double"))
    t = (y > 0.6).astype(float)
    design = np.c_[np.ones(240), x]
    for penalty in (0.0, 5.0):
        fit = G.logistic_fit(both, "x", "up", P, penalty)
        b = np.array(fit["coefficients"])
        p = 1 / (1 + np.exp(-design @ b))
        gradient = design.T @ (t - p) - penalty * np.r_[0, b[1:]]
        assert np.abs(gradient).max() < 1e-5 and fit["gradient"] < 1e-4 and fit["n"] == 240
        errors = np.sqrt(np.diag(np.linalg.inv(design.T @ (design * (p * (1 - p))[:, None]) + penalty * np.diag([0] + [1] * P))))
        assert np.allclose(fit["errors"], errors, rtol=1e-4) and np.allclose(fit["wald"], b / errors, rtol=1e-3)
    flat = G.logistic_fit(both.withColumn("up", F.lit(1.0)), "x", "up", P)
    assert flat["coefficients"][0] == pytest.approx(np.log(241.5 / 0.5)) and not any(flat["coefficients"][1:])


@pytest.mark.parametrize("cuts", [0, 4, 40, 5000])
def test_forward_advantage_equals_windows(spark, cuts):
    from tapeloom.operators.gate import forward_advantage
    from tapeloom.operators.slices import Slices

    rng = np.random.default_rng(8)
    rows = [("a" if i % 3 else "b", int(rng.integers(0, 90)), i, *(None if rng.random() < 0.1 else float(v) for v in rng.exponential(size=4))) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, ts long, i long, m1 double, b1 double, m2 double, b2 double")
    out = forward_advantage(df, ["k"], "ts", "i", [("m1", "b1"), ("m2", "b2")], 12, Slices(tuple(float(x) for x in np.linspace(-2, 95, cuts)))).collect()
    assert len(out) == 150
    for r in out:
        ahead = [x for x in rows if x[0] == r.k and (x[1], x[2]) >= (r.ts, r.i) and x[1] <= r.ts + 12]
        shares = []
        for m, b in ((3, 4), (5, 6)):
            known = [x for x in ahead if x[m] is not None and x[b] is not None]
            base = sum(x[b] for x in known)
            if base > 0:
                shares.append(1 - sum(x[m] for x in known) / base)
        assert (r.height is None) == (not shares) and (not shares or r.height == pytest.approx(np.median(shares)))


def test_gate_learns_hinges_and_keeps_unknown_rows(spark):
    from tapeloom.operators.gate import fit_gate
    from tapeloom.operators.slices import Slices

    rng = np.random.default_rng(9)
    a, b = rng.normal(size=600), rng.normal(size=600)
    chance = 1 / (1 + np.exp(-3 * (np.abs(a) - 0.8)))
    height = np.where(rng.random(600) < chance, 1.0, -1.0)
    rows = [(i, float(a[i]), None if i == 7 else float(b[i]), None if i == 9 else float(height[i]), "train" if i < 400 else "validation") for i in range(600)]
    df = spark.createDataFrame(rows, "i long, a double, b double, h double, split string")
    cuts = {c: Slices((-0.5, 0.5)) for c in ("a", "b")}
    out, report = fit_gate(df, ["a", "b"], "h", "split", (0.1, 1.0, 1e6), [(0, 1)], cuts)
    got = {r.i: r.gate for r in out.collect()}
    assert len(got) == 600 and got[7] is None and got[9] is not None
    assert report["penalty"] in (0.1, 1.0) and report["n"] == 398 and report["gradient"] < 1e-3
    known = [i for i in range(400, 600)]
    assert np.corrcoef([got[i] for i in known], chance[known])[0, 1] > 0.85


def test_gate_reads_stored_heights(spark, sf):
    from unittest import mock

    from tapeloom.plans import gram_queries

    with mock.patch.object(gram_queries.T, "fit_gate", side_effect=gram_queries.T.fit_gate) as fit:
        gram_queries.nonlinear_gate(spark, sf)
    plan = fit.call_args.args[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "Join" not in plan and "Window" not in plan
