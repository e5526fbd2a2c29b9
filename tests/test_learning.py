"""Walk-forward selection, Kalman paths and past neighbours against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import walkforward as W
from tapeloom.operators.kalman import kalman_path
from tapeloom.operators.past_neighbours import past_neighbours
from tapeloom.operators.slices import Slices

CUTS = {n: Slices(tuple(float(x) for x in np.linspace(-3, 130, n))) for n in (0, 4, 40, 5000)}


def serial_kalman(rows, p, rho, q, noise):
    beta, cov, out, waiting = np.zeros(p), np.eye(p), {}, []
    rows = sorted(rows)
    for n, (ts, tie, x, y, known) in enumerate(rows):
        beta, cov = rho * beta, rho * rho * cov + q * np.eye(p)
        due = [w for w in waiting if w[0] <= ts]
        waiting = [w for w in waiting if w[0] > ts]
        for _, _, _, v, target in sorted(due, key=lambda w: w[1:3]):
            gain = cov @ v / (v @ cov @ v + noise)
            beta, cov = beta + gain * (target - v @ beta), cov - np.outer(gain, v @ cov)
        out[ts, tie] = None if x is None else float(np.array(x) @ beta)
        if x is not None and y is not None and known is not None:
            waiting.append((max(known, ts + 1), ts, tie, np.array(x), y))
    return out


@pytest.mark.parametrize("cuts", CUTS)
def test_kalman_equals_a_serial_loop(spark, cuts):
    rng = np.random.default_rng(6)
    data = []
    for key, n in (("a", 90), ("b", 25), ("c", 1)):
        for i in range(n):
            x = None if i % 17 == 5 else rng.normal(size=3).tolist()
            y = None if i % 13 == 7 else float(rng.normal())
            data.append((key, int(rng.integers(0, 120)), i, x, y, None if i % 19 == 3 else 0))
    data = [(k, t, i, x, y, None if m is None else t + int(rng.integers(0, 30))) for k, t, i, x, y, m in data]
    df = spark.createDataFrame(data, "k string, ts long, tie long, x array<double>, y double, known long")
    out = kalman_path(df, ["k"], "ts", "tie", "x", "y", "known", CUTS[cuts], width=3, rho=0.95, q=0.05, observation_variance=0.7).collect()
    assert len(out) == len(data)
    for key in "abc":
        want = serial_kalman([r[1:] for r in data if r[0] == key], 3, 0.95, 0.05, 0.7)
        for r in out:
            if r.k == key:
                assert (r.prediction is None) == (want[r.ts, r.tie] is None)
                assert r.prediction is None or abs(r.prediction - want[r.ts, r.tie]) < 1e-8


def test_kalman_is_causal(spark):
    data = [("a", i, 0, [1.0, i % 5 - 2.0], float(i % 7), i + 3) for i in range(40)]
    schema = "k string, ts long, tie long, x array<double>, y double, known long"
    run = lambda rows: {r.ts: r.prediction for r in kalman_path(spark.createDataFrame(rows, schema), ["k"], "ts", "tie", "x", "y", "known", CUTS[4], width=2, rho=0.9, q=0.1).collect()}
    changed = [(k, t, o, x, y if t < 20 else 99.0, m) for k, t, o, x, y, m in data]
    before, after = run(data), run(changed)
    assert all(abs(before[t] - after[t]) < 1e-12 for t in range(23)) and before[23] != after[23]
    with pytest.raises(ValueError, match="rho"):
        kalman_path(spark.createDataFrame(data, schema), ["k"], "ts", "tie", "x", "y", "known", CUTS[0], width=2, rho=0.0, q=0.1)


def plain_neighbours(rows, k, history, least, quantile):
    rows, out = sorted(rows), {}
    for n, (ts, i, x, z, v) in enumerate(rows):
        past = rows[max(0, n - history) : n]
        if len(past) < least:
            out[i] = (len(past), None, None, None)
            continue
        near = sorted(((a - x) ** 2 + ((b - z) / 2) ** 2, m, abs(w)) for m, (_, _, a, b, w) in enumerate(past))[:k]
        weighted = sorted((size, max(math.exp(-d / 2), 1e-12)) for d, _, size in near)
        total, upto, value = sum(w for _, w in weighted), 0.0, weighted[-1][0]
        for size, w in weighted:
            upto += w
            if upto >= quantile * total:
                value = size
                break
        out[i] = (len(past), value, (1 + sum(w for s, w in weighted if s >= abs(v))) / (1 + total), len(near))
    return out


@pytest.mark.parametrize("cuts", CUTS)
@pytest.mark.parametrize("history", [7, 1000])
def test_past_neighbours_equal_all_pairs(spark, cuts, history):
    rng = np.random.default_rng(9)
    data = [("a" if i % 4 else "b", int(rng.integers(0, 120)), i, float(rng.integers(0, 5)), float(rng.normal()), float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame([*data, ("a", 5, 900, None, 1.0, 1.0), ("b", 5, 901, 1.0, 1.0, None)], "k string, ts long, i long, x double, z double, v double")
    out = past_neighbours(df, ["k"], ["ts", "i"], ("x", "z"), "v", CUTS[cuts], bandwidths=(1.0, 2.0), neighbours=6, history=history, least=3, quantile=0.83).collect()
    assert len(out) == 202
    want = {k: plain_neighbours([r[1:] for r in data if r[0] == k], 6, history, 3, 0.83) for k in "ab"}
    for r in out:
        if r.i >= 900:
            assert r.uncertainty is None and r.history_rows is None
            continue
        rows, value, tail, count = want[r.k][r.i]
        assert r.history_rows == rows and r.neighbour_rows == count
        assert (r.uncertainty is None) == (value is None) and (value is None or abs(r.uncertainty - value) < 1e-12 and abs(r.tail_p - tail) < 1e-9)


def ridge(rows, names, alpha):
    x, y = np.array([[r[n] for n in names] for r in rows]), np.array([r["y"] for r in rows])
    scale = x.std(axis=0)
    z = (x - x.mean(axis=0)) / scale
    beta = np.linalg.solve(z.T @ z / len(y) + alpha / len(y) * np.eye(len(names)), z.T @ (y - y.mean()) / len(y)) / scale
    return np.r_[y.mean() - beta @ x.mean(axis=0), beta], y.mean()


@pytest.fixture(scope="module")
def sessions(spark):
    rng = np.random.default_rng(12)
    data = []
    for g, n in (("a", 30), ("b", 13)):
        for s in range(n):
            for _ in range(12):
                u, v, w = rng.normal(size=3).tolist()
                data.append({"g": g, "s": s * 3, "u": u, "v": v, "w": w, "y": 2 * u - 0.5 * v + float(rng.normal())})
    return data


@pytest.mark.parametrize("cuts", CUTS)
def test_nested_scores_equal_refits(spark, sessions, cuts):
    df = spark.createDataFrame(sessions)
    options = [W.Candidate("u", ("u",)), W.Candidate("uv", ("u", "v"), 4.0), W.Candidate("w", ("w",), 0.0, 0.1, True)]
    out = W.nested_walk_forward(df, ["g"], "s", ["u", "v", "w"], "y", options, CUTS[cuts], folds=3, minimum_sessions=6, embargo=1, minimum=10).collect()
    seen = 0
    for g in "ab":
        days = sorted({r["s"] for r in sessions if r["g"] == g})
        pick = lambda lo, hi: [r for r in sessions if r["g"] == g and r["s"] in days[lo:hi]]
        width = max(1, (len(days) - 6) // 3)
        for fold in range(3):
            first = 6 + fold * width
            last, known = len(days) if fold == 2 else first + width, first - 1
            cut = math.floor(known * 0.7)
            train, inner, outer = pick(0, cut - 1), pick(cut, known), pick(first, last)
            mine = {r.candidate: r for r in out if r.g == g and r.fold == fold}
            scores = {}
            for c in options:
                beta, _ = ridge(train, c.features, c.alpha)
                score = lambda rows: float(np.corrcoef([beta[0] + sum(b * r[f] for b, f in zip(beta[1:], c.features, strict=True)) for r in rows], [r["y"] for r in rows])[0, 1])
                r, scores[c.name] = mine[c.name], abs(score(inner))
                assert abs(r.validation_score - score(inner)) < 1e-8 and abs(r.outer_score - score(outer)) < 1e-8
                assert r.train_n == len(train) and r.support == len(outer)
                seen += 1
            best = max(scores["u"], scores["uv"])
            chosen = {n for n in ("u", "uv") if scores[n] >= 0.9 * best} | {"w"}
            assert {n for n, r in mine.items() if r.selected} == chosen and mine["w"].weight == 1.0
            assert abs(sum(r.weight for n, r in mine.items() if n != "w") - 1) < 1e-9
    assert seen == 18 == len(out)


def test_inner_folds_never_see_outer_rows(spark, sessions):
    run = lambda rows: {(r.g, r.fold, r.alpha): r for r in W.penalty_by_inner_folds(spark.createDataFrame(rows), ["g"], "s", ["u", "v"], "y", [0.0, 30.0, 900.0], CUTS[4], folds=2, inner=3, minimum_sessions=8, embargo=1, minimum=5).collect()}
    base = run(sessions)
    days = sorted({r["s"] for r in sessions if r["g"] == "a"})
    first = days[8]
    broken = run([r | ({"y": 1000.0 * r["w"]} if r["g"] == "a" and r["s"] >= days[7] else {}) for r in sessions])
    for key, r in base.items():
        if key[:2] == ("a", 0):
            assert broken[key].inner_r2 == pytest.approx(r.inner_r2) and broken[key].chosen == r.chosen and broken[key].outer_r2 != pytest.approx(r.outer_r2)
    assert all(sum(r.chosen for k, r in base.items() if k[:2] == (g, f)) == 1 for g in "ab" for f in (0, 1))
    train, outer = [r for r in sessions if r["g"] == "a" and r["s"] < days[7]], [r for r in sessions if r["g"] == "a" and first <= r["s"] < days[19]]
    beta, mean = ridge(train, ("u", "v"), 30.0)
    errors = [(r["y"] - beta[0] - beta[1] * r["u"] - beta[2] * r["v"]) ** 2 for r in outer]
    assert base["a", 0, 30.0].outer_r2 == pytest.approx(1 - sum(errors) / sum((r["y"] - mean) ** 2 for r in outer))


def test_too_few_rows_give_no_scores(spark):
    df = spark.createDataFrame([("g", s, float(s), 1.0) for s in range(12)], "g string, s long, u double, y double")
    out = W.nested_walk_forward(df, ["g"], "s", ["u"], "y", [W.Candidate("u", ("u",))], CUTS[0], folds=2, minimum_sessions=6, embargo=1, minimum=50).collect()
    assert out and all(r.validation_score is None and not r.selected and r.weight == 0 for r in out)
    flat = W.nested_walk_forward(df, ["g"], "s", ["u"], "y", [W.Candidate("u", ("u",))], CUTS[0], folds=2, minimum_sessions=6, embargo=0, minimum=2).collect()
    assert all(r.outer_score is None for r in flat)
