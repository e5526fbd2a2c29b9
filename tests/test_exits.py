"""Path ceilings, distances to a law, butterflies, against plain evaluation."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tapeloom.operators import ceiling as C
from tapeloom.operators import payoffs
from tapeloom.operators.payoffs import butterfly_summary
from tapeloom.operators.slices import Slices


def cuts(n, low=-5, high=5):
    return Slices(tuple(float(x) for x in np.linspace(low, high, n)))


def test_path_ceilings(spark):
    rows = [("a", t, t, p) for t, p in enumerate([10.0, 9.0, None, 10.3, 12.0, 12.0, 11.0])] + [("b", 5, 1, 7.0), ("c", 1, 1, None), ("d", 1, 2, 5.0), ("d", 1, 1, 4.0), ("z", 1, 1, 0.0), ("z", 2, 1, 3.0)]
    got = {r.k: r for r in C.path_ceilings(spark.createDataFrame(rows, "k string, ts long, o long, p double"), ["k"], "ts", "o", "p", 2.0).collect()}
    a = got["a"]
    assert (a.rows, a.entry, a.close, a.peak, a.trough, a.span_us, a.peak_us, a.break_even_us) == (6, 10.0, 11.0, 12.0, 9.0, 6, 4, 3)
    assert a.peak_return == pytest.approx(20) and a.close_return == pytest.approx(10) and a.giveback == pytest.approx(10) and a.peak_u == pytest.approx(4 / 6)
    assert got["b"].break_even_us is None and got["b"].peak_u is None and "c" not in got
    assert (got["d"].entry, got["d"].close, got["d"].break_even_us) == (4.0, 5.0, 0) and got["z"].peak_return is None


@pytest.mark.parametrize("n", [0, 4, 40, 5000])
def test_distance_to_the_arcsine_law(spark, n):
    rng = np.random.default_rng(1)
    data = {"law": np.sin(rng.uniform(0, math.pi / 2, 150)) ** 2, "flat": np.round(rng.uniform(0, 1, 200), 2), "few": np.array([0.1, 0.2])}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x], "g string, u double")
    got = {r.g: r for r in C.distribution_distance(df, ["g"], "u", C.arcsine_cdf, cuts(n, -0.1, 1.1)).collect()}
    for k in ("law", "flat"):
        u = np.sort(data[k])
        f = 2 / math.pi * np.arcsin(np.sqrt(u))
        plus, minus = (np.arange(1, len(u) + 1) / len(u) - f).max(), (f - np.arange(len(u)) / len(u)).max()
        assert got[k].d_plus == pytest.approx(plus) and got[k].d_minus == pytest.approx(minus) and got[k].distance == pytest.approx(max(plus, minus))
    assert got["law"].p_value > 0.1 and got["flat"].p_value < 0.01 and got["few"].distance is None and got["few"].n == 2


def plain(values, center, width, net, tail, tax):
    pnl = sorted(net - min(abs(v - center), width) - tax * max(abs(v - center) - width, 0) for v in values)
    k = max(1, math.floor(len(values) * tail))
    return np.mean(pnl), np.mean([p < 0 for p in pnl]), pnl[0], k, np.mean(pnl[:k])


@pytest.mark.parametrize("n", [0, 4, 40, 5000])
@pytest.mark.parametrize("tail", [0.0, 0.07, 0.6, 1.0])
def test_butterflies_equal_plain_evaluation(spark, monkeypatch, n, tail):
    monkeypatch.setattr(payoffs, "_PROBES", 3)
    rng = np.random.default_rng(2)
    ends = {"a": rng.normal(100, 30, 130).round().astype(int).tolist(), "b": [50] * 9, "one": [7]}
    shapes = [(c, w, q) for c in (-20, 50, 90, 100, 170) for w, q in ((10, 4), (40, 39), (200, 60), (30, 30), (30, 0))]
    keys = [*ends, "gone"]
    df = spark.createDataFrame([(k, v) for k, x in ends.items() for v in x] + [("a", None)], "k string, v long")
    wanted = spark.createDataFrame([(k, *s) for k in keys for s in shapes], "k string, center long, width long, net long")
    out = butterfly_summary(df, wanted, ["k"], "v", cuts(n, 0, 200), tail=tail, exercise_tax=0.01).collect()
    assert len(out) == len(keys) * len(shapes)
    for r in out:
        if r.k == "gone" or not 0 < r.net < r.width:
            assert r.reason == ("no_paths" if r.k == "gone" else "nonviable_credit") and r.mean is None
            continue
        mean, loss, worst, k, tail_mean = plain(ends[r.k], r.center, r.width, r.net, tail, 0.01)
        assert r.reason is None and r.tail_rows == k and r.n == len(ends[r.k])
        assert (r.mean, r.loss_chance, r.worst, r.tail_mean) == pytest.approx((mean, loss, worst, tail_mean))
