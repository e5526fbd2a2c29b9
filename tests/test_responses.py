"""Response families against loops over events."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tapeloom.operators import responses as R
from tapeloom.operators.slices import Slices

CUTS = {n: Slices(tuple(float(x) for x in np.linspace(-5, 600, n))) for n in (0, 4, 40, 5000)}
GAPS, HORIZONS = [2, 5], [10, 30]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    prices = [("a" if i % 3 else "b", int(rng.integers(0, 500)), i, float(rng.normal())) for i in range(240)]
    events = [("a" if i % 2 else "b", int(rng.integers(0, 520)), 1000 + i) for i in range(60)]
    return prices, events, spark.createDataFrame(prices, "k string, pts long, po long, v double"), spark.createDataFrame(events, "k string, ts long, e long")


def at(prices, k, t):
    own = sorted((p[1], p[2], p[3]) for p in prices if p[0] == k)
    if t > own[-1][0] or t < own[0][0]:
        return None
    return [p[2] for p in own if p[0] <= t][-1]


def plain(prices, events):
    out = {}
    for k, ts, e in events:
        for g in GAPS:
            for h in HORIZONS:
                a, b = at(prices, k, ts + g), at(prices, k, ts + g + h)
                if a is not None and b is not None:
                    out[e, g, h] = (k, ts, b - a)
    return out


@pytest.mark.parametrize("cuts", CUTS)
def test_responses_equal_lookups(data, cuts):
    prices, events, pdf, edf = data
    got = {(r.e, r.gap, r.horizon): (r.k, r.ts, r.response) for r in R.timed_responses(edf, pdf, ["k"], "e", "ts", "pts", "po", "v", GAPS, HORIZONS, CUTS[cuts]).collect()}
    want = plain(prices, events)
    assert set(got) == set(want) and all(got[c][:2] == want[c][:2] and abs(got[c][2] - want[c][2]) < 1e-12 for c in want)


def newey_west(values, lag):
    x = np.array(values) - np.mean(values)
    long_run = (x * x).sum() / len(x) + sum(2 * (1 - k / (lag + 1)) * (x[k:] * x[:-k]).sum() / len(x) for k in range(1, lag + 1) if k < len(x))
    return math.sqrt(max(long_run, 0) / len(x))


def test_family_arms_and_step_down(spark, data):
    prices, events, pdf, edf = data
    rows = R.timed_responses(edf, pdf, ["k"], "e", "ts", "pts", "po", "v", GAPS, HORIZONS, CUTS[4]).selectExpr("*", "e % 2 AS side", "ts div 100 AS session")
    pairs = spark.createDataFrame([(e, events[(n + 7) % 60][2]) for n, (_, _, e) in enumerate(events) if n % 5], "e long, c long")
    differences = R.matched_differences(rows, pairs, "e", "c", rows)
    out = R.response_family(rows, ["k"], ["side"], "session", "e", "ts", CUTS[4], lag=2, differences=differences, replicates=30).collect()
    want = plain(prices, events)
    control = {e: events[(n + 7) % 60][2] for n, (_, _, e) in enumerate(events) if n % 5}
    cells = {}
    for (e, g, h), (k, ts, v) in want.items():
        cells.setdefault((R.ALL, e % 2, g, h), []).append((ts, e, k, v))
        if e in control and (control[e], g, h) in want:
            cells.setdefault((R.MATCHED, e % 2, g, h), []).append((ts, e, k, v - want[control[e], g, h][2]))
    for (arm, s, g, h), own in list(cells.items()):
        if arm == R.ALL:
            for k in "ab":
                end = -1
                for ts, e, who, v in sorted(x for x in own if x[2] == k):
                    if ts > end:
                        cells.setdefault((R.EPISODES, s, g, h), []).append((ts, e, who, v))
                        end = ts + g + h
    assert len(out) == len(cells) == 3 * 2 * 4
    for r in out:
        values = [x[3] for x in sorted(cells[r.arm, r.side, r.gap, r.horizon])]
        assert r.n == len(values) and r.mean == pytest.approx(np.mean(values)) and r.standard_error == pytest.approx(newey_west(values, 2))
        assert r.high - r.low == pytest.approx(2 * 1.959963984540054 * r.standard_error) and 1 / 31 <= r.adjusted_p <= 1
    for arm in (R.ALL, R.EPISODES, R.MATCHED):
        own = sorted((r for r in out if r.arm == arm), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 9))
        assert all(abs(a.t_statistic) >= abs(b.t_statistic) and a.adjusted_p <= b.adjusted_p for a, b in zip(own, own[1:], strict=False))


def test_a_planted_response_is_found(spark):
    rng = np.random.default_rng(6)
    prices = [("k", t, t, float(rng.normal() * 0.1)) for t in range(0, 2000)]
    events = [(int(t), 5000 + i) for i, t in enumerate(range(20, 1900, 40))]
    moved = {t + 2 + 10 for t, _ in events}
    prices = [(k, t, o, v + (3.0 if t in moved else 0.0)) for k, t, o, v in prices]
    rows = R.timed_responses(
        spark.createDataFrame([("k", *e) for e in events], "k string, ts long, e long"), spark.createDataFrame(prices, "k string, pts long, po long, v double"),
        ["k"], "e", "ts", "pts", "po", "v", [2], [10, 15], CUTS[4],
    ).selectExpr("*", "1 AS side", "ts div 200 AS session")
    out = {r.horizon: r for r in R.response_family(rows, ["k"], ["side"], "session", "e", "ts", CUTS[4], lag=2, replicates=60).where(f"arm = '{R.ALL}'").collect()}
    assert out[10].mean > 2.5 and out[10].adjusted_p < 0.05 and abs(out[15].t_statistic) < 3 and out[15].adjusted_p >= out[10].adjusted_p
