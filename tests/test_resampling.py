"""Stationary bootstrap and permutation tests against place-by-place versions."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import resampling as R
from tapeloom.operators.slices import Slices

CUTS = {n: Slices(tuple(float(x) for x in np.linspace(-3, 400, n))) for n in (0, 4, 40, 5000)}


def digits(key, n):
    return int(md5(key.encode()).hexdigest()[:n], 16)


def walk(session, n, replicate, mean_length, seed):
    """Drawn places of one session, one after the other."""
    chance, out, at = int((1 << 32) / mean_length), [], 0
    for p in range(n):
        key = f"{seed}:{replicate}:{session}:{p}"
        restart = p == 0 or digits(key, 8) < chance
        at = digits(key + ":s", 15) % n if restart else (at + 1) % n
        out.append(at)
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    data = [(s, i * 3 % 97 if s == "b" else i, i, float(rng.normal())) for s, n in (("a", 300), ("b", 97), ("c", 1)) for i in range(n)]
    return [(*r, "x" if r[0] < "c" else "y") for r in data], "s string, ts long, id long, v double, g string"


@pytest.mark.parametrize("cuts", CUTS)
@pytest.mark.parametrize("mean_length", [1.0, 7.5])
def test_stationary_means_equal_a_walk(spark, rows, cuts, mean_length):
    data, schema = rows
    df = spark.createDataFrame([*data, ("a", 1000, 1000, None, "x"), ("d", 1, 1, None, "x")], schema)
    got = {(r.g, r.replicate): (r.n, r.mean) for r in R.stationary_bootstrap_means(df, ["g"], ["s"], ["ts", "id"], "v", CUTS[cuts], replicates=3, mean_length=mean_length, seed=5).collect()}
    assert len(got) == 6
    values = {s: [v for _, _, v in sorted((t, i, v) for x, t, i, v, _ in data if x == s)] for s in "abc"}
    for (g, r), (n, mean) in got.items():
        drawn = [values[s][i] for s in ("ab" if g == "x" else "c") for i in walk(f"{g}|{s}", len(values[s]), r, mean_length, 5)]
        assert n == len(drawn) and abs(mean - np.mean(drawn)) < 1e-9


def test_long_sessions_carry_runs_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(R, "STRETCH", 16)
    sessions = spark.createDataFrame([("a", 500), ("b", 33), ("c", 0)], "s string, n long")
    runs = R.stationary_runs(sessions, ["s"], 4, 30.0, 9)
    steps = R.multiplicity_steps(runs, ["s"], CUTS[4]).collect()
    for s, n in (("a", 500), ("b", 33)):
        for r in range(1, 5):
            counts = np.zeros(n, dtype=int)
            for x in (x for x in steps if x.s == s and x.replicate == r):
                counts[x.position : x.until] += x.multiplicity
            assert counts.tolist() == np.bincount(walk(s, n, r, 30.0, 9), minlength=n).tolist() and counts.sum() == n
    assert {x.s for x in steps} == {"a", "b"}


def test_runs_are_geometric(spark):
    sessions = spark.createDataFrame([("a", 20_000)], "s string, n long")
    lengths = np.array([r.length for r in R.stationary_runs(sessions, ["s"], 3, 10.0, 3).select("length").collect()])
    assert abs(lengths.mean() - 10) < 0.6 and abs((lengths == 1).mean() - 0.1) < 0.02 and abs((lengths > 10).mean() - 0.9**10) < 0.03


def plain_permutation(data, strata, replicates, seed):
    groups = {}
    for g, s, i, v, f in data:
        if v is not None:
            groups.setdefault(g, []).append((s if strata else 0, i, v, bool(f)))
    out = {}
    for g, own in groups.items():
        flagged = sum(f for *_, f in own)
        if flagged in (0, len(own)):
            continue
        observed = np.mean([v for *_, v, f in own if f]) - np.mean([v for *_, v, f in own if not f])
        draws = []
        for r in range(1, replicates + 1):
            ins, outs = [], []
            for stratum in {s for s, *_ in own}:
                part = sorted((digits(f"{seed}:{r}:{i}", 12), i, v) for s, i, v, _ in own if s == stratum)
                m = sum(f for s, *_, f in own if s == stratum)
                ins += [v for *_, v in part[:m]]
                outs += [v for *_, v in part[m:]]
            assert len(ins) == flagged
            draws.append(np.mean(ins) - np.mean(outs))
        out[g] = (observed, sum(abs(d) >= abs(observed) - 1e-12 for d in draws), np.mean(draws))
    return out


@pytest.mark.parametrize("strata", [[], ["s"]])
@pytest.mark.parametrize("spread", [6.0, 0.01])
def test_permutations_equal_row_by_row_draws(spark, strata, spread):
    rng = np.random.default_rng(2)
    data = [(("p", "q", "q")[i % 3], i % 5, i, float(rng.normal()) + (i % 4 == 0), i % 4 == 0) for i in range(400)]
    data += [("q", 9, 1000 + i, 1.0, True) for i in range(3)] + [("q", 8, 2000, 2.0, None), ("p", 1, 3000, None, True)]
    data += [("all", 0, 4000 + i, 1.0, True) for i in range(5)] + [("none", 0, 5000, 1.0, False)]
    df = spark.createDataFrame(data, "g string, s int, id long, v double, f boolean")
    got = {r.g: r for r in R.permutation_test(df, ["g"], "v", "f", "id", 25, 7, strata, spread).collect()}
    want = plain_permutation(data, strata, 25, 7)
    assert set(got) == {"p", "q", "all", "none"} and got["all"].p_value is None and got["none"].observed is None
    for g, (observed, exceed, mean) in want.items():
        r = got[g]
        assert abs(r.observed - observed) < 1e-9 and r.exceed == exceed and abs(r.null_mean - mean) < 1e-9 and r.replicates == 25


def test_permutation_finds_a_planted_difference(spark):
    rng = np.random.default_rng(3)
    data = [("g", i, float(rng.normal()), i % 2 == 0) for i in range(600)]
    df = spark.createDataFrame(data, "g string, id long, v double, f boolean")
    null = R.permutation_test(df, ["g"], "v", "f", "id", 200, 1).first()
    hit = R.permutation_test(df.withColumn("v", F.col("v") + F.when(F.col("f"), 1.0).otherwise(0.0)), ["g"], "v", "f", "id", 200, 1).first()
    assert null.p_value > 0.02 and hit.p_value < 0.01
