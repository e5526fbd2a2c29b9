"""Rank and exact tests against textbook loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import special as S
from tapeloom.operators import ranktests as R
from tapeloom.operators.slices import Slices

CUTS = {n: Slices(tuple(float(x) for x in np.linspace(-6, 6, n))) for n in (0, 4, 40, 5000)}


def mid_ranks(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


def ties(values):
    return sum(values.count(v) ** 3 - values.count(v) for v in set(values))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    rows = [("a" if i % 3 else "b", float(rng.integers(-4, 6)), bool(i % 2)) for i in range(180)]
    rows += [("zero", 0.0, True)] * 3 + [("one", 2.0, True), ("same", 1.0, True), ("same", 1.0, False), ("a", None, True), ("a", 1.0, None)]
    return rows, spark.createDataFrame(rows, "g string, v double, f boolean")


@pytest.mark.parametrize("cuts", CUTS)
def test_wilcoxon(data, cuts):
    rows, df = data
    got = {r.g: r for r in R.wilcoxon_signed_rank(df, ["g"], "v", CUTS[cuts]).collect()}
    for g in "ab":
        v = [x for k, x, _ in rows if k == g and x]
        size = [abs(x) for x in v]
        ranks = mid_ranks(size)
        plus = sum(r for r, x in zip(ranks, v, strict=True) if x > 0)
        n, total = len(v), sum(ranks)
        z = (min(plus, total - plus) - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - ties(size) / 2) / 24)
        r = got[g]
        assert (r.n, r.w_plus, r.w_minus) == (n, plus, total - plus) and r.zeros == sum(x == 0 for k, x, _ in rows if k == g)
        assert r.z == pytest.approx(z) and r.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert (got["zero"].n, got["zero"].statistic, got["zero"].p_value) == (0, 0.0, 1.0) and got["one"].n == 1


@pytest.mark.parametrize("cuts", CUTS)
def test_mann_whitney(data, cuts):
    rows, df = data
    got = {r.g: r for r in R.mann_whitney(df, ["g"], "v", F.col("f"), CUTS[cuts]).collect()}
    for g in "ab":
        own = [(x, f) for k, x, f in rows if k == g and x is not None and f is not None]
        a, b = [x for x, f in own if f], [x for x, f in own if not f]
        u1 = sum((x > y) + (x == y) / 2 for x in a for y in b)
        n1, n2, n = len(a), len(b), len(own)
        sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties([x for x, _ in own]) / (n * (n - 1))))
        z = (max(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sd
        r = got[g]
        assert (r.n1, r.n2, r.u1) == (n1, n2, u1) and r.z == pytest.approx(z) and r.superiority == pytest.approx(u1 / (n1 * n2))
        assert r.p_value == pytest.approx(min(1, math.erfc(z / math.sqrt(2))))
    assert got["zero"].u1 is None and got["same"].z is None and got["same"].p_value is None


def test_fisher_equals_counting_all_tables(spark):
    rng = np.random.default_rng(2)
    tables = [tuple(int(x) for x in rng.integers(0, 15, 4)) for _ in range(150)] + [(0, 0, 3, 4), (1, 9, 11, 3), (300, 200, 150, 400), (5, 0, 0, 5)]
    for a, b, c, d in tables:
        row, column, n = a + b, a + c, a + b + c + d
        ways = {k: math.comb(row, k) * math.comb(n - row, column - k) for k in range(max(0, row + column - n), min(row, column) + 1)}
        want = sum(w for w in ways.values() if w <= ways[a] * (1 + 1e-7)) / math.comb(n, column)
        assert S.fisher_two_sided_value(a, b, c, d) == pytest.approx(want, rel=1e-9)
    assert S.fisher_two_sided_value(10**6, 10**6, 10**6, 10**6 + 900) == pytest.approx(0.653, abs=0.02)


def test_incomplete_beta_has_its_closed_forms():
    x = np.linspace(0, 1, 21)
    assert np.allclose(S.incomplete_beta_values(1.0, 3.5, x), 1 - (1 - x) ** 3.5, atol=1e-13)
    assert np.allclose(S.incomplete_beta_values(2.0, 3.0, x), 6 * x**2 - 8 * x**3 + 3 * x**4, atol=1e-13)
    assert np.allclose(S.incomplete_beta_values(0.5, 0.5, x), 2 / np.pi * np.arcsin(np.sqrt(x)), atol=1e-13)
    assert np.allclose(S.incomplete_beta_values(800.0, 900.0, x) + S.incomplete_beta_values(900.0, 800.0, 1 - x), 1, atol=1e-12)
    assert np.isnan(S.incomplete_beta_values(-1.0, 2.0, 0.5)) and np.isnan(S.incomplete_beta_values(1.0, 2.0, np.nan))


def test_t_and_f_tails(spark):
    row = spark.range(1).select(
        S.student_two_sided(F.lit(2.0), F.lit(10)).alias("t"), S.f_upper(F.lit(3.0), F.lit(2), F.lit(10)).alias("f"),
        S.student_two_sided(F.lit(None).cast("double"), F.lit(10)).alias("none"),
    ).first()
    assert row.t == pytest.approx(0.07338803, abs=1e-8) and row.f == pytest.approx(1.6**-5) and row.none is None


def test_joint_f_equals_two_fits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = x[:, 0] + 0.3 * x[:, 2] + rng.normal(size=80)
    df = spark.createDataFrame([("g", *map(float, a), float(b)) for a, b in zip(x, y, strict=True)] + [("g", 1.0, None, 2.0, 3.0)], "g string, a double, b double, c double, y double")
    sse = lambda m: float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum())
    full, reduced = sse(np.c_[np.ones(80), x]), sse(np.c_[np.ones(80), x[:, :1]])
    r = R.joint_f_test(df, ["g"], ["a", "b", "c"], ["b", "c"], "y").first()
    f = (reduced - full) / 2 / (full / 76)
    assert r.n == 80 and r.f == pytest.approx(f) and r.p_value == pytest.approx((1 + 2 * f / 76) ** -38)
    r = R.joint_f_test(df, ["g"], ["a", "b"], ["a", "b"], "y").first()
    assert r.r2_reduced == 0 and r.df1 == 2


def test_one_sample_t(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("zero", 0.0), ("zero", 0.0), ("flat", 2.0), ("flat", 2.0)], "g string, v double")
    got = {r.g: r for r in R.one_sample_t(df, ["g"], "v").collect()}
    assert got["a"].t == pytest.approx(2.0) and got["a"].p_value == pytest.approx(2 / math.pi * math.atan(1 / 2.0))
    assert got["zero"].p_value == 1.0 and got["flat"].t is None and got["flat"].p_value is None
