"""Sliced scans, frames and as-of joins against plain windows and brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.operators import slices as S
from tapeloom.operators.asof import asof, asof_offsets
from tapeloom.operators.intervals import episodes, subtract_intervals, union_intervals
from tapeloom.operators.recurrence import greedy_non_overlapping, linear_recurrence


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    # One hot key holds most rows; timestamps repeat.
    data = [(0 if rng.random() < 0.8 else rng.randrange(1, 5), rng.randrange(400), i, rng.choice([None, 1.0, 2.5, 4.0])) for i in range(1500)]
    return spark.createDataFrame(data, "k int, t long, i long, v double").cache()


def same(a, b):
    a, b = a.select(*sorted(a.columns)), b.select(*sorted(b.columns))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("per_slice", [10, 60, 100_000])
def test_scan_equals_whole_key_window(rows, per_slice):
    cuts = S.Slices.plan(rows, "t", rows_per_slice=per_slice)
    got = S.ordered_scan(
        rows, ["k"], ["t", "i"], cuts,
        {
            "p": S.prev("v"), "n": S.nxt("v"), "l": S.last("v"), "lb": S.last_before("v"), "ff": S.first_from("v"), "fa": S.first_after("v"),
            "rs": S.run_sum("i"), "rn": S.row_no(), "tot": S.total("i"), "mb": S.run_max_before("v"), "mn": S.run_min("v"),
        },
    )
    w = Window.partitionBy("k").orderBy("t", "i")
    past, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    ahead, after = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(1, Window.unboundedFollowing)
    want = rows.select(
        "*", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"), F.last("v", True).over(past).alias("l"),
        F.last("v", True).over(before).alias("lb"), F.first("v", True).over(ahead).alias("ff"), F.first("v", True).over(after).alias("fa"),
        F.sum("i").over(past).alias("rs"), F.row_number().over(w).cast("long").alias("rn"), F.sum("i").over(Window.partitionBy("k")).alias("tot"),
        F.max("v").over(before).alias("mb"), F.min("v").over(past).alias("mn"),
    )
    assert same(got, want)


@pytest.mark.parametrize("per_slice", [8, 100_000])
def test_sliding_equals_range_frame(rows, per_slice):
    cuts = S.Slices.plan(rows, "t", rows_per_slice=per_slice)
    got = S.sliding(
        rows, ["k"], "t", cuts,
        {"a": lambda f: F.count("v").over(f(-30, -1)), "b": lambda f: F.max("v").over(f(0, 12))}, back=30, ahead=12,
    )
    w = Window.partitionBy("k").orderBy("t")
    want = rows.select("*", F.count("v").over(w.rangeBetween(-30, -1)).alias("a"), F.max("v").over(w.rangeBetween(0, 12)).alias("b"))
    assert same(got, want)


def test_slice_numbers_are_monotone_and_keep_equal_values_together(rows):
    cuts = S.Slices.plan(rows, "t", rows_per_slice=20)
    assert len(cuts.cuts) > 24  # the binary-search form
    out = rows.select("t", cuts.of("t").alias("s")).distinct().orderBy("t").collect()
    assert len({r["t"] for r in out}) == len(out)
    assert [r["s"] for r in out] == sorted(r["s"] for r in out)
    assert [r["s"] for r in out] == [sum(c <= r["t"] for c in cuts.cuts) for r in out]


def brute_asof(left, right, strict, covered):
    out = {}
    for k, t, i in left:
        mine = sorted((rt, ri, v) for rk, rt, ri, v in right if rk == k)
        hit = [r for r in mine if (r[0] < t if strict else r[0] <= t)]
        inside = not covered or (bool(mine) and mine[0][0] <= t <= mine[-1][0])
        out[i] = hit[-1][2] if hit and inside else None
    return out


@pytest.mark.parametrize("strict,covered", [(False, False), (True, False), (False, True)])
def test_asof_against_brute_force(spark, strict, covered):
    rng = random.Random(3)
    left = [(rng.randrange(3), rng.randrange(60), i) for i in range(120)]
    right = [(rng.randrange(3), rng.randrange(10, 50), i, float(i)) for i in range(80)]
    l = spark.createDataFrame(left, "k int, t long, i long")
    r = spark.createDataFrame(right, "k int, t long, j long, v double")
    cuts = S.Slices((15.0, 22.0, 40.0))
    got = asof(l, r, keys=["k"], left_ts="t", right_ts="t", values=["v"], slices=cuts, right_ties=["j"], strict=strict, covered=covered)
    assert {x["i"]: x["m_v"] for x in got.collect()} == brute_asof(left, right, strict, covered)


def test_forward_lookup_and_edges(spark):
    l = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 31, 3)], "k int, t long, i long")
    r = spark.createDataFrame([(1, 10, 1.0), (1, 20, 2.0), (1, 30, 3.0)], "k int, t long, v double")
    cuts = S.Slices((15.0, 25.0))
    out = asof_offsets(
        l, r, keys=["k"], id_cols=["i"], left_ts="t", offsets={"now": 0, "ahead": 5, "before": 0, "next": 1},
        strict=["before"], forward=["next"], right_ts="t", values=["v"], slices=cuts,
    )
    got = {x["i"]: (x["now_v"], x["ahead_v"], x["before_v"], x["next_v"]) for x in out.collect()}
    # A target past coverage is missing even though an as-of would resolve to the final value. The
    # strict lookup at 31 asks about 30, which is covered.
    assert got == {1: (1.0, 1.0, None, 2.0), 2: (2.0, 2.0, 1.0, 3.0), 3: (None, None, 3.0, None)}


def test_future_rows_never_change_a_past_answer(rows):
    cuts = S.Slices.plan(rows, "t", rows_per_slice=50)
    early = rows.where("t < 200")
    full = S.sliding(rows, ["k"], "t", cuts, {"m": lambda f: F.avg("v").over(f(-40, 0))}, back=40).where("t < 200")
    cut = S.sliding(early, ["k"], "t", cuts, {"m": lambda f: F.avg("v").over(f(-40, 0))}, back=40)
    assert same(full, cut)
    full = S.ordered_scan(rows, ["k"], ["t", "i"], cuts, {"l": S.last_before("v")}).where("t < 200")
    cut = S.ordered_scan(early.orderBy(F.rand(1)), ["k"], ["t", "i"], cuts, {"l": S.last_before("v")})
    assert same(full, cut)


def test_linear_recurrence_equals_loop(spark):
    rng = random.Random(9)
    data = [(k, t, rng.random(), rng.random()) for k in range(2) for t in range(100)]
    df = spark.createDataFrame(data, "k int, t long, a double, b double")
    got = linear_recurrence(df, ["k"], ["t"], "a", "b", S.Slices((20.0, 33.0, 70.0)), "s")
    want, state = {}, {0: 0.0, 1: 0.0}
    for k, t, a, b in sorted(data, key=lambda x: (x[0], x[1])):
        state[k] = a * state[k] + b
        want[k, t] = state[k]
    for r in got.collect():
        assert r["s"] == pytest.approx(want[r["k"], r["t"]], rel=1e-9)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_selection_equals_loop(spark, seed):
    rng = random.Random(seed)
    data = [(rng.randrange(2), s, s + rng.randrange(0, 30), i) for i in range(300) for s in [rng.randrange(500)]]
    df = spark.createDataFrame(data, "k int, s long, e long, i long")
    got = greedy_non_overlapping(df, ["k"], "s", "e", S.Slices((100.0, 101.0, 250.0, 400.0)))
    for k in range(2):
        limit, want = -1, 0
        kept = set()
        for s, e in sorted((s, e) for kk, s, e, _ in data if kk == k):
            if s > limit:
                kept.add((s, e))
                limit, want = e, want + 1
        mine = [(r["s"], r["e"]) for r in got.where((F.col("k") == k) & F.col("selected")).collect()]
        assert len(mine) == want and set(mine) == kept


def test_interval_algebra(spark):
    cover = spark.createDataFrame([(1, 0, 100), (2, 0, 10)], "k int, s long, e long")
    bad = spark.createDataFrame([(1, 10, 20), (1, 20, 25), (1, 90, 130), (1, -5, 2), (1, 50, 40)], "k int, s long, e long")
    cuts = S.Slices((15.0, 60.0))
    merged = {tuple(r) for r in union_intervals(bad, ["k"], "s", "e", cuts).select("k", "s", "e").collect()}
    assert merged == {(1, -5, 2), (1, 10, 25), (1, 90, 130)}
    clean = {tuple(r) for r in subtract_intervals(cover, bad, ["k"], "s", "e", cuts).select("k", "s", "e").collect()}
    assert clean == {(1, 2, 10), (1, 25, 90), (2, 0, 10)}


def test_episode_joins_at_the_running_end(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 10, 20, 31, 31, 50)], "k int, t long")
    got = sorted(tuple(r) for r in episodes(df, ["k"], "t", 10, S.Slices((15.0,))).select("start_ts", "end_ts", "bursts", "events").collect())
    assert got == [(0, 30, 3, 3), (31, 41, 1, 2), (50, 60, 1, 1)]


@pytest.mark.parametrize("cuts", [S.Slices(()), S.Slices((80.0, 160.0, 240.0, 320.0)), S.Slices(tuple(float(c) for c in range(0, 400, 10))), S.Slices(tuple(float(c) for c in range(0, 400, 2)), 25)])
def test_null_order_values_are_first_with_any_number_of_cuts(spark, cuts):
    rng = random.Random(8)
    data = [(rng.randrange(3), None if rng.random() < 0.1 else rng.uniform(-5, 405), i, rng.choice([None, 1.0, 2.0])) for i in range(900)]
    rows = spark.createDataFrame(data, "k int, t double, i long, v double")
    got = S.ordered_scan(rows, ["k"], ["t", "i"], cuts, {"p": S.prev("v"), "l": S.last("v"), "rs": S.run_sum("i"), "rn": S.row_no(), "n": S.nxt("i")})
    w = Window.partitionBy("k").orderBy("t", "i")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select(
        "*", F.lag("v").over(w).alias("p"), F.last("v", True).over(past).alias("l"), F.sum("i").over(past).alias("rs"),
        F.row_number().over(w).cast("long").alias("rn"), F.lead("i").over(w).alias("n"),
    )
    assert same(got, want)


def test_slices_between_cuts_are_monotone_and_unbounded(spark):
    cuts = S.Slices((0.0, 10.0, 11.0, 100.0), 1000)
    rows = spark.range(-50, 1500).select((F.col("id") / 10).alias("t")).withColumn("s", cuts.of("t")).orderBy("t").collect()
    assert all(a.s <= b.s for a, b in zip(rows, rows[1:], strict=False))
    assert len({r.s for r in rows}) > 500
    assert spark.range(1).select(cuts.of(F.lit(None).cast("double")).alias("s")).first().s == S.NULL_SLICE


def test_top_rows_of_a_hot_group_for_small_and_large_k(spark):
    from tapeloom.operators.ranking import top_k

    rows = spark.range(0, 5000, 1, 6).select((F.col("id") % 100 < 2).cast("int").alias("g"), ((F.col("id") * 7919) % 5003).alias("x"), "id")
    for k in (3, 1200):
        got = top_k(rows, ["g"], [("x", True), ("id", True)], k)
        w = Window.partitionBy("g").orderBy("x", "id")
        assert same(got, rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k))
    plan = top_k(rows, ["g"], [("x", True), ("id", True)], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_the_ends_beyond_the_cuts_are_divided_too(spark, monkeypatch):
    monkeypatch.setattr(S, "_GRID", 8)
    rows = spark.range(0, 4000).withColumn("t", F.col("id").cast("long"))
    cuts = S.Slices.plan(rows, "t", rows_per_slice=20)
    assert cuts.between > 1 and cuts.cuts[0] == 0.0 and cuts.cuts[-1] == 3999.0
    sizes = [r["count"] for r in rows.groupBy(cuts.of("t").alias("s")).count().collect()]
    assert len(sizes) >= 200 and max(sizes) <= 60
    beyond = spark.createDataFrame([(-(10**9),), (0,), (3999,), (10**9,)], "t long").select(cuts.of("t").alias("s")).collect()
    got = [r.s for r in beyond]
    assert got == sorted(got)
