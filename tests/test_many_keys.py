"""Serial rules over many small keys: right across slices, ties and null times, and without a Python call per key."""

from __future__ import annotations

import random

from tapeloom.operators.recurrence import greedy_non_overlapping, minimum_spacing
from tapeloom.operators.slices import Slices


def test_greedy_equals_a_plain_walk(spark):
    draw = random.Random(4)
    rows = []
    for n in range(1500):
        s = draw.randrange(200)
        rows.append((draw.randrange(90) if n % 3 else 90, n, s, s + draw.choice((0, 3, 40, 90))))
    df = spark.createDataFrame([*rows, (90, 5000, None, None)], "k long, n long, s long, e long")
    out = greedy_non_overlapping(df, ["k"], "s", "e", Slices((40.0, 41.0, 120.0)), ties=["n"])
    want = {5000: False}
    for k in {r[0] for r in rows}:
        state = -1
        for _, n, s, e in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[3], r[1])):
            want[n] = s > state
            state = e if s > state else state
    assert {r.n: r.selected for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_equal_times_keep_the_first_by_tie(spark):
    df = spark.createDataFrame([(1, n, 10) for n in (7, 3, 9)] + [(1, 4, 25)], "k long, n long, t long")
    assert sorted(r.n for r in minimum_spacing(df, ["k"], "t", 15, Slices(()), ties=["n"]).collect()) == [3, 4]
