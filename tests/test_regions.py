"""Region features in one pass equal those written as columns, for odd ladders too."""

from __future__ import annotations

import random

import pytest

from tapeloom.functions import book as B
from tapeloom.operators.regions import state_features

_LEVEL = "array<struct<price: double, quantity: bigint, orders: int>>"


def test_one_pass_equals_columns(spark):
    draw = random.Random(6)

    def ladder(start, step):
        return [(start + step * i * draw.choice((0.05, 4.0)), draw.randrange(0, 40), draw.randrange(0, 4)) for i in range(draw.randrange(0, 9))]

    rows = [(n, ladder(100.0, -1), ladder(100.0 + draw.choice((0.1, 0.5)), 1)) for n in range(200)]
    rows += [(200, [], [(1.0, 2, 3)]), (201, None, [(1.0, 2, 3)]), (202, [(5.0, 1, 1)], [(4.0, 1, 1)]), (203, [(5.0, 1, 1), (4.0, None, 2)], [(6.0, 1, 1)]), (204, [(5.0, 0, 0)], [(6.0, 0, 0)])]
    df = spark.createDataFrame(rows, f"n long, bids {_LEVEL}, asks {_LEVEL}")
    ranks, bands = (("best", 1, 1), ("l1_5", 1, 5)), (("d_near", 0.0, 0.15), ("d_far", 0.15, float("inf")))
    columns = B.state_features("bids", "asks", ranks, bands)
    want = df.select("n", *[c.alias(n) for n, c in columns.items()]).orderBy("n").collect()
    one = state_features(df, ["n"], ranks, bands)
    assert "MapInArrow" in one._jdf.queryExecution().optimizedPlan().toString()
    got = one.orderBy("n").collect()
    assert one.columns == ["n", *columns] and len(got) == len(want) == 205
    for g, w in zip(got, want, strict=True):
        for name, mine, column in zip(one.columns, g, w, strict=True):
            assert mine == (column if column is None else pytest.approx(column, rel=1e-9, abs=1e-9)), (g.n, name)
