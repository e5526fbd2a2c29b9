"""Book features, flow formulas and trade rules on hand-worked values."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import book as B
from tapeloom.operators import flow
from tapeloom.operators.slices import Slices
from tapeloom.operators.trades import classify

LADDER = "array<struct<price:double,quantity:bigint,orders:int>>"


def book(spark, *rows):
    return spark.createDataFrame(rows, f"instrument_id int, seq long, ts_us long, bids {LADDER}, asks {LADDER}")


def test_touch_values_and_refusals(spark):
    df = book(
        spark,
        (1, 1, 1, [(100.0, 30, 3), (99.95, 10, 1)], [(100.1, 10, 2), (100.15, 20, 2)]),
        (1, 2, 2, [], [(100.1, 10, 2)]),
        (1, 3, 3, [(100.2, 1, 1)], [(100.1, 1, 1)]),
        (1, 4, 4, [(100.1, 1, 1)], [(100.1, 3, 1)]),
    )
    rows = df.select(
        "seq", B.midpoint("bids", "asks").alias("mid"), B.microprice_shift("bids", "asks").alias("shift"),
        B.microprice_tilt(B.best("bids"), B.best("bids", "quantity"), B.best("asks"), B.best("asks", "quantity")).alias("tilt"),
        B.depth_imbalance("bids", "asks", 2).alias("imb2"), B.inverse_rank_imbalance("bids", "asks", 2).alias("inv2"),
    ).orderBy("seq").collect()
    first, empty, crossed, locked = rows
    assert first["mid"] == pytest.approx(100.05)
    assert first["shift"] == pytest.approx((100.1 * 30 + 100.0 * 10) / 40 - 100.05)
    assert first["imb2"] == pytest.approx((40 - 30) / 70)
    assert first["inv2"] == pytest.approx((35 - 20) / 55)
    # Missing is not zero.
    assert empty["mid"] is None and empty["imb2"] is None and crossed["mid"] is None
    # A locked book has a midpoint, but the strict microprice refuses it.
    assert locked["mid"] == pytest.approx(100.1) and locked["tilt"] is None


def test_two_flow_conventions_differ_only_on_a_worsened_bid(spark):
    df = book(
        spark,
        (1, 1, 1, [(100.0, 30, 1)], [(100.1, 10, 1)]),
        (1, 2, 2, [(99.9, 7, 1)], [(100.2, 4, 1)]),
        (1, 3, 3, [(99.9, 9, 1)], [(100.0, 6, 1)]),
    )
    moves = flow.transitions(df, ["instrument_id"], Slices((2.0,)))
    rows = moves.select(
        "seq", flow.level_flow(1, "new")[0].alias("new"), flow.level_flow(1, "old")[0].alias("old"),
        flow.level_one_closed_form().alias("cks"), *[c.alias(n) for n, c in flow.level_one_components().items()],
    ).orderBy("seq").collect()
    assert [r["new"] for r in rows] == [-7 + 4, 2 - 6]
    assert [r["old"] for r in rows] == [-30 + 4, 2 - 6]
    assert [r["cks"] for r in rows] == [-30 + 10, 2 - 6]
    for r in rows:
        assert r["cks"] == sum(r[n] for n in flow.COMPONENTS)


def test_region_features_are_zero_beside_an_empty_count(spark):
    df = book(spark, (1, 1, 1, [(100.0, 30, 3)], [(100.1, 10, 2)]))
    f = B.state_features("bids", "asks")
    r = df.select(f["l21_50__bid_quantity"].alias("q"), f["l21_50__bid_occupied_levels"].alias("n"), f["best__quantity_imbalance"].alias("i")).first()
    assert (r["q"], r["n"]) == (0.0, 0.0) and r["i"] == pytest.approx(0.5)


@pytest.mark.parametrize(
    "price,bid,ask,last,age,expected",
    [
        (100.06, 100.0, 100.1, None, 5.0, ("buy", "quote_rule", False)),
        (100.04, 100.0, 100.1, None, 5.0, ("sell", "quote_rule", False)),
        (100.05, 100.0, 100.1, 100.0, 5.0, ("buy", "tick_rule", False)),
        (100.05, 100.0, 100.1, 100.1, 5.0, ("sell", "tick_rule", False)),
        (100.05, 100.0, 100.1, None, 5.0, ("unclassified", "no_prior_differing_trade", False)),
        (100.06, None, None, None, None, ("unclassified", "no_prevailing_quote", True)),
        (100.06, 100.1, 100.1, None, 5.0, ("unclassified", "invalid_quote", True)),
        (100.06, 100.0, 100.1, None, 1001.0, ("unclassified", "stale_quote", True)),
        (100.06, 100.0, 100.1, None, 1000.0, ("buy", "quote_rule", False)),
    ],
)
def test_trade_rules(spark, price, bid, ask, last, age, expected):
    df = spark.createDataFrame([(price, bid, ask, last, age)], "p double, b double, a double, l double, g double")
    c = classify(F.col("p"), F.col("b"), F.col("a"), F.col("l"), F.col("g"), 1000.0, F.lit(7), F.lit(7))
    r = df.select(c.alias("c")).first()["c"]
    assert (r["side"], r["reason"], r["degraded"]) == expected and r["coalesced"] is False


def test_print_location_uses_half_even_ticks(spark):
    df = spark.createDataFrame([(100.0, "at_bid"), (100.1, "at_ask"), (100.05, "strictly_inside"), (99.9, "strictly_outside")], "p double, want string")
    rows = df.select("want", B.print_location(F.col("p"), F.lit(100.0), F.lit(100.1)).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)


def test_depth_flags(spark):
    df = book(
        spark,
        (1, 1, 1, [(100.0, 1, 1), (99.9, 1, 1)], [(100.1, 1, 1)]),
        (1, 2, 2, [(100.0, 1, 1), (100.0, 1, 1)], [(99.0, 1, 1)]),
        (1, 3, 3, [], [(100.1, 1, 1), (100.05, 1, 1)]),
    )
    got = [r["f"] for r in df.select("seq", B.depth_flags("bids", "asks").alias("f")).orderBy("seq").collect()]
    assert got == [[], ["crossed_book", "invalid_depth"], ["invalid_depth", "partial_book"]]


def test_lob_block_matches_least_squares(spark):
    import numpy as np

    bids = [(100 - 0.05 * i * (1 + i % 2), 5 + 7 * i, 1 + i) for i in range(5)]
    asks = [(100.1 + 0.05 * i, 9 + 3 * i, 2 + i) for i in range(5)]
    lob = B.lob_features(book(spark, (1, 1, 1, bids, asks))).first()["lob"]
    x = np.log1p(np.cumsum([q for _, q, _ in bids]))
    y = np.array([abs(p - 100) / 0.05 for p, _, _ in bids])
    beta = np.linalg.lstsq(np.stack([np.ones(5), x, x**2], axis=1), y, rcond=None)[0]
    assert lob["bid_slope"] == pytest.approx(beta[1], rel=1e-6)
    assert lob["bid_curvature"] == pytest.approx(beta[2], rel=1e-6)
    assert lob["log1p_l1_total_quantity"] == pytest.approx(math.log1p(14))


def test_relocations_on_both_sides_without_window_slides(spark):
    from tapeloom.operators.matching import relocations

    bids = [(100.0 - k, 10 * k + 10, 1) for k in range(6)]
    asks = [(101.0 + k, 10 * k + 10, 1) for k in range(6)]
    df = book(
        spark,
        (1, 1, 1, bids, asks),
        (1, 2, 2, bids, [*asks[:3], (104.5, 40, 1), *asks[4:]]),  # an ask from 104 to 104.5
        (1, 3, 3, bids, [*asks[:3], (104.5, 40, 1), asks[4], (107.0, 60, 1)]),  # the asks' window slid
        (1, 4, 4, [*bids[:2], (97.5, 30, 1), *bids[3:]], [*asks[:3], (104.5, 40, 1), asks[4], (107.0, 60, 1)]),  # a bid
    )
    moves = flow.transitions(df, ["instrument_id"], Slices((2.0,)))
    got = [tuple(r) for side in ("bids", "asks") for r in relocations(moves, ["seq"], side, 0.1, overlap=0.6).collect()]
    assert sorted(got) == [(2, "ask", 104.0, 104.5, "away", 40.0), (4, "bid", 98.0, 97.5, "away", 30.0)]


def test_relocation_query_pairs_both_sides_as_plain_python_does(spark, sf):
    from tapeloom.plans.book_queries import FAR, OVERLAP, moves
    from tapeloom.plans.feature_queries import relocation_pairs

    want = []
    for m in moves(spark, sf).where(F.col("invalid").isNull()).select("instrument_id", "seq", "ts_us", "p", "bids", "asks").collect():
        for side, sign, outer in (("bids", 1, min), ("asks", -1, max)):
            old, new = ({x.price: x.quantity for x in ladder} for ladder in (m.p[side], m[side]))
            gone, come, top = old.keys() - new.keys(), new.keys() - old.keys(), m.p[side][0].price
            if gone and come and len(old.keys() & new.keys()) / min(len(old), len(new)) >= OVERLAP:
                if max(len(gone), len(come)) <= 2 and outer(old) in gone and outer(new) in come:
                    continue
            gone, come = ([p for p in ps if (top - p) * sign > FAR and of[p] > 0] for ps, of in ((gone, old), (come, new)))
            for diff, a, b in sorted((abs(new[b] - old[a]) / max(old[a], new[b]), a, b) for a in gone for b in come):
                if diff <= 0.25 and a in gone and b in come and (top - a) * sign != (top - b) * sign:
                    gone.remove(a)
                    come.remove(b)
                    way = "toward" if (top - b) * sign < (top - a) * sign else "away"
                    want.append((m.instrument_id, m.seq, m.ts_us, side[:-1], a, b, way, float(min(old[a], new[b]))))
    got = [tuple(r) for r in relocation_pairs(spark, sf).collect()]
    assert sorted(got) == sorted(want) and {r[3] for r in got} == {"bid", "ask"}
