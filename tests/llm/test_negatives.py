"""Hard negatives against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from tapeloom.llm.negatives import Packing, Settings, hard_negatives, leading

SCHEMA = "vec_id long, label int, vector array<long>, score string, rank string, width string, row_block string"


def table(spark, rows):
    return spark.createDataFrame([(i, label, v, *["own"] * 4) for i, label, v in rows], SCHEMA)


def plain(rows, every=5, positives=5, negatives=3):
    rows = [r for r in rows if None not in r and r[2] and None not in r[2]]
    first = {}
    for i, label, v in sorted(rows):
        first.setdefault(i, (label, v))
    out = []
    for a, (label, v) in first.items():
        if a % every:
            continue
        scores = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), b, other) for b, (other, w) in first.items() if b != a))
        for p, b, _ in [s for s in scores if s[2] == label][:positives]:
            fits = [(s, n) for s, n, other in scores if other != label and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(a, b, rank, n, -p, -s) for rank, (s, n) in enumerate(fits[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("largest, width", [(1, 3), (160, 64), (2**13, 64), (2**26, 5)])
def test_products_are_exact(largest, width):
    rng = np.random.default_rng(largest)
    rows, asks = rng.integers(-largest, largest + 1, (37, width)), rng.integers(-largest, largest + 1, (11, width))
    rows[0], asks[0] = largest, -largest
    packing = Packing.plan(width, largest)
    got = packing.products(asks, packing.pack(rows), rows.sum(axis=1))
    want = [[sum(int(x) * int(y) for x, y in zip(a, r, strict=True)) for r in rows] for a in asks]
    assert got.tolist() == want
    assert packing.fields >= 2


def test_leading_takes_the_first_of_equal_entries():
    low = np.iinfo(np.int64).min
    scores = np.array([[3, 5, 5, 5, 1], [low, low, 2, low, low], [7, 7, 7, 7, 7]])
    i, j = leading(scores, 2)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 2), (2, 0), (2, 1)]


@pytest.mark.parametrize("settings", [Settings(), Settings(rows=17, anchors=3, tile=2)])
def test_mining_equals_all_pairs(spark, settings):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), rng.integers(-6, 7, 4).tolist()) for i in range(220)]
    rows += [(i + 1000, 1, rows[4][2]) for i in range(30)]  # ties
    rows += [rows[5], rows[5], (10, 2, [1, 1, 1, 1]), (15, 0, rows[15][2])]  # repeated rows and ids
    got = sorted(map(tuple, hard_negatives(table(spark, rows), "vec_id % 5 = 0", settings).collect()))
    assert got == plain(rows) and len(got) > 200


def test_odd_rows_take_no_part(spark):
    rows = [(i, i % 2, [i % 5, 2, 1]) for i in range(30)]
    odd = [(None, 0, [1, 2, 3]), (35, None, [1, 2, 3]), (40, 1, None), (45, 1, [1, None, 2]), (50, 0, []), (55, 1, [1, 2]), (55, 1, [9, 9])]
    got = sorted(map(tuple, hard_negatives(table(spark, rows + odd), "vec_id % 5 = 0").collect()))
    assert got == plain(rows)


def test_no_rows_no_anchors_no_positives(spark):
    assert hard_negatives(table(spark, []), "vec_id % 5 = 0").count() == 0
    assert hard_negatives(table(spark, [(1, 0, [1]), (2, 1, [1])]), "vec_id % 5 = 0").count() == 0
    assert hard_negatives(table(spark, [(5, 0, [1]), (6, 1, [1])]), "vec_id % 5 = 0").count() == 0


def test_scores_beyond_a_long_are_refused(spark):
    with pytest.raises(ValueError, match="long"):
        hard_negatives(table(spark, [(5, 0, [2**40, 1]), (6, 0, [1, 1])]), "vec_id % 5 = 0")
