"""Prices of zero: divisions and logarithms follow IEEE 754, as the SQL does."""

from __future__ import annotations

from datetime import datetime, timedelta
from math import inf, isnan

import oracle
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.real import divide, ln_ratio, sign
from tapeloom.operators.quantiles import quantiles
from tapeloom.operators.slices import Slices

NAMES = ("high_low_spread", "prior_close_returns", "realized_measures", "rolling_activity_windows")


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("zeros"))
    start = datetime(2024, 1, 1)
    values = [5.0, 0.0, 0.0, 7.5, 3.25, 9.0, 0.0, 2.0]
    rows = [(n, start + timedelta(hours=2 * n, seconds=n), n % 3, "ab"[n % 2], values[n % 7 if n % 5 else n % 8] if n < 60 else 1.0 + n % 11, "") for n in range(240)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    return folder, con


@pytest.mark.parametrize("name", NAMES)
def test_zero_prices_equal_sql(spark, zeros, name):
    from __spark_entry__ import oracle_sql, queries

    assert oracle.compare(spark, name, queries()[name], oracle_sql()[name], *zeros) is None


def test_division_and_logarithm(spark):
    nan = float("nan")
    pairs = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (0.0, 2.0), (8.0, 2.0), (-8.0, 2.0), (nan, 0.0), (0.0, nan), (None, 0.0), (1.0, None)]
    rows = spark.createDataFrame(pairs, "a double, b double").select(divide("a", "b"), ln_ratio("a", "b"), sign("a")).collect()
    shown = [tuple("nan" if x is not None and isnan(x) else x for x in r) for r in rows]
    assert [r[0] for r in shown] == [inf, -inf, "nan", 0.0, 4.0, -4.0, "nan", "nan", None, None]
    assert [r[1] for r in shown] == [inf, "nan", "nan", -inf, pytest.approx(1.3862943611198906), "nan", "nan", "nan", None, None]
    assert [r[2] for r in shown] == [1.0, -1.0, 0.0, 0.0, 1.0, -1.0, 0.0, 0.0, None, 1.0]


def test_quantiles_with_infinities(spark):
    rows = spark.createDataFrame([("a", x) for x in (1.0, 2.0, inf)] + [("b", x) for x in (-inf, 1.0, inf, float("nan"))], "g string, x double")
    cuts = Slices.plan(rows, "x", rows_per_slice=1)
    assert all(abs(c) < inf for c in cuts.cuts)
    got = {r.g: r.m for r in quantiles(rows, ["g"], "x", {"m": 0.5}, cuts).collect()}
    assert got["a"] == 2.0 and got["b"] == inf
    assert rows.select(F.max(cuts.of("x"))).first()[0] == len(cuts.cuts)
