"""Results that lie beside a tie of their rounding."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import oracle
import pytest

from tapeloom.functions.real import rounded

#: Open or close, and the price before: 100 * (a / b - 1) lies just beside a fifth decimal of 5.
BESIDE = [(59.99, 160.0), (68.29, 160.0), (63.09, 160.0), (109.29, 160.0)]


def test_prior_close_returns_beside_a_tie_equal_sql(spark, tmp_path):
    from __spark_entry__ import oracle_sql, queries

    start = datetime(2024, 1, 1)
    values = [x for a, b in BESIDE for x in (b, b, b, a)]
    rows = [(n, start + timedelta(hours=12 * n, seconds=1), 1, "a", v, "") for n, v in enumerate(values)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    name = "prior_close_returns"
    assert oracle.compare(spark, name, queries()[name], oracle_sql()[name], str(tmp_path), con) is None


@pytest.mark.parametrize("digits", [2, 4, 6])
def test_rounding_is_that_of_the_sql(spark, digits):
    rng = random.Random(digits)
    ties = [(2 * rng.randrange(10**6) + 1) / (2 * 10**digits) for _ in range(500)]
    values = [100 * (a / b - 1) for a, b in BESIDE] + [x * s for x in ties for s in (1, -1, 1 + 2**-52, 1 - 2**-53)] + [float("inf"), float("-inf"), 0.0, None]
    got = [r[0] for r in spark.createDataFrame([(n, x) for n, x in enumerate(values)], "n long, x double").orderBy("n").select(rounded("x", digits)).collect()]
    con = oracle.duckdb.connect()
    assert got == [con.execute(f"SELECT round(CAST(? AS DOUBLE), {digits})", [x]).fetchone()[0] for x in values]
