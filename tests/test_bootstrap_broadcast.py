"""Drawn runs and prefix sums are as many as rows, whatever Spark estimates, so they never travel through the driver."""

from __future__ import annotations

import re

import pytest

from tapeloom.plans import resampling_queries as Q


@pytest.mark.parametrize("name", ["stationary_bootstrap_means", "mean_three_ways"])
def test_ends_of_runs_are_not_broadcast(spark, sf, name):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10g")
    try:
        plan = getattr(Q, name)(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    on_position = [line for line in plan.splitlines() if re.search(r"Join \[.*position#", line)]
    assert on_position and all("SortMergeJoin" in line for line in on_position)
