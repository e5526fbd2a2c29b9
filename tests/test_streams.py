"""Streams over a table stored as a folder of files, in several micro-batches, and over nothing."""

from __future__ import annotations

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from tapeloom.plans import load_all

QUERIES, ORACLES = load_all()
STREAMS = sorted(n for n in QUERIES if n.startswith("stream_"))


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The events in time order, in three files written one after the other."""
    at = tmp_path_factory.mktemp("folder")
    events = spark.read.parquet(f"{sf}/events.parquet")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    step = (high - low) / 3
    for part in range(3):
        rows = events.where((F.col("ts") >= low + part * step) & ((F.col("ts") < low + (part + 1) * step) | F.lit(part == 2)))
        rows.coalesce(1).write.mode("append").parquet(f"{at}/events.parquet")
    return str(at)


@pytest.mark.parametrize("name", STREAMS)
def test_folder_in_three_batches_gives_the_same_rows(spark, sf, folder, name):
    spark.conf.set("spark.tapeloom.filesPerTrigger", "1")
    try:
        assert compare(spark, name, QUERIES[name], ORACLES[name], folder, connect(sf)) is None
    finally:
        spark.conf.unset("spark.tapeloom.filesPerTrigger")


@pytest.mark.parametrize("name", STREAMS)
def test_no_events_give_no_rows(spark, sf, tmp_path, name):
    spark.read.parquet(f"{sf}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    rows = QUERIES[name](spark, str(tmp_path)).collect()
    assert all(not any(r) for r in rows) and len(rows) <= (name == "stream_deduplicated_updates")  # a total of nothing
