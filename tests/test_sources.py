"""Readers, writers, masters, chain payloads, catalogue and digests on small files."""

from __future__ import annotations

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import clock as C
from tapeloom.operators.slices import Slices
from tapeloom.sources import bars as BR
from tapeloom.sources import masters as M
from tapeloom.sources import tape as T
from tapeloom.sources.catalog import fold_events
from tapeloom.sources.schemas import TAPE, schema_problems


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def tape_rows(n=6):
    base = {f.name: None for f in TAPE}
    rows = []
    for i in range(1, n + 1):
        rows.append(
            base
            | {
                "run_id": "r", "receive_sequence": i, "connection_epoch": 1, "source": "s", "event_type": "depth20" if i % 2 else "quote",
                "instrument_id": f"I{i % 3}", "broker_security_id": "7", "exchange_segment": "E", "raw_message_size_bytes": 1, "connection_id": "c",
                "receive_ts": dt.datetime(2026, 8, 10, 5, 0, i), "bids": [], "asks": [], "quality_flags": [],
            }
        )
    return rows


def test_tape_round_trip_filters_and_metadata(spark, folder):
    df = spark.createDataFrame(tape_rows(), TAPE)
    T.write_tape(df, f"{folder}/tape", files=2, partition_by=["trading_date"])
    back = T.read_tape(spark, f"{folder}/tape", start="2026-08-10 05:00:02", end="2026-08-10 05:00:05", channels=["standard"])
    assert sorted(r["receive_sequence"] for r in back.collect()) == [2, 4]
    meta = T.describe_files(spark.read.parquet(f"{folder}/tape")).agg(F.sum("rows"), F.min("first_sequence"), F.max("last_sequence")).first()
    assert tuple(meta) == (6, 1, 6)
    assert schema_problems(df.drop("source"), TAPE) == ["missing field source"]


def test_filters_reach_the_scan(spark, folder):
    T.write_tape(spark.createDataFrame(tape_rows(), TAPE), f"{folder}/tape", files=1, partition_by=["trading_date", "event_type"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    df = T.read_tape(spark, f"{folder}/tape", start="2026-08-10 05:00:02", channels=["depth20"], instrument_ids=["I1"]).select("receive_sequence")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_type" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(receive_ts" in plan and "EqualTo(instrument_id,I1)" in plan
    assert "bids" not in plan.split("ReadSchema")[1]


def test_jsonl_migration_and_corrupt_lines(spark, folder):
    spark.createDataFrame(tape_rows(), TAPE).coalesce(1).write.json(f"{folder}/in")
    with open(f"{folder}/in/extra.json", "w") as f:
        f.write('{"run_id": "r", "receive_seq')
    rows = T.read_tape_jsonl(spark, f"{folder}/in").cache()
    assert rows.where("_corrupt is not null").count() == 1
    out = {r["side"]: (r["rows"], r["digest"]) for r in T.migrate_jsonl(spark, f"{folder}/in", f"{folder}/out", files=1).collect()}
    assert out["source"] == out["target"] and out["source"][0] == 6


def test_export_archive_and_panel(spark, folder):
    df = spark.createDataFrame(tape_rows(), TAPE)
    T.export_rows(df, f"{folder}/x", limit=2, fmt="csv")
    assert spark.read.option("header", True).csv(f"{folder}/x").count() == 2
    T.archive_tape(df, f"{folder}/a")
    assert any(n.endswith(".json.gz") for n in os.listdir(f"{folder}/a"))
    panel = spark.createDataFrame([("a", 1.5, "train")], "id string, x double, role string")
    T.write_panel(panel, f"{folder}/p")
    assert T.read_panel(spark, f"{folder}/p", panel.schema).collect() == panel.collect()


def test_contract_violations(spark):
    rows = tape_rows(1)
    rows[0] |= {"receive_sequence": 0, "trade_side": "buy", "event_type": "depth20", "connection_id": " "}
    got = spark.createDataFrame(rows, TAPE).select(T.contract_violations().alias("v")).first()["v"]
    assert got == ["sequence_and_epoch_positive", "connection_id_required", "classification_complete", "classification_on_prints_only"]


def test_segment_pruning(spark):
    seg = spark.createDataFrame(
        [("a", dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2), ["depth20"], ["X"]), ("b", dt.datetime(2026, 1, 3), dt.datetime(2026, 1, 4), ["quote"], ["Y"])],
        "path string, coverage_start timestamp, coverage_end timestamp, channels array<string>, instrument_ids array<string>",
    )
    assert [r["path"] for r in T.live_segments(seg, start="2026-01-02 12:00:00").collect()] == ["b"]
    assert [r["path"] for r in T.live_segments(seg, channels=["depth20"]).collect()] == ["a"]


def test_master_layouts_and_chain(spark, folder):
    with open(f"{folder}/a.csv", "w") as f:
        f.write(
            "SEM_EXM_EXCH_ID,SEM_SEGMENT,SEM_SMST_SECURITY_ID,SEM_INSTRUMENT_NAME,SEM_TRADING_SYMBOL,SEM_EXPIRY_DATE,SEM_STRIKE_PRICE,SEM_OPTION_TYPE,SEM_LOT_UNITS,SEM_TICK_SIZE\n"
            "NSE,D,11,OPTIDX,ABC-Aug2026-CE,2026-08-25 14:30:00,25000.00000,CE,75.0,5.0\n"
            "NSE,D,12,FUTIDX,ABC-Aug2026-FUT,2026-08-25 14:30:00,-0.01,XX,75.0,5.0\n"
            "BSE,D,13,FUTIDX,ABC,,,,,\nNSE,D,x1,FUTIDX,ABC,,,,,\nNSE,E,14,EQUITY,DEF,,,,1,5\n"
        )
    a = M.read_master_a(spark, f"{folder}/a.csv", "2026-08-01")
    ids = sorted(r["instrument_id"] for r in a.collect())
    assert ids == ["NSE:NSE_EQ:DEF:equity", "NSE:NSE_FNO:ABC:future:2026-08-25", "NSE:NSE_FNO:ABC:option:2026-08-25:25000:CE"]
    with open(f"{folder}/b.csv", "w") as f:
        f.write(
            "pSymbol,pSymbolName,pTrdSymbol,pInstType,pOptionType,pExpiryDate,dStrikePrice;,pScripRefKey\n"
            "91,ABC,ABC26AUG25000CE,OPTIDX,CE,25AUG2026,2500000.00,\n92,ABC,ABC26AUGFUT,FUTIDX,XX,,-1,ABC25AUG26\n93,ABC,Z,OPTIDX,CE,25AUG2026,-1,\n"
        )
    b = {r["instrument_token"]: r["instrument_id"] for r in M.read_master_b(spark, f"{folder}/b.csv", "2026-08-01").collect()}
    assert b == {"91": "NSE:NSE_FNO:ABC:option:2026-08-25:25000:CE", "92": "NSE:NSE_FNO:ABC:future:2026-08-25"}
    payload = {"last_price": 24990.0, "oc": {"25000.0": {"ce": {"security_id": "11", "oi": 5}, "pe": {"security_id": "77", "oi": 6}}}}
    chain = M.explode_chain(spark.createDataFrame([(1, json.dumps(payload))], "id int, p string"), "p", ["id"])
    out = {r["option_type"]: r["problem"] for r in M.check_chain(chain, a).collect()}
    assert out == {"CE": None, "PE": "absent_from_master"}


def test_minute_files_registry_and_index(spark, folder):
    with open(f"{folder}/m.csv", "w") as f:
        f.write("datetime,strike,close,iv,oi,spot,volume\n2026-08-03 09:20:00+05:30,100,5,12,10,101,7\n2026-08-03 09:21:00+05:30,100,6,12,10,101,7\n")
    rows = M.read_minute_files(spark, f"{folder}/m.csv", "CALL", ["09:20"]).collect()
    assert [(r["date"], r["clock"], r["side"], r["close"]) for r in rows] == [("2026-08-03", "09:20", "CALL", 5.0)]
    with open(f"{folder}/r.json", "w") as f:
        json.dump({"features": [{"name": "a"}, {"name": "b"}]}, f, indent=1)
    from pyspark.sql import types as ST

    reg = M.read_registry(spark, f"{folder}/r.json", "features", ST.StructType([ST.StructField("name", ST.StringType())]))
    assert sorted(r["name"] for r in reg.collect()) == ["a", "b"]
    with open(f"{folder}/v.csv", "w") as f:
        f.write(
            "datetime,open,close\n2026-08-03 09:00:00+05:30,9,9\n2026-08-03 09:16:00+05:30,3,4\n2026-08-03 09:15:00+05:30,1,2\n"
            "2026-08-03 15:30:00+05:30,5,6\n2026-08-03 15:30:00+05:30,7,8\n2026-08-03 15:31:00+05:30,0,0\n2026-08-04 16:00:00+05:30,1,1\n"
        )
    got = [tuple(r) for r in M.read_daily_index(spark, f"{folder}/v.csv").collect()]
    assert got == [(dt.date(2026, 8, 3), 1.0, 8.0, 3)]


def test_bars_write_once(spark, folder):
    day = dt.datetime(2026, 8, 3)
    row = ("1", "I", "7", "1m", day, day + dt.timedelta(minutes=1), 1.0, 2.0, 1.0, 1.5, 10, None, "s", "observed")
    from tapeloom.sources.schemas import BARS

    df = spark.createDataFrame([row], "schema_version string, instrument_id string, broker_security_id string, interval string, bar_start timestamp, bar_end timestamp, open double, high double, low double, close double, volume long, open_interest long, source string, category string")
    df = df.select(*[F.col(f.name).cast(f.dataType) for f in BARS])
    BR.write_bars(df, f"{folder}/bars")
    assert BR.read_bars(spark, f"{folder}/bars").count() == 1
    with pytest.raises(Exception):
        BR.write_bars(df, f"{folder}/bars")
    with pytest.raises(ValueError):
        BR.write_bars(df.withColumn("high", F.lit(0.5).cast("decimal(38,12)")), f"{folder}/bad")


def test_catalogue_problems(spark):
    ev = [
        ("d1", 1, "dataset_registered", "active", None, "x1"), ("d1", 2, "dataset_published", "completed", "x1", "x2"),
        ("d2", 1, "dataset_registered", "active", None, "y1"), ("d2", 3, "segment_published", "active", "y1", "y3"),
        ("d3", 1, "dataset_registered", "completed", None, "z1"), ("d3", 2, "segment_published", "active", "z1", "z2"),
    ]
    df = spark.createDataFrame(ev, "dataset_id string, event_sequence long, event_type string, status string, prior_event_digest string, event_digest string")
    got = {r["dataset_id"]: (r["status"], r["problem"]) for r in fold_events(df, Slices((1.5,))).collect()}
    assert got == {"d1": ("completed", None), "d2": ("active", "non_contiguous_history"), "d3": ("active", "terminal_status_changed")}


def test_clock(spark):
    rows = spark.createDataFrame([("2026-08-02T10:00:01.123456789+00:00",), ("2026-08-03T10:05:00+05:30",)], "s string")
    got = [r["n"] for r in rows.select(C.iso_to_ns(F.col("s")).alias("n")).collect()]
    assert got == [1785664801123456789, 1785731700000000000]
    # 15:35 local is outside the session before the close moved and inside after.
    us = [int(dt.datetime(2026, 7, 31, 10, 5, tzinfo=dt.timezone.utc).timestamp() * 1e6), int(dt.datetime(2026, 8, 3, 10, 5, tzinfo=dt.timezone.utc).timestamp() * 1e6)]
    df = spark.createDataFrame([(u,) for u in us], "t long")
    assert [r["x"] for r in df.select(C.in_session(F.col("t")).alias("x")).collect()] == [False, True]


def test_functions_travel_by_value():
    """Workers need neither an install nor the driver's working directory."""
    from pyspark import cloudpickle

    import tapeloom  # noqa: F401
    from tapeloom.operators.chain import _fit

    assert "tapeloom" in cloudpickle.list_registry_pickle_by_value()
    assert len(cloudpickle.dumps(_fit)) > 1000
