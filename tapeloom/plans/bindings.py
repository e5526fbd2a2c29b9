"""How the market-data objects are read out of the given tables.

Tape rows are ``events``: the user is the instrument, the event type is the channel. Ladders are a
row-wise expansion of the same events, so book queries grow with the table. Each binding has a SQL
twin used by the oracle statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.book import TICK
from ..operators.slices import Slices
from ..session import prepare

HOUR = 3_600_000_000
DAY = 24 * HOUR
KEYS = ["instrument_id"]

_SLICES: dict[tuple, Slices] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument_id, seq, ts_us, channel, value."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("instrument_id"),
        F.col("event_id").alias("seq"),
        micros("ts").alias("ts_us"),
        F.col("event_type").alias("channel"),
        "value",
    )


def time_slices(spark: SparkSession, sf_dir: str) -> Slices:
    """Time cuts of the tape, planned once per session and table."""
    key = (spark.sparkContext.applicationId, sf_dir, "ts_us")
    if key not in _SLICES:
        _SLICES[key] = Slices.plan(tape(spark, sf_dir), "ts_us", rows_per_slice=_rows(spark))
    return _SLICES[key]


def train_until(spark: SparkSession, sf_dir: str) -> int:
    """The instant at seven tenths of the tape's span: training ends there, whatever dates the tape has."""
    low, high = tape(spark, sf_dir).agg(F.min("ts_us"), F.max("ts_us")).first()
    return 0 if low is None else low + (high - low) * 7 // 10


def slices_for(spark: SparkSession, sf_dir: str, tag: str, df: DataFrame, column: str) -> Slices:
    """Cuts of any other ordered column, cached under a tag."""
    key = (spark.sparkContext.applicationId, sf_dir, tag)
    if key not in _SLICES:
        _SLICES[key] = Slices.plan(df, column, rows_per_slice=_rows(spark))
    return _SLICES[key]


def _rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.tapeloom.rowsPerSlice", "2000000"))


def ladders(seq: Column, value: Column, levels: int = 6) -> tuple[Column, Column]:
    """Both ladders (bids, asks) of a tape row, from its own fields.

    The base mid moves in whole ticks with ``value``; every 41st row is crossed and every 53rd
    has no bids, so the refusal branches are exercised.
    """
    base = F.lit(1000) + F.floor(value / 20)
    half = F.when(seq % 41 == 0, F.lit(-2)).otherwise(1 + seq % 3)
    step = 1 + seq % 2

    def level(i: Column, side: int) -> Column:
        i = i.cast("long")
        ticks = base + side * (half + i * step)
        weight = seq * (31 if side < 0 else 37) + i * (17 if side < 0 else 13)
        return F.struct(
            (ticks.cast("double") * F.lit(TICK)).alias("price"),
            (1 + weight % (97 if side < 0 else 89)).cast("long").alias("quantity"),
            (1 + (seq + i * (5 if side < 0 else 7)) % 9).cast("int").alias("orders"),
        )

    rungs = F.sequence(F.lit(0), F.lit(levels - 1))
    bids = F.transform(rungs, lambda i: level(i, -1))
    asks = F.transform(rungs, lambda i: level(i, 1))
    return F.when(seq % 53 == 0, F.slice(bids, 1, 0)).otherwise(bids), asks


def books(spark: SparkSession, sf_dir: str, levels: int = 6) -> DataFrame:
    """Tape rows with the two ladders derived from each row's own fields, see ``ladders``."""
    bids, asks = ladders(F.col("seq"), F.col("value"), levels)
    return tape(spark, sf_dir).withColumn("bids", bids).withColumn("asks", asks)


TAPE_SQL = """tape AS (SELECT user_id AS instrument_id, event_id AS seq, epoch_us(ts) AS ts_us,
  event_type AS channel, value FROM events)"""


def books_sql(levels: int = 6) -> str:
    """CTEs ``tape`` and ``books`` for the oracle (ladders as lists of structs)."""
    return f"""{TAPE_SQL},
geom AS (SELECT *, 1000 + CAST(floor(value / 20) AS BIGINT) AS base,
  CASE WHEN seq % 41 = 0 THEN -2 ELSE 1 + seq % 3 END AS half, 1 + seq % 2 AS step FROM tape),
books AS (SELECT instrument_id, seq, ts_us, channel, value,
  CASE WHEN seq % 53 = 0 THEN [] ELSE list_transform(range({levels}), lambda i: {{
    'price': CAST(base - (half + i * step) AS DOUBLE) * 0.05,
    'quantity': 1 + (seq * 31 + i * 17) % 97,
    'orders': 1 + (seq + i * 5) % 9}}) END AS bids,
  list_transform(range({levels}), lambda i: {{
    'price': CAST(base + (half + i * step) AS DOUBLE) * 0.05,
    'quantity': 1 + (seq * 37 + i * 13) % 89,
    'orders': 1 + (seq + i * 7) % 9}}) AS asks
  FROM geom)"""


BOOKS_SQL = books_sql()
