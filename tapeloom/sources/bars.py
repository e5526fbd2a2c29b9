"""Bar artifacts: ordered scan, write-once sink, contract checks and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.slices import Slices, ordered_scan, prev
from .schemas import BARS, schema_problems


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Stored bars in time order."""
    df = spark.read.parquet(path)
    problems = schema_problems(df, BARS)
    if problems:
        raise ValueError("; ".join(problems))
    return df.orderBy("bar_start")


def bar_problems() -> Column:
    """Names of the bar invariants a row breaks."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rules = {
        "bar_end_after_start": F.col("bar_end") <= F.col("bar_start"),
        "prices_positive": F.least(o, h, l, c) <= 0,
        "high_is_highest": h < F.greatest(o, l, c),
        "low_is_lowest": l > F.least(o, h, c),
        "volume_non_negative": F.col("volume") < 0,
        "open_interest_non_negative": F.col("open_interest") < 0,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))


def write_bars(df: DataFrame, path: str) -> None:
    """Write-once sink for one instrument and interval with strictly increasing starts."""
    check = df.agg(
        F.count_distinct("instrument_id", "interval").alias("series"),
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("bar_start").alias("starts"),
        F.count(F.when(F.size(bar_problems()) > 0, 1)).alias("bad"),
    ).first()
    if check["series"] > 1:
        raise ValueError("one bar artifact holds one instrument and interval")
    if check["rows"] != check["starts"]:
        raise ValueError("bars must be strictly time-ordered")
    if check["bad"]:
        raise ValueError(f"{check['bad']} bars break the bar contract")
    df.sort("bar_start").write.mode("errorifexists").option("compression", "zstd").parquet(path)


def bar_gaps(df: DataFrame, keys: list[str], start: str, end: str, slices: Slices) -> DataFrame:
    """Uncovered spans ``[prior end, start)`` between consecutive bars."""
    return (
        ordered_scan(df, keys, [start], slices, {"gap_start": prev(end)})
        .where(F.col("gap_start") < F.col(start))
        .select(*keys, "gap_start", F.col(start).alias("gap_end"))
    )
