"""Chronological splits and walk-forward folds with embargo."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slices import Slices, ordered_scan, row_no, total


def embargoed_split(
    df: DataFrame, tape: str, ts: str, tie: str, slices: Slices, *, train_fraction: float = 0.7, embargo: int = 0
) -> DataFrame:
    """``split`` = train | embargo | test per tape: the embargo band after the cut is in neither side."""
    n = ordered_scan(df, [tape], [ts, tie], slices, {"__i": row_no(), "__n": total(F.lit(1).cast("long"))})
    cut = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(train_fraction)))
    edges = n.where(F.col("__i") == cut).select(tape, F.col(ts).alias("__edge"))
    # One boundary row per tape.
    split = (
        F.when(F.col(ts) <= F.col("__edge"), "train").when(F.col(ts) <= F.col("__edge") + embargo, "embargo").otherwise("test")
    )
    return df.join(edges, tape).withColumn("split", split).drop("__edge")


def expanding_folds(sessions: DataFrame, session: str, folds: int, embargo: int, minimum_train: int, slices: Slices) -> DataFrame:
    """Fold table: each fold tests one block of sessions and trains on all sessions at least
    ``embargo`` sessions before it."""
    ranked = ordered_scan(
        sessions.select(session).distinct().withColumn("__k", F.lit(0)), ["__k"], [session], slices,
        {"i": row_no(), "n": total(F.lit(1).cast("long"))},
    )
    width = F.greatest(F.floor((F.col("n") - minimum_train) / folds), F.lit(1))
    fold = F.floor((F.col("i") - 1 - minimum_train) / width)
    first = F.lit(minimum_train) + F.col("fold") * width
    roles = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    return (
        ranked.withColumn("own", F.least(fold, F.lit(folds - 1)))
        .withColumn("fold", roles)
        .withColumn("role", F.when(F.col("own") == F.col("fold"), "test").when(F.col("i") <= first - embargo, "train"))
        .where(F.col("role").isNotNull())
        .select("fold", session, "role")
    )


def walk_forward_block(ts: str, origin: str, block: int):
    """Block number of a row counted from an origin column."""
    return F.floor((F.col(ts) - F.col(origin)) / F.lit(block))
