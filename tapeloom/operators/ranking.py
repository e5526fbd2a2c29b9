"""Top-k reports that keep k rows of a group in every task before the final ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _ordering(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in order]


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence[tuple[str, bool]], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group.

    Spark cuts each task's rows of a group to k before the shuffle as long as k is below its group-limit
    threshold. Beyond it rows are first ranked by group and salt, with as many salts as the session has
    shuffle partitions, so a hot group is never ranked whole in one task.
    """
    final = Window.partitionBy(*groups).orderBy(*_ordering(order))
    conf = df.sparkSession.conf
    if k >= int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        salts = int(conf.get("spark.sql.shuffle.partitions"))
        first = Window.partitionBy(*groups, "__salt").orderBy(*_ordering(order))
        df = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c, _ in order]), F.lit(salts)))
        df = df.withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= k).drop("__salt")
    return df.withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def round_robin(df: DataFrame, group: str, order: Sequence[str], limit: int) -> DataFrame:
    """Deal rows group by group in order until ``limit`` rows are taken."""
    ranked = top_k(df, [group], [(c, True) for c in order], limit, "__rn")
    return ranked.orderBy("__rn", group).limit(limit).drop("__rn")
