"""Null distributions: circular shifts and shuffles within buckets; permutation tests are in ``resampling``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slices import Slices, ordered_scan, row_no, total


def circular_shift_correlations(
    df: DataFrame, groups: Sequence[str], order_by: Sequence[str], x: str, y: str, offsets: Sequence[int], slices: Slices
) -> DataFrame:
    """Correlation of x with y moved ahead by each offset, wrapping at the end of the group.

    A shifted copy of y is addressed by position, so every replicate is one equi-join row per row.
    """
    n = ordered_scan(df, groups, order_by, slices, {"__i": row_no(), "__n": total(F.lit(1).cast("long"))})
    i = F.col("__i") - 1
    asked = n.select(*groups, x, F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset"), i.alias("__i"), "__n").withColumn(
        "__at", F.pmod(F.col("__i") + F.col("offset"), F.col("__n"))
    )
    values = n.select(*groups, i.alias("__at"), F.col(y).alias("__y"))
    return asked.join(values, [*groups, "__at"]).groupBy(*groups, "offset").agg(
        F.count(F.lit(1)).alias("n"), F.corr(x, "__y").alias("correlation")
    )


def shuffle_within_bucket(
    df: DataFrame, buckets: Sequence[str], id_col: str, value: str, seed: int, slices: Slices
) -> DataFrame:
    """Give every row the value of a random row of its bucket (a seeded permutation).

    ``slices`` cut the 31-bit hash range, so a hot bucket is ordered slice by slice.
    """
    h1 = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 31))
    by_hash = ordered_scan(df.withColumn("__h", h1), buckets, ["__h", id_col], slices, {"__i": row_no()})
    h2 = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + 1)), F.lit(1 << 31))
    targets = ordered_scan(df.withColumn("__h", h2).drop(value), buckets, ["__h", id_col], slices, {"__i": row_no()}).drop("__h")
    return targets.join(by_hash.select(*buckets, "__i", value), [*buckets, "__i"]).drop("__i")
