"""Axis grids: every coordinate combination, empty cells kept, completeness checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def axis_grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """All combinations of declared axis values, exploded from literals (no data is paired)."""
    df = spark.range(1).select()
    for name, values in axes.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df


def densify(grid: DataFrame, cells: DataFrame, keys: Sequence[str], zero: Mapping[str, object]) -> DataFrame:
    """Grid cells with their aggregates; empty cells stay, with the given zero counts."""
    joined = grid.join(cells, list(keys), "left")
    return reduce(lambda d, kv: d.withColumn(kv[0], F.coalesce(F.col(kv[0]), F.lit(kv[1]))), zero.items(), joined)


def family_gaps(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids missing from, or unexpected in, an observed family; empty means complete."""
    want, have = expected.select(*keys).distinct(), observed.select(*keys).distinct()
    missing = want.join(have, list(keys), "left_anti").withColumn("problem", F.lit("missing"))
    extra = have.join(want, list(keys), "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(extra)
