"""Association tables and closed-form test statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pearson_table(df: DataFrame, groups: Sequence[str], features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Complete feature x target table of Pearson correlations in one aggregation pass."""
    pairs = [(f, t) for f in features for t in targets]
    aggs = []
    for i, (f, t) in enumerate(pairs):
        both = F.col(f).isNotNull() & F.col(t).isNotNull()
        aggs.append(F.corr(f, t).alias(f"__c{i}"))
        aggs.append(F.count(F.when(both, 1)).alias(f"__n{i}"))
    wide = df.groupBy(*groups).agg(*aggs)
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"), F.lit(t).alias("target"), F.col(f"__n{i}").alias("n"), F.col(f"__c{i}").alias("pearson")
            )
            for i, (f, t) in enumerate(pairs)
        ]
    )
    return wide.select(*groups, F.inline(cells))


def two_proportion_z(s1: str, n1: str, s2: str, n2: str) -> Column:
    """Pooled two-proportion z statistic; null when the pooled variance is zero."""
    a, m, b, n = (F.col(c).cast("double") for c in (s1, n1, s2, n2))
    pooled = (a + b) / (m + n)
    variance = pooled * (1 - pooled) * (1 / m + 1 / n)
    return F.when(variance > 0, (a / m - b / n) / F.sqrt(variance))


def binomial_z(successes: Column, n: Column, p0: float = 0.5) -> Column:
    return (successes - n * p0) / F.sqrt(n * p0 * (1 - p0))


def correlations(rows: DataFrame, vector: str) -> DataFrame:
    """(a, b, r): correlation of every two positions (from 1) of an array column, in one pass.

    Each batch of rows becomes sums and cross products as one matrix product; only those, a row for each
    two positions, are added up by Spark. Rows with a null array or a null in it are left out, and all
    arrays must be of one length. The pair of a position that does not vary has no correlation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            k, sums, squares = x.shape[1], x.sum(axis=0), (x * x).sum(axis=0)
            a, b = np.divmod(np.arange(k * k), k)
            columns = [a + 1, b + 1, np.full(k * k, len(x)), sums[a], sums[b], squares[a], squares[b], (x.T @ x).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    names = ["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"]
    whole = rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull())).select(vector)
    parts = whole.mapInArrow(run, "a long, b long, n long, sa double, sb double, saa double, sbb double, sab double")
    t = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in names[2:]])
    n = F.col("n")
    spread = (n * F.col("saa") - F.col("sa") ** 2) * (n * F.col("sbb") - F.col("sb") ** 2)
    return t.select("a", "b", F.when(spread > 0, (n * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(spread)).alias("r"))
