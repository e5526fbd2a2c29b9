"""Comparisons with strictly earlier sessions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .slices import SLICE, Slices


def past_session_percentiles(
    df: DataFrame, groups: Sequence[str], session: str, value: str, slices: Slices
) -> DataFrame:
    """Per distinct (group, session, value): earlier-session history size and its part at or below.

    The count is over two orders at once (session and value), so values are cut into slices: what
    lies in lower slices comes from a (slice, session) count table, and only the rows of one slice
    are compared inside a task.
    """
    # The counts are read five times below; what they were counted from is read once.
    cells = cut_lineage(df.groupBy(*groups, session, value).agg(F.count(F.lit(1)).alias("events"))).withColumn(SLICE, slices.of(value))
    blocks = cells.groupBy(*groups, SLICE, session).agg(F.sum("events").alias("n"))
    # Lattice of slices and sessions of a group: both are small axes whatever the data size.
    lattice = (
        blocks.select(*groups, SLICE).distinct()
        .join(blocks.select(*groups, session).distinct(), list(groups))
        .join(blocks, [*groups, SLICE, session], "left")
    )
    lower = Window.partitionBy(*groups, session).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups, session)
    earlier = Window.partitionBy(*groups, SLICE).orderBy(session).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    carried = (
        lattice.withColumn("__low", F.coalesce(F.sum("n").over(lower), zero))
        .withColumn("__all", F.coalesce(F.sum("n").over(whole), zero))
        .withColumn("__below", F.coalesce(F.sum("__low").over(earlier), zero))
        .withColumn("history_n", F.coalesce(F.sum("__all").over(earlier), zero))
        .select(*groups, SLICE, session, "__below", "history_n")
    )
    schema = T.StructType([*cells.schema.fields, T.StructField("__here", T.LongType())])

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([session, value], kind="stable")
        values, counts = pdf[value].to_numpy(), pdf["events"].to_numpy()
        out = np.zeros(len(pdf), dtype=np.int64)
        seen_v, seen_n = values[:0], counts[:0]
        for rows in pdf.groupby(session, sort=True).indices.values():
            total = np.concatenate([[0], np.cumsum(seen_n)])
            out[rows] = total[np.searchsorted(seen_v, values[rows], side="right")]
            seen_v, seen_n = np.concatenate([seen_v, values[rows]]), np.concatenate([seen_n, counts[rows]])
            order = np.argsort(seen_v, kind="stable")
            seen_v, seen_n = seen_v[order], seen_n[order]
        return pdf.assign(__here=out)

    local = cells.groupBy(*groups, SLICE).applyInPandas(inside, schema)
    return local.join(carried, [*groups, SLICE, session]).select(
        *groups, session, value, "events", "history_n", (F.col("__below") + F.col("__here")).alias("at_or_below")
    )
