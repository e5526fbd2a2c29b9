"""Nearest earlier rows in two scaled coordinates, with kernel weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .slices import Slices, ordered_scan, row_no

_CHUNK = 128  #: rows whose distances to a block are held at once


def _nearest(distance: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's ``k`` smallest entries, of equal ones the first; rows have at least one finite entry."""
    if distance.shape[1] <= k:
        return np.broadcast_to(np.arange(distance.shape[1]), distance.shape)
    last = np.partition(distance, k - 1, axis=1)[:, k - 1, None]
    below, level = distance < last, distance == last
    take = below | (level & (np.cumsum(level, axis=1) <= k - below.sum(axis=1, keepdims=True)))
    return np.nonzero(take)[1].reshape(len(distance), k)


def past_neighbours(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], coordinates: tuple[str, str], value: str, slices: Slices,
    *, bandwidths: tuple[float, float], neighbours: int, history: int, least: int, quantile: float,
) -> DataFrame:
    """``df`` with ``history_rows``, ``uncertainty``, ``tail_p``, ``neighbour_rows`` and ``effective_n``.

    A row looks at the last ``history`` rows of its key strictly before it, takes the ``neighbours`` nearest in the
    two coordinates over their bandwidths (the earlier of equals), and weighs them by exp(-d^2 / 2), at least
    1e-12. ``uncertainty`` is the weighted quantile of their absolute values, ``tail_p`` (1 + weight of those at
    least as large as the row's own) / (1 + all weight). Fewer than ``least`` earlier rows give nulls.

    Rows fall into blocks of ``history`` places, so a row needs its own block and the one before: every row is
    sent to two tasks, whatever the key's size, and distances are held for a few rows at a time. Rows with a
    null coordinate or value are no neighbours and get nulls, and do not count as history.
    """
    x, z = coordinates
    usable = F.col(x).isNotNull() & F.col(z).isNotNull() & F.col(value).isNotNull()
    numbered = ordered_scan(df.where(usable), keys, order_by, slices, {"__i": row_no()})
    narrow = numbered.select(*keys, *[F.col(c) for c in order_by], F.col(x).alias("__x"), F.col(z).alias("__z"), F.col(value).alias("__v"), "__i")
    own = F.expr(f"(__i - 1) div {history}")
    dealt = narrow.withColumn("__own", own).withColumn("__block", F.explode(F.array(F.col("__own"), F.col("__own") + 1)))
    out = [T.StructField("history_rows", T.LongType()), T.StructField("uncertainty", T.DoubleType()), T.StructField("tail_p", T.DoubleType()), T.StructField("neighbour_rows", T.DoubleType()), T.StructField("effective_n", T.DoubleType())]
    schema = T.StructType([*[narrow.schema[c] for c in (*keys, *order_by)], *out])
    names = schema.fieldNames()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        block = pdf["__block"].iloc[0]
        i, ours = pdf["__i"].to_numpy(), (pdf["__own"] == block).to_numpy()
        a, b = pdf["__x"].to_numpy(dtype=float) / bandwidths[0], pdf["__z"].to_numpy(dtype=float) / bandwidths[1]
        v = np.abs(pdf["__v"].to_numpy(dtype=float))
        rows = np.flatnonzero(ours)
        if not len(rows):
            return pd.DataFrame(columns=names)
        result = pdf.iloc[rows][[*keys, *order_by]].copy()
        before = np.minimum(i[rows] - 1, history)
        uncertainty, tail, count, effective = (np.full(len(rows), np.nan) for _ in range(4))
        asked = np.flatnonzero(before >= max(least, 1))
        for at in range(0, len(asked), _CHUNK):
            part = asked[at : at + _CHUNK]
            q = rows[part]
            square = (a[None, :] - a[q, None]) ** 2 + (b[None, :] - b[q, None]) ** 2
            square[(i[None, :] >= i[q, None]) | (i[None, :] < i[q, None] - history)] = np.inf
            near = _nearest(square, min(neighbours, square.shape[1]))
            d = np.take_along_axis(square, near, axis=1)
            w = np.where(np.isfinite(d), np.maximum(np.exp(-0.5 * d), 1e-12), 0.0)
            size = v[near]
            total = w.sum(axis=1)
            order = np.argsort(np.where(w > 0, size, np.inf), axis=1, kind="stable")
            upto = np.cumsum(np.take_along_axis(w, order, axis=1), axis=1)
            first = np.argmax(upto >= (quantile * total)[:, None], axis=1)
            reached = upto[np.arange(len(q)), first] >= quantile * total
            last = (w > 0).sum(axis=1) - 1
            uncertainty[part] = np.take_along_axis(size, order, axis=1)[np.arange(len(q)), np.where(reached, first, last)]
            tail[part] = (1 + (w * (size >= v[q, None])).sum(axis=1)) / (1 + total)
            count[part] = (w > 0).sum(axis=1)
            effective[part] = total**2 / (w**2).sum(axis=1)
        return result.assign(
            history_rows=before, uncertainty=uncertainty, tail_p=tail, neighbour_rows=count, effective_n=effective
        )[names]

    scored = dealt.groupBy(*keys, "__block").applyInPandas(run, schema)
    known = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("uncertainty", "tail_p", "effective_n")]
    scored = scored.select(*keys, *order_by, "history_rows", *known, F.when(~F.isnan("neighbour_rows"), F.col("neighbour_rows")).cast("long").alias("neighbour_rows"))
    return df.join(scored, [*keys, *order_by], "left")
