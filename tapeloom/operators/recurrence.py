"""Serial recursions and greedy selections computed slice by slice.

Each slice is summarised by how it maps any incoming state to its outgoing state; the summaries
are chained per key (one small row per slice) and the true incoming state is handed back to every
slice. No task ever holds more than one slice of a key.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .slices import SLICE, Slices


def linear_recurrence(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], a: str, b: str, slices: Slices, name: str
) -> DataFrame:
    """``s_t = a_t * s_{t-1} + b_t`` with ``s_0 = 0`` along each key.

    A slice maps an incoming state linearly, so its summary is two numbers.
    """
    sliced = df.withColumn(SLICE, slices.of(order_by[0]))
    schema = T.StructType(
        [*sliced.schema.fields, T.StructField("__gain", T.DoubleType()), T.StructField("__own", T.DoubleType())]
    )
    ordering = list(order_by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ordering, kind="stable")
        state, own = 0.0, []
        for gain, push in zip(pdf[a].tolist(), pdf[b].tolist(), strict=True):
            state = gain * state + push
            own.append(state)
        return pdf.assign(__gain=np.cumprod(pdf[a].to_numpy(dtype=float)), __own=own)

    local = sliced.groupBy(*keys, SLICE).applyInPandas(run, schema)
    order = F.struct(*[F.col(c) for c in ordering])
    ends = local.groupBy(*keys, SLICE).agg(
        F.max_by("__gain", order).alias("gain"), F.max_by("__own", order).alias("own")
    )
    chain_schema = T.StructType(
        [*[ends.schema[k] for k in (*keys, SLICE)], T.StructField("__in", T.DoubleType())]
    )
    names = [*keys, SLICE, "__in"]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(SLICE)
        state, entering = 0.0, []
        for gain, own in zip(pdf["gain"].tolist(), pdf["own"].tolist(), strict=True):
            entering.append(state)
            state = gain * state + own
        return pdf.assign(__in=entering)[names]

    carried = ends.groupBy(*keys).applyInPandas(chain, chain_schema)
    return local.join(carried, [*keys, SLICE], "left").select(
        *df.columns, (F.col("__own") + F.col("__gain") * F.col("__in")).alias(name)
    )


def _in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Partitions that hold each key whole and sorted, its first row flagged: what reads them row by row pays for
    rows only, not for each of many small keys."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    return df.withColumn("__first", F.row_number().over(w) == 1).sortWithinPartitions(*keys, *order)


def greedy_non_overlapping(
    df: DataFrame, keys: Sequence[str], start: str, end: str, slices: Slices, name: str = "selected", ties: Sequence[str] = ()
) -> DataFrame:
    """Mark rows kept by the greedy rule: in (start, end, ties) order, keep a row that starts after the
    end of the last kept one.

    The state is the last kept end. Within a slice the final kept end is a non-decreasing step
    function of the incoming one, stored with equal steps merged.
    """
    sliced = df.withColumn(SLICE, slices.of(start))
    head = [*keys, SLICE]
    steps = T.StructType(
        [
            *[sliced.schema[k] for k in head],
            T.StructField("limits", T.ArrayType(T.LongType())),
            T.StructField("exits", T.ArrayType(T.LongType())),
        ]
    )

    def step(starts: list, ends: list) -> tuple[list, list]:
        n = len(starts)
        final = [0] * n
        for i in range(n - 1, -1, -1):
            j = _first_after(starts, ends[i])
            final[i] = ends[i] if j >= n else final[j]
        limits, exits = [], []
        for s, f in zip(starts, final, strict=True):
            # An incoming end below ``s`` (and not below the previous start) keeps this row first.
            if exits and exits[-1] == f:
                limits[-1] = s
            elif not limits or s != limits[-1]:
                limits.append(s)
                exits.append(f)
        return limits, exits

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_head, starts, ends = None, [], []
        for batch in batches:
            firsts = np.flatnonzero(batch.column("__first").to_numpy(zero_copy_only=False))
            own_starts, own_ends = batch.column(start).to_pylist(), batch.column(end).to_pylist()
            heads, found = [] if open_head is None else [open_head], []
            heads.append(batch.select(head).take(pa.array(firsts)))
            begin = 0
            for at in firsts.tolist():
                starts += own_starts[begin:at]
                ends += own_ends[begin:at]
                if starts:
                    found.append(step(starts, ends))
                starts, ends, begin = [], [], at
            starts += own_starts[begin:]
            ends += own_ends[begin:]
            told = pa.Table.from_batches(heads).combine_chunks()
            open_head = told.slice(told.num_rows - 1).to_batches()[0]
            if found:
                yield _with_lists(told.slice(0, len(found)).to_batches()[0], found)
        if starts:
            yield _with_lists(open_head, [step(starts, ends)])

    spans = sliced.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*head, start, end)
    summary = _in_order(spans, head, [start, end]).mapInArrow(summarise, steps)
    chained = T.StructType([*[sliced.schema[k] for k in head], T.StructField("__in", T.LongType())])
    lowest = -(2**62)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = lowest
        for batch in batches:
            entering = []
            for first, limits, exits in zip(*(batch.column(c) for c in ("__first", "limits", "exits")), strict=True):
                state = lowest if first.as_py() else state
                entering.append(state)
                ordered = limits.values.to_numpy(zero_copy_only=False)
                k = int(np.searchsorted(ordered, state, side="right"))
                if k < len(ordered):
                    state = exits.values[k].as_py()
            heads = batch.select(head)
            yield pa.RecordBatch.from_arrays([*heads.columns, pa.array(entering, pa.int64())], [*head, "__in"])

    carried = _in_order(summary, list(keys), [SLICE]).mapInArrow(chain, chained)
    marked = T.StructType([*df.schema.fields, T.StructField(name, T.BooleanType())])
    columns = df.columns

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = lowest
        for batch in batches:
            kept = []
            for entering, s, e in zip(*(batch.column(c).to_pylist() for c in ("__in", start, end)), strict=True):
                if entering is not None:  # the row that opens a slice
                    state = entering
                take = entering is None and s is not None and e is not None and s > state
                kept.append(take)
                if take:
                    state = e
            rows = batch.select(columns)
            out = pa.RecordBatch.from_arrays([*rows.columns, pa.array(kept, pa.bool_())], [*columns, name])
            yield out.filter(batch.column("__in").is_null())

    both = sliced.withColumn("__in", F.lit(None).cast("long")).unionByName(carried, allowMissingColumns=True)
    ordered = both.repartition(*head).sortWithinPartitions(*head, F.col("__in").desc_nulls_last(), start, end, *ties)
    return ordered.mapInArrow(mark, marked)


def _with_lists(heads: pa.RecordBatch, found: list[tuple[list, list]]) -> pa.RecordBatch:
    lists = [pa.array([f[side] for f in found], pa.list_(pa.int64())) for side in (0, 1)]
    return pa.RecordBatch.from_arrays([*heads.columns, *lists], [*heads.schema.names, "limits", "exits"])


def _first_after(ordered: list, bound: int) -> int:
    """Index of the first element strictly greater than ``bound``."""
    return bisect_left(ordered, bound + 1)


def minimum_spacing(
    df: DataFrame, keys: Sequence[str], ts: str, gap: int, slices: Slices, ties: Sequence[str] = ()
) -> DataFrame:
    """Greedy sample: first row (of equal times by ``ties``), then each row at least ``gap`` after the last kept one."""
    spans = df.withColumn("__end", F.col(ts) + F.lit(gap - 1))
    return greedy_non_overlapping(spans, keys, ts, "__end", slices, ties=ties).where("selected").drop("__end", "selected")
