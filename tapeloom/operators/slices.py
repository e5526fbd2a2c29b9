"""Ordered computation without one-task-per-key windows.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts a whole key into one task, so one busy
instrument holding a third of the tape would stall the job. Everything ordered in this package is
therefore cut along the order axis as well:

* ``Slices`` cuts an ordered column into equal-depth ranges (equal values are never separated);
* ``ordered_scan`` runs the window inside (key, slice) and carries state over slice borders through
  a table with one row per (key, slice);
* ``sliding`` answers bounded range frames by copying only the border rows into the next slice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from math import isfinite
from typing import Literal

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SLICE = "__slice"
_GRID = 4096  # quantile cuts read back to the driver; longer tables cut evenly between them
NULL_SLICE = -1


def _finite(cuts: Sequence[float]) -> tuple[float, ...]:
    """Distinct finite cuts in their order; infinities and NaN lie beyond the last one or before the first."""
    return tuple(sorted({float(c) for c in cuts if isfinite(c)}))


@dataclass(frozen=True)
class Slices:
    """Monotone map from an ordered value to a slice number; nulls sort first and have a slice of their own."""

    cuts: tuple[float, ...]
    between: int = 1  #: equal steps of value between two neighbouring cuts

    @classmethod
    def plan(
        cls,
        df: DataFrame,
        column: str,
        *,
        rows_per_slice: int = 2_000_000,
        min_slices: int = 4,
    ) -> Slices:
        """Equal-depth cuts from one column-pruned pass; the driver receives at most 4,096 numbers.

        Where more slices are wanted, every range between two cuts is divided evenly, those below the first
        and above the last one too (the least and largest value are cuts then), so the number of slices has
        no upper bound while the plan stays small. Any cuts give right results (the map only has to be
        monotone), so a plan made on one snapshot of a table stays valid for later ones.
        """
        grid = ",".join(str(i / _GRID) for i in range(1, _GRID))
        row = df.agg(
            F.count(column).alias("n"),
            # A literal list spelled as text: thousands of separate literals are slow to build.
            F.expr(f"percentile_approx({column}, cast(split('{grid}', ',') as array<double>), {2 * _GRID})").alias("cuts"),
            F.min(column).alias("low"),
            F.max(column).alias("high"),
        ).first()
        if row is None or not row["n"]:
            return cls(())
        wanted = max(min_slices, -(-int(row["n"]) // rows_per_slice))
        step = max(1, _GRID // min(wanted, _GRID))
        picked = row["cuts"][step - 1 :: step]
        if wanted <= _GRID:
            return cls(_finite(picked))
        cuts = _finite((*picked, row["low"], row["high"]))
        return cls(cuts, -(-wanted // max(1, len(cuts) - 1)))

    def of(self, value: Column | str) -> Column:
        """Slice number of ``value``: how many cuts are at or below it."""
        v = (F.col(value) if isinstance(value, str) else value).cast("double")
        n = len(self.cuts)
        if n == 0:
            return F.when(v.isNull(), NULL_SLICE).otherwise(0)
        if n <= 24 and self.between == 1:  # the same number, as plain comparisons that compile well
            found = sum(((v >= F.lit(cut)).cast("int") for cut in self.cuts), F.lit(0))
            return F.when(v.isNull(), NULL_SLICE).otherwise(found)
        cuts = F.from_json(F.lit("[" + ",".join(repr(c) for c in self.cuts) + "]"), "array<double>")
        steps = [1 << k for k in reversed(range(n.bit_length()))]
        found = F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda pos, s: F.when((pos + s <= n) & (F.get(cuts, pos + s - 1) <= v), pos + s).otherwise(pos),
        )
        if self.between > 1:
            low, high = F.get(cuts, found - 1), F.get(cuts, found)
            part = F.floor((v - low) / (high - low) * self.between)
            inside = F.coalesce(F.greatest(F.lit(0), F.least(part, F.lit(self.between - 1))), F.lit(0))
            found = (found * self.between + inside).cast("int")
        return F.when(v.isNull(), NULL_SLICE).otherwise(found)


@dataclass(frozen=True)
class Scan:
    """One output of ``ordered_scan``; build with the helper functions below."""

    kind: Literal[
        "prev", "next", "last", "last_before", "first_from", "first_after",
        "run_sum", "run_max", "run_max_before", "run_min", "total", "row",
    ]
    value: Column | None = None


def prev(value: Column | str) -> Scan:
    """Value on the row just before (null on the first row)."""
    return Scan("prev", _c(value))


def nxt(value: Column | str) -> Scan:
    """Value on the row just after."""
    return Scan("next", _c(value))


def last(value: Column | str) -> Scan:
    """Latest non-null value at or before this row."""
    return Scan("last", _c(value))


def last_before(value: Column | str) -> Scan:
    """Latest non-null value strictly before this row."""
    return Scan("last_before", _c(value))


def first_from(value: Column | str) -> Scan:
    """Earliest non-null value at or after this row."""
    return Scan("first_from", _c(value))


def first_after(value: Column | str) -> Scan:
    """Earliest non-null value strictly after this row."""
    return Scan("first_after", _c(value))


def run_sum(value: Column | str) -> Scan:
    """Sum from the first row to this one."""
    return Scan("run_sum", _c(value))


def run_max(value: Column | str) -> Scan:
    return Scan("run_max", _c(value))


def run_max_before(value: Column | str) -> Scan:
    """Largest value strictly before this row."""
    return Scan("run_max_before", _c(value))


def run_min(value: Column | str) -> Scan:
    return Scan("run_min", _c(value))


def total(value: Column | str) -> Scan:
    """Sum over the whole key."""
    return Scan("total", _c(value))


def row_no() -> Scan:
    """1-based position inside the key."""
    return Scan("row", F.lit(1).cast("long"))


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    slices: Slices,
    outs: Mapping[str, Scan],
) -> DataFrame:
    """Whole-key ordered outputs computed slice by slice.

    ``order_by[0]`` is the sliced column; the full ``order_by`` must be unique within a key.
    Key columns must be non-null (the tape contract requires them).
    """
    sliced = df.withColumn(SLICE, slices.of(order_by[0]))
    group = [*keys, SLICE]
    w = Window.partitionBy(*group).orderBy(*order_by)
    past, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    # What lies ahead is read on the reversed order: a frame that only ends at the last row is
    # aggregated anew for every row, so its cost would grow with the square of the slice.
    wr = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order_by])
    ahead, after = wr.rowsBetween(Window.unboundedPreceding, 0), wr.rowsBetween(Window.unboundedPreceding, -1)
    wk = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE)
    k_before = wk.rowsBetween(Window.unboundedPreceding, -1)
    k_after = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    k_all = Window.partitionBy(*(keys or [F.lit(0)]))
    order = F.struct(*[F.col(c) for c in order_by])

    staged = sliced.select("*", *[s.value.alias(f"__v_{n}") for n, s in outs.items()])
    local, summary, carry, final = [], [], [], []
    for name, scan in outs.items():
        v, l, c = F.col(f"__v_{name}"), f"__l_{name}", f"__c_{name}"
        kind = scan.kind
        if kind == "prev":
            local.append(F.lag(F.struct(v.alias("v"))).over(w).alias(l))
            summary.append(F.max_by(F.struct(v.alias("v")), order).alias(c))
            carry.append(F.lag(c).over(wk).alias(c))
            final.append(F.coalesce(F.col(l), F.col(c))["v"].alias(name))
        elif kind == "next":
            local.append(F.lead(F.struct(v.alias("v"))).over(w).alias(l))
            summary.append(F.min_by(F.struct(v.alias("v")), order).alias(c))
            carry.append(F.lead(c).over(wk).alias(c))
            final.append(F.coalesce(F.col(l), F.col(c))["v"].alias(name))
        elif kind in ("last", "last_before"):
            frame = past if kind == "last" else before
            local.append(F.last(v, ignorenulls=True).over(frame).alias(l))
            summary.append(F.max_by(v, F.when(v.isNotNull(), order)).alias(c))
            carry.append(F.last(c, ignorenulls=True).over(k_before).alias(c))
            final.append(F.coalesce(F.col(l), F.col(c)).alias(name))
        elif kind in ("first_from", "first_after"):
            frame = ahead if kind == "first_from" else after
            local.append(F.last(v, ignorenulls=True).over(frame).alias(l))
            summary.append(F.min_by(v, F.when(v.isNotNull(), order)).alias(c))
            carry.append(F.last(c, ignorenulls=True).over(k_after).alias(c))
            final.append(F.coalesce(F.col(l), F.col(c)).alias(name))
        elif kind in ("run_sum", "row"):
            local.append(F.coalesce(F.sum(v).over(past), F.lit(0)).alias(l))
            summary.append(F.sum(v).alias(c))
            carry.append(F.coalesce(F.sum(c).over(k_before), F.lit(0)).alias(c))
            final.append((F.col(l) + F.col(c)).alias(name))
        elif kind == "total":
            local.append(F.lit(None).alias(l))
            summary.append(F.sum(v).alias(c))
            carry.append(F.sum(c).over(k_all).alias(c))
            final.append(F.col(c).alias(name))
        else:
            agg = F.min if kind == "run_min" else F.max
            pick = F.least if kind == "run_min" else F.greatest
            frame = before if kind == "run_max_before" else past
            local.append(agg(v).over(frame).alias(l))
            summary.append(agg(v).alias(c))
            carry.append(agg(c).over(k_before).alias(c))
            final.append(pick(F.col(l), F.col(c)).alias(name))

    borders = staged.groupBy(*group).agg(*summary).select(*group, *carry)
    columns = [F.col(c) for c in df.columns if c not in outs]
    return staged.select("*", *local).join(borders, group, "left").select(*columns, *final)


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    slices: Slices,
    outs: Mapping[str, Callable[[Callable[[int, int], WindowSpec]], Column]],
    *,
    back: int = 0,
    ahead: int = 0,
) -> DataFrame:
    """Range-frame outputs over ``[ts-back, ts+ahead]`` on an integer order column.

    ``outs`` maps a name to a function of ``frame(lo, hi)``. Rows near a slice border are copied
    to the slices whose frames can see them and dropped again after the window.
    """
    own = slices.of(ts)
    low = slices.of(F.col(ts) - F.lit(ahead))
    high = slices.of(F.col(ts) + F.lit(back))
    copies = df.withColumn("__own", own).withColumn(SLICE, F.explode(F.sequence(low, high)))

    def frame(lo: int, hi: int) -> WindowSpec:
        return Window.partitionBy(*keys, SLICE).orderBy(ts).rangeBetween(lo, hi)

    columns = [F.col(c) for c in df.columns if c not in outs]
    made = copies.select("*", *[make(frame).alias(f"__o_{n}") for n, make in outs.items()])
    return made.where(F.col("__own") == F.col(SLICE)).select(
        *columns, *[F.col(f"__o_{n}").alias(n) for n in outs]
    )
