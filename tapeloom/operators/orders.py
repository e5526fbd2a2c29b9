"""Order-event analytics: fills to positions, dispositions, transitions, reconciliation, limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slices import Slices, last_before, ordered_scan, prev, run_sum

# Which event may follow a state, whatever is pending.
LEGAL_EDGES = (
    ("prepared", "SubmissionStarted"),
    ("prepared", "BrokerRejected"),
    ("submission_started", "BrokerAcknowledged"),
    ("submission_started", "BrokerRejected"),
    ("submission_started", "SubmissionAmbiguous"),
    ("acknowledged", "FillUpdate"),
    ("partially_filled", "FillUpdate"),
    ("filled", "FillUpdate"),
    ("ambiguous_submission", "ReconcileWorking"),
    ("ambiguous_submission", "ReconcileCancelled"),
    ("ambiguous_submission", "ReconcileRejected"),
    ("reconciliation_required", "ReconcileWorking"),
    ("reconciliation_required", "ReconcileCancelled"),
    ("reconciliation_required", "ReconcileRejected"),
    ("cancelled", "ReconcileCancelled"),
    ("rejected", "BrokerRejected"),
    ("rejected", "ReconcileRejected"),
)
# Events that need a pending change, or its absence, and events that end one.
NEED_NOTHING_PENDING = ("ModifyRequested", "CancelRequested")
NEED_MODIFY = ("ModifyAccepted", "ModifyRejected")
NEED_CANCEL = ("CancelAccepted", "CancelRejected")
END_PENDING = (*NEED_MODIFY, *NEED_CANCEL, "ReconcileWorking", "ReconcileCancelled", "ReconcileRejected")
WORKING = ("acknowledged", "partially_filled")


def reconcile(expected: DataFrame, observed: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keyed comparison: ``missing``, ``extra``, ``changed`` or ``equal`` per key."""
    left = expected.select(*keys, F.struct(*[F.col(v) for v in values]).alias("expected"))
    right = observed.select(*keys, F.struct(*[F.col(v) for v in values]).alias("observed"))
    status = (
        F.when(F.col("expected").isNull(), "extra")
        .when(F.col("observed").isNull(), "missing")
        .when(~F.col("expected").eqNullSafe(F.col("observed")), "changed")
        .otherwise("equal")
    )
    return left.join(right, list(keys), "full").withColumn("status", status)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def fills_to_positions(
    fills: DataFrame, order_key: str, instrument: str, seq: str, slices: Slices
) -> DataFrame:
    """Running signed position per instrument from cumulative fills (``cumulative``, ``side``)."""
    stepped = ordered_scan(fills, [order_key], [seq], slices, {"before": prev("cumulative")})
    fill = F.col("cumulative") - F.coalesce(F.col("before"), F.lit(0))
    signed = F.when(F.col("side") == "buy", fill).otherwise(-fill)
    return ordered_scan(
        stepped.withColumn("fill", fill).withColumn("signed", signed).drop("before"),
        [instrument],
        [seq],
        slices,
        {"position": run_sum("signed")},
    )


def latest_disposition(events: DataFrame, key: str, seq: str) -> DataFrame:
    """Final state per intent and whether it still needs reconciliation."""
    return events.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"),
        F.max_by("state", seq).alias("state"),
        F.max_by(F.col("state").isin("ambiguous_submission", "reconciliation_required"), seq).alias("needs_reconciliation"),
    )


def illegal_transitions(events: DataFrame, key: str, seq: str, state: str, event: str, slices: Slices) -> DataFrame:
    """Events that may not follow the state and the pending change that the earlier events left.

    Adds ``before`` (the state) and ``pending`` (none, modify or cancel). A change is pending from its
    request until it is accepted, rejected or reconciled, or the order is filled. A cancel may be confirmed
    again after the order has ended if one was ever requested. A key's first event has no ``before`` and is
    not judged.
    """
    kind = F.col(event)
    mark = F.when(kind == "ModifyRequested", "modify").when(kind == "CancelRequested", "cancel")
    mark = mark.when(kind.isin(*END_PENDING) | ((kind == "FillUpdate") & (F.col(state) == "filled")), "none")
    outs = {"before": prev(state), "pending": last_before(mark), "__asked": last_before(F.when(kind == "CancelRequested", True))}
    walked = ordered_scan(events, [key], [seq], slices, outs).where(F.col("before").isNotNull())
    walked = walked.withColumn("pending", F.coalesce("pending", F.lit("none")))
    before, pending = F.col("before"), F.col("pending")
    ended, asked = before.isin("filled", "cancelled"), F.coalesce("__asked", F.lit(False))
    legal = (
        F.concat_ws(" ", before, kind).isin(*[f"{a} {b}" for a, b in LEGAL_EDGES])
        | (kind.isin(*NEED_NOTHING_PENDING) & before.isin(*WORKING) & (pending == "none"))
        | (kind.isin(*NEED_MODIFY) & (pending == "modify"))
        | ((kind == "CancelAccepted") & F.when(ended, asked).otherwise(pending == "cancel"))
        | ((kind == "CancelRejected") & (pending == "cancel"))
        | ((kind == "SubmissionAmbiguous") & (pending != "none"))
    )
    return walked.where(~legal).drop("__asked")


def first_failing(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first failing rule in order; null when all pass."""
    out = F.lit(None).cast("string")
    for name, failing in reversed(list(rules)):
        out = F.when(failing, F.lit(name)).otherwise(out)
    return out
