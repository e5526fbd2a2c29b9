"""Dataset catalogue: fold lifecycle events to the latest state and match requests to datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.slices import Slices, nxt, ordered_scan, prev, row_no


def fold_events(events: DataFrame, slices: Slices) -> DataFrame:
    """Latest event per dataset with the first integrity problem of its history, if any.

    Checks: sequences run 1..n, the digest chain links, the first event registers the dataset and
    a terminal status never changes.
    """
    seen = ordered_scan(
        events,
        ["dataset_id"],
        ["event_sequence"],
        slices,
        {
            "position": row_no(),
            "previous": prev(F.struct("event_digest", "status")),
            "following": nxt(F.lit(True)),
        },
    )
    problem = (
        F.when(F.col("event_sequence") != F.col("position"), "non_contiguous_history")
        .when(
            ~F.coalesce(F.col("prior_event_digest"), F.lit("")).eqNullSafe(
                F.coalesce(F.col("previous.event_digest"), F.lit(""))
            ),
            "broken_digest_chain",
        )
        .when((F.col("position") == 1) & (F.col("event_type") != "dataset_registered"), "invalid_first_event")
        .when(
            F.col("previous.status").isNotNull()
            & (F.col("previous.status") != "active")
            & ((F.col("event_type") != "dataset_published") | (F.col("status") != F.col("previous.status"))),
            "terminal_status_changed",
        )
    )
    marked = seen.withColumn("problem", problem)
    return marked.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.max_by("status", "event_sequence").alias("status"),
        F.max_by("event_type", "event_sequence").alias("last_event"),
        F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("event_sequence"))).alias("problem"),
    )


def satisfies(channels: Column, instruments: Column, start: Column, end: Column) -> Column:
    """Whether a dataset row covers a request row (``req_*`` columns)."""
    single = (
        (F.size(channels) == 1)
        & (F.size(instruments) == 1)
        & (channels == F.col("req_channels"))
        & (instruments == F.col("req_instruments"))
    )
    return (
        (F.size(F.array_except(F.col("req_channels"), channels)) == 0)
        & (F.size(F.array_except(F.col("req_instruments"), instruments)) == 0)
        & (F.col("req_start").isNull() | (single & (start <= F.col("req_start"))))
        & (F.col("req_end").isNull() | (single & (end >= F.col("req_end"))))
    )


def resolve(requests: DataFrame, handles: DataFrame) -> DataFrame:
    """Best dataset per request: same trading date, usable status, newest completion first.

    Requests and datasets that look alike to the rule are folded first, so only distinct shapes of
    one trading date are compared.
    """
    shape = ["trading_date", "status", "channels", "instrument_ids", "coverage_start", "coverage_end"]
    usable = (
        handles.where(F.col("status").isin("active", "completed"))
        .groupBy(*shape)
        .agg(F.max(F.struct("completed_at", "dataset_id")).alias("newest"))
    )
    asked = ["trading_date", "req_channels", "req_instruments", "req_start", "req_end", "allow_active"]
    wanted = requests.select(*asked).distinct()
    pairs = wanted.join(usable, "trading_date").where(
        (F.col("status") == "completed") | F.col("allow_active")
    ).where(satisfies(F.col("channels"), F.col("instrument_ids"), F.col("coverage_start"), F.col("coverage_end")))
    best = pairs.groupBy(*asked).agg(F.max("newest").alias("newest"))
    same = None
    for c in asked:
        match = requests[c].eqNullSafe(best[c])
        same = match if same is None else same & match
    return requests.join(best, same, "left").select("request_id", F.col("newest.dataset_id").alias("dataset_id"))
