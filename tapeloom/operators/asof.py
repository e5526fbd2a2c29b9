"""As-of joins: latest value at or before (or first at or after) a time, per key.

Both sides are unioned on one time axis and resolved with ``ordered_scan``, so the work is one
shuffle on (key, time slice) and never a key-to-key pairing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slices import Slices, first_after, first_from, last, last_before, ordered_scan


def _axis(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    right_ties: Sequence[str],
    payload: Sequence[str],
    left_first: bool,
) -> DataFrame:
    """One time axis holding both sides; at equal times ``left_first`` decides who comes first."""
    left_columns = F.struct(*[F.col(c) for c in left.columns])
    body = F.struct(*[F.col(c) for c in payload])
    tie = F.struct(*[F.col(c) for c in right_ties]) if right_ties else F.struct(F.lit(0).alias("t"))
    right_rows = right.select(
        *keys,
        F.col(right_ts).cast("long").alias("__t"),
        F.lit(1 if left_first else 0).alias("__side"),
        tie.alias("__tie"),
        body.alias("__r"),
    )
    tie_type = right_rows.schema["__tie"].dataType
    body_type = right_rows.schema["__r"].dataType
    left_type = left.select(left_columns.alias("l")).schema["l"].dataType
    left_rows = left.select(
        *keys,
        F.col(left_ts).cast("long").alias("__t"),
        F.lit(0 if left_first else 1).alias("__side"),
        F.lit(None).cast(tie_type).alias("__tie"),
        F.lit(None).cast(body_type).alias("__r"),
        left_columns.alias("__l"),
    )
    return left_rows.unionByName(right_rows.withColumn("__l", F.lit(None).cast(left_type)))


def asof(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    slices: Slices,
    right_ties: Sequence[str] = (),
    direction: str = "backward",
    strict: bool = False,
    prefix: str = "m_",
    covered: bool = False,
) -> DataFrame:
    """Left rows plus the matched right ``values`` (prefixed; null when nothing matches).

    ``covered=True`` also refuses a left time outside the key's right-side span: the right edge is
    a refusal, not a silent reuse of the final value.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is backward or forward")
    backward = direction == "backward"
    axis = _axis(left, right, keys, left_ts, right_ts, right_ties, values, left_first=strict == backward)
    pick = last("__r") if backward else first_from("__r")
    outs = {"__hit": pick}
    if covered:
        outs["__far"] = first_from("__seen") if backward else last("__seen")
        outs["__at"] = last("__seen")
        axis = axis.withColumn("__seen", F.when(F.col("__r").isNotNull(), F.col("__t")))
    found = ordered_scan(axis, keys, ["__t", "__side", "__tie"], slices, outs).where(
        F.col("__l").isNotNull()
    )
    hit = F.col("__hit")
    if covered:
        inside = F.col("__far").isNotNull()
        if backward:
            inside = inside | (F.col("__at") == F.col("__t"))
        hit = F.when(inside, hit)
    return found.select(
        "__l.*", *[hit[c].alias(f"{prefix}{c}") for c in values]
    )


def asof_offsets(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str],
    id_cols: Sequence[str],
    left_ts: str,
    offsets: Mapping[str, int],
    right_ts: str,
    values: Sequence[str],
    slices: Slices,
    right_ties: Sequence[str] = (),
    strict: Sequence[str] = (),
    forward: Sequence[str] = (),
    covered: bool = True,
) -> DataFrame:
    """Several as-of lookups per left row (``left_ts + offset``) in one scan.

    Returns ``id_cols`` plus ``<offset>_<value>`` columns. Offsets named in ``strict`` use the last
    value strictly before the instant, those in ``forward`` the first value at or after it.
    """
    asked = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(d).cast("long").alias("shift")) for n, d in offsets.items()]
    )
    probes = (
        left.select(*dict.fromkeys([*keys, *id_cols]), F.col(left_ts).alias("__anchor"))
        .withColumn("__ask", F.explode(asked))
        .withColumn("__when", F.col("__anchor") + F.col("__ask.shift"))
        # A strict lookup is the lookup one unit of time earlier on an integer axis.
        .withColumn(
            "__when",
            F.when(F.col("__ask.name").isin(*strict), F.col("__when") - 1).otherwise(F.col("__when"))
            if strict
            else F.col("__when"),
        )
    )
    axis = _axis(probes, right, keys, "__when", right_ts, right_ties, values, left_first=False)
    seen = F.when(F.col("__r").isNotNull(), F.col("__t"))
    outs = {"__hit": last("__r"), "__far": first_from(seen), "__at": last(seen)}
    if forward:
        outs["__fwd"] = first_after("__r")
    found = ordered_scan(axis, keys, ["__t", "__side", "__tie"], slices, outs).where(
        F.col("__l").isNotNull()
    )
    inside = (F.col("__far").isNotNull() | (F.col("__at") == F.col("__t"))) if covered else F.lit(True)
    answer: Column = F.when(inside, F.col("__hit"))
    if forward:
        # At or after: a right row exactly at the instant sorts before the probe, so it is __hit.
        at_or_after = F.when(F.col("__at") == F.col("__t"), F.col("__hit")).otherwise(F.col("__fwd"))
        answer = F.when(F.col("__l.__ask.name").isin(*forward), at_or_after).otherwise(answer)
    flat = found.select("__l.*", answer.alias("__v"))
    cells = [
        F.max(F.when(F.col("__ask.name") == name, F.col("__v"))).alias(f"__c_{name}")
        for name in offsets
    ]
    ids = list(dict.fromkeys([*keys, *id_cols]))
    return flat.groupBy(*ids).agg(*cells).select(
        *ids,
        *[F.col(f"__c_{n}")[v].alias(f"{n}_{v}") for n in offsets for v in values],
    )


__all__ = ["asof", "asof_offsets", "last_before"]
