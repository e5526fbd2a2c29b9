"""Response families of events: every cell by gap and horizon, in several arms, with step-down p-values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .asof import asof_offsets
from .inference import newey_west_mean, step_down_max_t
from .recurrence import greedy_non_overlapping
from .resampling import stationary_bootstrap_means
from .slices import Slices

ALL, EPISODES, MATCHED = "all_events", "episodes", "event_minus_control"


def timed_responses(
    events: DataFrame, prices: DataFrame, keys: Sequence[str], event_id: str, ts: str, price_ts: str, price_tie: str, value: str,
    gaps: Sequence[int], horizons: Sequence[int], slices: Slices,
) -> DataFrame:
    """(keys, event_id, ts, gap, horizon, response): how far the value moves from gap to gap + horizon after each event.

    The value at an instant is the last one at or before it; an instant beyond the key's last price has
    none, and such cells have no row. All instants of an event are one as-of scan.
    """
    shifts = sorted({g for g in gaps} | {g + h for g in gaps for h in horizons})
    found = asof_offsets(
        events.select(*keys, event_id, ts), prices, keys=keys, id_cols=[event_id, ts], left_ts=ts, offsets={f"o{s}": s for s in shifts},
        right_ts=price_ts, values=[value], slices=slices, right_ties=[price_tie],
    )
    cells = [
        F.struct(F.lit(g).cast("long").alias("gap"), F.lit(h).cast("long").alias("horizon"), (F.col(f"o{g + h}_{value}") - F.col(f"o{g}_{value}")).alias("response"))
        for g in gaps for h in horizons
    ]
    return found.select(*keys, event_id, ts, F.inline(F.array(*cells))).where("response IS NOT NULL")


def matched_differences(responses: DataFrame, pairs: DataFrame, event_id: str, control_id: str, controls: DataFrame) -> DataFrame:
    """``responses`` of events less those of their controls, cell by cell; ``pairs(event_id, control_id)``. Events
    without a control, or whose control has no response in the cell, have no row."""
    own = controls.select(F.col(event_id).alias(control_id), "gap", "horizon", F.col("response").alias("__control"))
    both = responses.join(pairs, event_id).join(own, [control_id, "gap", "horizon"])
    return both.withColumn("response", F.col("response") - F.col("__control")).drop("__control", control_id)


def response_family(
    responses: DataFrame, keys: Sequence[str], cell: Sequence[str], session: str, event_id: str, ts: str, slices: Slices,
    *, lag: int, differences: DataFrame | None = None, replicates: int = 40, mean_length: float = 5.0, seed: int = 23,
) -> DataFrame:
    """(arm, cell, gap, horizon, n, mean, standard_error, t_statistic, low, high, rank, adjusted_p) of every cell.

    Arms stand side by side and none replaces another: all events with a Newey-West error; non-overlapping
    episodes (greedy by each cell's own gap + horizon within a key, the first event counts); event minus
    matched control. Step-down p-values over an arm's cells come from stationary bootstrap means around the
    observed ones, by the observed errors, so a replicate costs runs and no rows. ``responses`` carry the cell
    columns and the session; a cell without a usable error counts as t = 0.
    """
    group = [*cell, "gap", "horizon"]
    spans = responses.withColumn("__end", F.col(ts) + F.col("gap") + F.col("horizon"))
    first = greedy_non_overlapping(spans, [*keys, *group], ts, "__end", slices, ties=[event_id]).where("selected").drop("__end", "selected")
    arms = [responses.withColumn("arm", F.lit(ALL)), first.withColumn("arm", F.lit(EPISODES))]
    if differences is not None:
        arms.append(differences.withColumn("arm", F.lit(MATCHED)))
    columns = ["arm", *group, session, event_id, ts, "response"]
    rows = arms[0].select(*columns)
    for arm in arms[1:]:
        rows = rows.unionByName(arm.select(*columns))
    rows = cut_lineage(rows)
    found = newey_west_mean(rows, ["arm", *group], [ts, event_id], "response", lag, slices)
    found = cut_lineage(found.select("arm", *group, "n", "mean", "standard_error", "t_statistic"))
    cell_id = F.concat_ws("|", *[F.col(c).cast("string") for c in group])
    means = stationary_bootstrap_means(rows, ["arm", *group], [session], [ts, event_id], "response", slices, replicates=replicates, mean_length=mean_length, seed=seed)
    drawn = means.withColumnRenamed("mean", "__m").join(found.select("arm", *group, "mean", "standard_error"), ["arm", *group])
    t = F.coalesce(F.when(F.col("standard_error") > 0, (F.col("__m") - F.col("mean")) / F.col("standard_error")), F.lit(0.0))
    drawn = cut_lineage(drawn.select("arm", "replicate", cell_id.alias("__cell"), t.alias("__t")))
    out = None
    for name in (ALL, EPISODES, *((MATCHED,) if differences is not None else ())):
        own = found.where(F.col("arm") == name).select("arm", *group, "n", "mean", "standard_error", "t_statistic", cell_id.alias("__cell"))
        observed = own.select("__cell", F.coalesce("t_statistic", F.lit(0.0)).alias("__t"))
        down = step_down_max_t(observed, drawn.where(F.col("arm") == name).drop("arm"), "__cell", "__t", "replicate")
        part = own.join(down, "__cell").drop("__cell")
        out = part if out is None else out.unionByName(part)
    half = 1.959963984540054 * F.col("standard_error")
    return out.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)
