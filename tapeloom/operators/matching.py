"""Nearest-neighbour matching inside exact strata, and relocation pairing inside one ladder."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .flow import boundary_churn
from .slices import SLICE, Slices


def nearest_control(
    events: DataFrame,
    controls: DataFrame,
    strata: Sequence[str],
    covariates: Sequence[str],
    event_id: str,
    control_id: str,
    quiet: str | None = None,
    slices: Slices | None = None,
) -> DataFrame:
    """For each event the quiet control of its stratum with the least squared scaled distance, ties by id.

    A covariate's scale is its range over the stratum's quiet controls and the event itself, or 1 if that
    is 0. Every event has a row: where none can be matched ``reason`` says whether the stratum has no
    controls or no quiet ones (``quiet`` names the flag; without it every control is quiet).

    Controls are cut into slices of the first covariate. An event first asks its own slice (or the next one
    that holds controls of its stratum); the distance found there bounds its reach on that covariate, and only
    other slices within that reach are asked too. No control is dropped and no pair table is built.
    """
    covariates, first = list(covariates), covariates[0]
    calm = F.lit(True) if quiet is None else F.coalesce(F.col(quiet), F.lit(False))
    low_high = [f(F.when(calm, F.col(c))).alias(f"{n}_{c}") for c in covariates for n, f in (("lo", F.min), ("hi", F.max))]
    ranges = controls.groupBy(*strata).agg(F.count(F.when(calm, 1)).alias("__quiet"), *low_high)
    micro = 1_000_000_000  # first covariate over its control range as an integer axis
    width = F.col(f"hi_{first}") - F.col(f"lo_{first}")
    axis = F.when(width > 0, F.round((F.col(first) - F.col(f"lo_{first}")) / width * micro)).otherwise(0).cast("long")
    asked = events.select(*strata, event_id, *covariates).join(ranges, list(strata), "left")
    reason = F.when(F.col("__quiet").isNull(), "no_same_stratum_candidates").when(F.col("__quiet") == 0, "no_quiet_same_stratum_candidates")
    everyone = asked.select(*strata, event_id, reason.alias("reason"))

    def scale(c: str):
        span = F.greatest(F.col(f"hi_{c}"), F.col(c)) - F.least(F.col(f"lo_{c}"), F.col(c))
        return F.when(span > 0, span).otherwise(1.0)

    scales = [f"s_{c}" for c in covariates]
    left = asked.where(F.col("__quiet") > 0).dropna(subset=covariates).select(
        *strata, event_id, *covariates, axis.alias("axis"), *[scale(c).alias(n) for c, n in zip(covariates, scales, strict=True)],
        F.when(width > 0, scale(first) / width).otherwise(0.0).alias("__stretch"), F.lit(float("inf")).alias("__cap"),
    )
    right = controls.where(calm).dropna(subset=covariates).join(ranges, list(strata)).select(*strata, control_id, *covariates, axis.alias("axis"))
    if slices is None:
        slices = Slices.plan(right, "axis", rows_per_slice=200_000)
    # Columns of their own: events and controls may come from one table, which a cogroup would take for ambiguous.
    homes = right.select(*[F.col(c).alias(c) for c in (*strata, control_id, *covariates)], slices.of("axis").alias(SLICE))
    left = left.withColumn("__own", slices.of("axis"))

    # One row per stratum and slice: the slice itself if it holds controls, or the next one that does.
    spots = left.select(*strata, F.col("__own").alias(SLICE), F.lit(None).cast("int").alias("__filled")).unionByName(
        homes.select(*strata, SLICE, F.col(SLICE).alias("__filled"))
    ).groupBy(*strata, SLICE).agg(F.max("__filled").alias("__filled"))
    up, down = (Window.partitionBy(*(strata or [F.lit(0)])).orderBy(o) for o in (F.col(SLICE), F.col(SLICE).desc()))
    near = F.coalesce(F.last("__filled", ignorenulls=True).over(up), F.last("__filled", ignorenulls=True).over(down))
    nearest = spots.select(*strata, F.col(SLICE).alias("__own"), near.alias(SLICE)).where(F.col(SLICE).isNotNull())

    asking = left.join(nearest, [*strata, "__own"]).drop("__own")
    added = T.StructType([T.StructField(control_id, homes.schema[control_id].dataType), T.StructField("distance", T.DoubleType())])

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found, distance = _nearest(
            a[covariates].to_numpy(dtype=float), a[scales].to_numpy(dtype=float), a["__cap"].to_numpy(dtype=float), b, covariates, control_id
        )
        hit = np.flatnonzero(found >= 0)
        out = a.iloc[hit].copy()
        out[control_id], out["distance"] = b[control_id].to_numpy()[found[hit]], distance[hit]
        return out

    def ask(who: DataFrame) -> DataFrame:
        schema = T.StructType([*who.schema.fields, *added.fields])
        names, keys = schema.fieldNames(), [*strata, SLICE]

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(columns=names) if a.empty or b.empty else search(a, b)[names]

        return who.groupBy(*keys).cogroup(homes.groupBy(*keys)).applyInPandas(run, schema)

    at_home = cut_lineage(ask(asking))
    # A little slack covers the rounding of the axis.
    reach = F.ceil((F.sqrt("distance") * F.col("__stretch") + 1e-8) * micro) + 1
    visits = at_home.select(
        *strata, event_id, *covariates, "axis", *scales, "__stretch", F.col("distance").alias("__cap"), F.col(SLICE).alias("__home"),
        F.explode(F.sequence(slices.of(F.col("axis") - reach), slices.of(F.col("axis") + reach))).alias(SLICE),
    ).where(F.col(SLICE) != F.col("__home")).drop("__home")
    answers = [*strata, event_id, control_id, "distance"]
    found = at_home.select(*answers).unionByName(ask(visits).select(*answers)).unionByName(everyone, allowMissingColumns=True)
    rank = F.when(F.col("distance").isNotNull(), F.struct("distance", control_id))
    return found.groupBy(*strata, event_id).agg(
        F.min_by(control_id, rank).alias(control_id), F.min("distance").alias("distance"), F.max("reason").alias("reason")
    )


def _nearest(
    asking: np.ndarray, by: np.ndarray, cap: np.ndarray, pool: pd.DataFrame, covariates: Sequence[str], tie: str
) -> tuple[np.ndarray, np.ndarray]:
    """Row of ``pool`` with the least squared distance to each asking row (ties by ``tie``) and that distance; -1
    where none lies within ``cap``. Both sides are ordered on the covariate that spreads most, and a row is
    compared with what lies within its bound there, which its neighbours in that order give."""
    ranked = pool[[tie, *covariates]].reset_index(drop=True).sort_values(tie)
    ranked = ranked.drop_duplicates(covariates)  # of equal controls the first wins
    points, places = ranked[list(covariates)].to_numpy(dtype=float), ranked.index.to_numpy()
    widest = int(np.argmax(np.ptp(points, axis=0) / by.mean(axis=0)))
    order = np.argsort(points[:, widest], kind="stable")
    points, line = points[order], points[order, widest]  # ``order`` is the rank by ``tie``
    best, at = np.full(len(asking), np.inf), np.full(len(asking), -1, dtype=np.int64)
    turn = np.argsort(asking[:, widest], kind="stable")
    near = np.arange(-32, 32)

    def distances(rows: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        terms = (((asking[rows, j, None] - candidates[..., j]) / by[rows, j, None]) ** 2 for j in range(points.shape[1]))
        return sum(terms, 0.0)

    for start in range(0, len(turn), 256):
        rows = turn[start : start + 256]
        x = asking[rows, widest]
        beside = np.clip(np.searchsorted(line, x)[:, None] + near, 0, len(line) - 1)
        bound = np.minimum(distances(rows, points[beside]).min(axis=1), cap[rows])
        reach = np.sqrt(bound) * by[rows, widest] * (1 + 1e-9) + 1e-12 * (1 + np.abs(x))
        low, high = np.searchsorted(line, x - reach).min(), np.searchsorted(line, x + reach, side="right").max()
        for piece in range(low, high, 16_384):  # keeps a block of distances near 32 MB
            part = slice(piece, min(piece + 16_384, high))
            d = distances(rows, points[None, part])
            least = d.min(axis=1)
            first = np.where(d == least[:, None], order[part][None, :], len(order)).min(axis=1)
            better = (least <= cap[rows]) & ((least < best[rows]) | ((least == best[rows]) & (first < at[rows])))
            best[rows[better]], at[rows[better]] = least[better], first[better]
    return np.where(at >= 0, places[at], -1), best


def relocations(moves: DataFrame, id_cols: Sequence[str], side: str, far: float, tolerance: float = 0.25, overlap: float = 0.9) -> DataFrame:
    """Pair far removed prices with far added prices of similar size, least difference first.

    Where the visible window slid (``boundary_churn``), all prices that went and came are the slide's, as in
    ``atomic_events``, so that transition has no pairs on this side.
    Each transition is one row with two ladders of bounded length; pairing it is a row-local step.
    """
    sign = 1.0 if side == "bids" else -1.0
    source = moves.select(*id_cols, F.col(f"p.{side}").alias("old"), F.col(side).alias("new"), boundary_churn(side, overlap).alias("churn"))
    schema = T.StructType(
        [
            *[source.schema[c] for c in id_cols],
            T.StructField("side", T.StringType()),
            T.StructField("source_price", T.DoubleType()),
            T.StructField("price", T.DoubleType()),
            T.StructField("direction", T.StringType()),
            T.StructField("magnitude", T.DoubleType()),
        ]
    )
    heads = list(id_cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                if row["churn"]:
                    continue
                old = {x["price"]: x["quantity"] for x in row["old"]}
                new = {x["price"]: x["quantity"] for x in row["new"]}
                top = row["old"][0]["price"]
                gone = [p for p in old if p not in new and (top - p) * sign > far and old[p] > 0]
                come = [p for p in new if p not in old and (top - p) * sign > far and new[p] > 0]
                options = sorted(
                    (abs(new[b] - old[a]) / max(old[a], new[b]), a, b) for a in gone for b in come
                )
                used_a, used_b = set(), set()
                for diff, a, b in options:
                    da, db = (top - a) * sign, (top - b) * sign
                    if diff > tolerance or a in used_a or b in used_b or da == db:
                        continue
                    used_a.add(a)
                    used_b.add(b)
                    rows.append({**{h: row[h] for h in heads}, "side": side[:-1], "source_price": a, "price": b, "direction": "toward" if db < da else "away", "magnitude": float(min(old[a], new[b]))})
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    return source.mapInPandas(run, schema)
