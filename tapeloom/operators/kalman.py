"""Time-varying regression coefficients by a Kalman filter, slice by slice.

The covariance follows P -> (A P + B)(C P + D)^-1 at every step and the coefficients an affine map once P is
known, so a slice is a product of small matrices whatever state comes into it. Slices are summarised, the
summaries chained per key, and the true incoming state handed back; no task holds more than one slice.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .slices import SLICE, Slices, first_from, ordered_scan

_DECAY, _UPDATE, _PREDICT = 0, 1, 2
_ORDER = ["__ts", "__tie", "__kind", "__own_ts", "__own_tie"]


def _events(df: DataFrame, keys: Sequence[str], ts: str, tie: str, x: str, y: str, matured: str, slices: Slices) -> DataFrame:
    """Three events for each row: its decay and its prediction at its own place, and its update at the first row
    at or after the instant its label is known (never at its own row)."""
    rows = df.select(*keys, F.col(ts).alias("__own_ts"), F.col(tie).alias("__own_tie"), F.col(x).alias("__x"), F.col(y).alias("__y"), F.when(F.col(matured).isNotNull(), F.greatest(F.col(matured), F.col(ts) + 1)).alias("__known"))
    places = rows.select(*keys, F.col("__own_ts").alias("__at"), F.lit(1).alias("__side"), "__own_ts", "__own_tie", "__x", "__y", F.struct("__own_ts", "__own_tie").alias("__place"))
    usable = F.col("__y").isNotNull() & F.col("__known").isNotNull() & F.col("__x").isNotNull() & F.forall("__x", lambda v: v.isNotNull())
    labels = rows.where(usable).select(*keys, F.col("__known").alias("__at"), F.lit(0).alias("__side"), "__own_ts", "__own_tie", "__x", "__y", F.lit(None).cast(places.schema["__place"].dataType).alias("__place"))
    both = ordered_scan(places.unionByName(labels), keys, ["__at", "__side", "__own_tie", "__own_ts"], slices, {"__first": first_from("__place")})
    shared = ["__own_ts", "__own_tie", "__x", "__y"]
    updates = both.where("__side = 0 AND __first IS NOT NULL").select(*keys, F.col("__first.__own_ts").alias("__ts"), F.col("__first.__own_tie").alias("__tie"), F.lit(_UPDATE).alias("__kind"), *shared)
    own = rows.select(*keys, F.col("__own_ts").alias("__ts"), F.col("__own_tie").alias("__tie"), F.explode(F.array(F.lit(_DECAY), F.lit(_PREDICT))).alias("__kind"), *shared)
    return own.unionByName(updates).withColumn(SLICE, slices.of("__ts"))


def kalman_path(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, x: str, y: str, matured: str, slices: Slices,
    *, width: int, rho: float, q: float, observation_variance: float = 1.0, initial: Sequence[float] | None = None, name: str = "prediction",
) -> DataFrame:
    """``df`` with the prediction x'b of each row, b following all labels known by then.

    At every row b decays by ``rho`` and its covariance (identity at first) becomes rho^2 P + q I; then the rows
    whose ``matured`` instant has come update both, each once and in order; then the row is predicted.
    ``x`` is an array of ``width`` numbers, scaled on training rows by the caller, ``y`` the target or what a
    baseline leaves of it. Rows without x, y or instant do not update; without x they have no prediction.
    ``ts`` must be whole numbers and (``ts``, ``tie``) unique in a key.
    """
    if not 0 < rho <= 1 or q < 0 or observation_variance <= 0:
        raise ValueError("rho in (0, 1], q from 0, a positive observation variance")
    p, first = width, np.zeros(width) if initial is None else np.asarray(initial, dtype=float)
    events = cut_lineage(_events(df, keys, ts, tie, x, y, matured, slices))
    head = [*keys, SLICE]
    heads = [events.schema[k] for k in head]
    decay = np.block([[rho * np.eye(p), q / rho * np.eye(p)], [np.zeros((p, p)), np.eye(p) / rho]])

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        """The map of the covariance over one slice."""
        pdf = pdf.sort_values(_ORDER, kind="stable")
        out = np.eye(2 * p)
        for kind, row in zip(pdf["__kind"].tolist(), pdf["__x"], strict=True):
            if kind == _DECAY:
                out = decay @ out
            elif kind == _UPDATE:
                v = np.asarray(row, dtype=float)
                out[p:] += np.outer(v, v) / observation_variance @ out[:p]
            else:
                continue
            out /= np.abs(out).max()
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in head}, "map": out.ravel().tolist()}])

    numbers = T.ArrayType(T.DoubleType())
    maps = events.groupBy(*head).applyInPandas(product, T.StructType([*heads, T.StructField("map", numbers)]))

    def chain_covariance(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, entering = pdf.sort_values(SLICE), np.eye(p), []
        for flat in pdf["map"]:
            entering.append(state.ravel().tolist())
            m = np.asarray(flat, dtype=float).reshape(2 * p, 2 * p)
            state = np.linalg.solve((m[p:, :p] @ state + m[p:, p:]).T, (m[:p, :p] @ state + m[:p, p:]).T).T
            state = (state + state.T) / 2
        return pdf[head].assign(__p=entering)

    entering = maps.groupBy(*keys).applyInPandas(chain_covariance, T.StructType([*heads, T.StructField("__p", numbers)]))

    made = [T.StructField("__gain", numbers), T.StructField("__own", T.DoubleType()), T.StructField("__a", numbers), T.StructField("__b", numbers)]
    placed = [events.schema[c] for c in ("__ts", "__tie")]

    def affine(pdf: pd.DataFrame) -> pd.DataFrame:
        """Predictions as gain' b_in + own, and the map of b over the slice on its last row."""
        pdf = pdf.sort_values(_ORDER, kind="stable")
        cov, a, b, out = np.asarray(pdf["__p"].iloc[0], dtype=float).reshape(p, p), np.eye(p), np.zeros(p), []
        for kind, at, order, row, target in zip(pdf["__kind"].tolist(), pdf["__ts"], pdf["__tie"], pdf["__x"], pdf["__y"], strict=True):
            if kind == _DECAY:
                a, b, cov = rho * a, rho * b, rho * rho * cov + q * np.eye(p)
                continue
            known = row is not None and not any(v is None or v != v for v in row)
            v = np.asarray(row, dtype=float) if known else None
            if kind == _UPDATE:
                gain = cov @ v / float(v @ cov @ v + observation_variance)
                a, b, cov = a - np.outer(gain, v @ a), b + gain * (float(target) - float(v @ b)), cov - np.outer(gain, v @ cov)
            else:
                out.append((at, order, (v @ a).tolist() if known else None, float(v @ b) if known else None, None, None))
        names = ["__ts", "__tie", "__gain", "__own", "__a", "__b"]
        out.append((None, None, None, None, a.ravel().tolist(), b.tolist()))
        made_rows = pd.DataFrame(out, columns=names).astype(object)
        for k in head:
            made_rows[k] = pdf[k].iloc[0]
        return made_rows[[*head, *names]]

    local = events.join(entering, head).groupBy(*head).applyInPandas(affine, T.StructType([*heads, *placed, *made]))
    local = cut_lineage(local)

    def chain_state(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, entering = pdf.sort_values(SLICE), first, []
        for flat, push in zip(pdf["__a"], pdf["__b"], strict=True):
            entering.append(state.tolist())
            state = np.asarray(flat, dtype=float).reshape(p, p) @ state + np.asarray(push, dtype=float)
        return pdf[head].assign(__in=entering)

    ends = local.where("__a IS NOT NULL").select(*head, "__a", "__b")
    carried = ends.groupBy(*keys).applyInPandas(chain_state, T.StructType([*heads, T.StructField("__in", numbers)]))
    inner = F.aggregate(F.zip_with("__gain", "__in", lambda g, b: g * b), F.lit(0.0), lambda s, v: s + v)
    predicted = local.where("__a IS NULL").join(carried, head).select(*keys, F.col("__ts").alias(ts), F.col("__tie").alias(tie), (F.col("__own") + inner).alias(name))
    return df.join(predicted, [*keys, ts, tie], "left")
