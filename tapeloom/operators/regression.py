"""Regressions as moment aggregation: one pass sums the cross-products, one small solve per cell."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def moment_columns(features: Sequence[str], target: str, weight: Column | None = None) -> list[Column]:
    """Count, sums and cross-product sums needed to fit ``target`` on ``features``.

    All are plain sums, so they combine before the shuffle and add up across folds.
    """
    names = [*features, target]
    w = F.lit(1.0) if weight is None else weight
    out = [F.sum(w).alias("m_n")]
    for i, a in enumerate(names):
        out.append(F.sum(w * F.col(a)).alias(f"m_{i}"))
        for j in range(i, len(names)):
            out.append(F.sum(w * F.col(a) * F.col(names[j])).alias(f"m_{i}_{j}"))
    return out


def moments(df: DataFrame, groups: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """Moment row per group over rows with every value present."""
    complete = df.dropna(subset=[*features, target])
    return complete.groupBy(*groups).agg(*moment_columns(features, target))


def _solve(row: dict, p: int, alpha: float) -> tuple[list[float] | None, float, float]:
    """Standardised ridge with an unpenalised intercept, mapped back to raw units."""
    n = row["m_n"]
    mean = np.array([row[f"m_{i}"] for i in range(p + 1)]) / n
    full = np.array([[row[f"m_{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)])
    cov = full / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:p], 0.0))
    usable = scale > 1e-12
    scale = np.where(usable, scale, 1.0)
    corr = cov[:p, :p] / np.outer(scale, scale)
    push = cov[:p, p] / scale
    gram = corr + (alpha / n) * np.eye(p)
    if np.linalg.matrix_rank(gram) < p:
        return None, float("nan"), float(mean[p])
    beta = np.linalg.solve(gram, push) / scale
    intercept = float(mean[p] - beta @ mean[:p])
    explained = 2 * beta @ cov[:p, p] - beta @ cov[:p, :p] @ beta
    r2 = float(explained / cov[p, p]) if cov[p, p] > 0 else float("nan")
    return [intercept, *map(float, beta)], r2, float(mean[p])


def solve_moments(table: DataFrame, features: Sequence[str], alphas: Sequence[float] = (0.0,)) -> DataFrame:
    """Coefficients per moment row and penalty: ``alpha``, ``coefficients`` (intercept first), ``r2``,
    ``train_mean``. A rank-deficient design gives null coefficients."""
    kept = [f for f in table.schema.fields if not f.name.startswith("m_")]
    schema = T.StructType(
        [
            *kept,
            T.StructField("n", T.DoubleType()),
            T.StructField("alpha", T.DoubleType()),
            T.StructField("coefficients", T.ArrayType(T.DoubleType())),
            T.StructField("r2", T.DoubleType()),
            T.StructField("train_mean", T.DoubleType()),
        ]
    )
    p, heads = len(features), [f.name for f in kept]

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                for alpha in alphas:
                    beta, r2, mean = _solve(row, p, alpha)
                    rows.append({**{h: row[h] for h in heads}, "n": row["m_n"], "alpha": alpha, "coefficients": beta, "r2": None if np.isnan(r2) else r2, "train_mean": mean})
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    return table.mapInPandas(run, schema)


def fit(df: DataFrame, groups: Sequence[str], features: Sequence[str], target: str, alphas: Sequence[float] = (0.0,)) -> DataFrame:
    """Ordinary or ridge least squares per group and penalty."""
    return solve_moments(moments(df, groups, features, target), features, alphas)


def predict(features: Sequence[str], coefficients: str = "coefficients") -> Column:
    """Linear prediction from a coefficient array column."""
    beta = F.col(coefficients)
    out = F.get(beta, 0)
    for i, f in enumerate(features):
        out = out + F.get(beta, i + 1) * F.col(f)
    return out


def score_from_moments(test: DataFrame, fits: DataFrame, groups: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Out-of-sample R² against the train mean, from the moments of the test rows alone.

    The squared error is a quadratic form in the coefficients, so no test row is visited again.
    """
    p = len(features)
    joined = test.join(fits.select(*groups, "alpha", "coefficients", "train_mean"), list(groups)) if groups else test.crossJoin(
        F.broadcast(fits.select("alpha", "coefficients", "train_mean"))
    )
    beta = F.col("coefficients")
    n = F.col("m_n")
    b = [F.get(beta, i) for i in range(p + 1)]
    fitted2 = b[0] * b[0] * n
    cross = b[0] * F.col(f"m_{p}")
    for i in range(p):
        fitted2 = fitted2 + 2.0 * b[0] * b[i + 1] * F.col(f"m_{i}")
        cross = cross + b[i + 1] * F.col(f"m_{i}_{p}")
        for j in range(p):
            fitted2 = fitted2 + b[i + 1] * b[j + 1] * F.col(f"m_{min(i, j)}_{max(i, j)}")
    yy = F.col(f"m_{p}_{p}")
    sse = yy - 2.0 * cross + fitted2
    mu = F.col("train_mean")
    sst = yy - 2.0 * mu * F.col(f"m_{p}") + mu * mu * n
    return joined.select(
        *groups, "alpha", n.alias("test_n"), sse.alias("sse"), F.when(sst > 0, 1.0 - sse / sst).alias("oos_r2")
    )


def first_component(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """First principal component per group: sign fixed to a positive sum, L1-normalised weights."""
    table = df.dropna(subset=list(columns)).groupBy(*groups).agg(*moment_columns(columns[:-1], columns[-1]))
    kept = [f for f in table.schema.fields if not f.name.startswith("m_")]
    schema = T.StructType(
        [*kept, T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("explained", T.DoubleType())]
    )
    p, heads = len(columns), [f.name for f in kept]

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                n = row["m_n"]
                mean = np.array([row[f"m_{i}"] for i in range(p)]) / n
                full = np.array([[row[f"m_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
                values, vectors = np.linalg.eigh(full / n - np.outer(mean, mean))
                w = vectors[:, -1] * (1.0 if vectors[:, -1].sum() >= 0 else -1.0)
                rows.append({**{h: row[h] for h in heads}, "weights": list(map(float, w / np.abs(w).sum())), "explained": float(values[-1] / values.sum())})
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    return table.mapInPandas(run, schema)


def variance_inflation(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Variance-inflation factor of each column from the inverse correlation matrix."""
    table = df.dropna(subset=list(columns)).groupBy(*groups).agg(*moment_columns(columns[:-1], columns[-1]))
    kept = [f for f in table.schema.fields if not f.name.startswith("m_")]
    schema = T.StructType([*kept, T.StructField("feature", T.StringType()), T.StructField("vif", T.DoubleType())])
    p, heads, names = len(columns), [f.name for f in kept], list(columns)

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                n = row["m_n"]
                mean = np.array([row[f"m_{i}"] for i in range(p)]) / n
                full = np.array([[row[f"m_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
                cov = full / n - np.outer(mean, mean)
                sd = np.sqrt(np.diag(cov))
                inv = np.linalg.pinv(cov / np.outer(sd, sd))
                rows += [{**{h: row[h] for h in heads}, "feature": f, "vif": float(inv[i, i])} for i, f in enumerate(names)]
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    return table.mapInPandas(run, schema)


def shrink_families(effects: DataFrame, family: str, effect: str, error: str) -> DataFrame:
    """Empirical-Bayes shrinkage of each effect toward its family's precision-weighted mean."""
    w = 1.0 / (F.col(error) * F.col(error))
    fam = effects.groupBy(family).agg(
        (F.sum(w * F.col(effect)) / F.sum(w)).alias("family_mean"),
        F.greatest(F.var_samp(effect) - F.avg(F.col(error) * F.col(error)), F.lit(0.0)).alias("between"),
    )
    keep = F.col("between") / (F.col("between") + F.col(error) * F.col(error))
    return effects.join(fam, family).withColumn(
        "shrunk", F.col("family_mean") + F.coalesce(keep, F.lit(0.0)) * (F.col(effect) - F.col("family_mean"))
    )


def ensemble_weights(scores: DataFrame, groups: Sequence[str], model: str, score: str, temperature: float = 1.0) -> DataFrame:
    """Softmax weights of models from the mean of their past scores."""
    means = scores.groupBy(*groups, model).agg(F.avg(score).alias("m"))
    top = means.groupBy(*groups).agg(F.max("m").alias("mx"))
    raw = (means.join(top, list(groups)) if groups else means.crossJoin(F.broadcast(top))).withColumn(
        "e", F.exp((F.col("m") - F.col("mx")) / temperature)
    )
    tot = raw.groupBy(*groups).agg(F.sum("e").alias("t"))
    joined = raw.join(tot, list(groups)) if groups else raw.crossJoin(F.broadcast(tot))
    return joined.select(*groups, model, (F.col("e") / F.col("t")).alias("weight"))


def stoikov_adjustment(transitions: DataFrame, minimum: int = 10, until: int | None = None, resolved: str = "resolved_ts", most_states: int = 4096) -> DataFrame:
    """Microprice adjustment per state: solve (I - B) g = g1 on the state lattice.

    Only transitions resolved before ``until`` enter: one that begins in training and ends after it would
    tell the fit about the test period. Shares are of a state's own transitions, so what leads to a state
    with fewer than ``minimum`` leaves the chain. ``converged`` says whether the chain dies out; if it
    does not, the adjustment is the one-step mean. The tape is reduced to counts per (state, next state);
    one task solves that table, which a lattice of more than ``most_states`` states refuses.
    """
    if until is not None:
        transitions = transitions.where(F.col(resolved) < until)
    cells = transitions.groupBy("state", "next_state").agg(F.count(F.lit(1)).alias("n"), F.sum("mid_change_ticks").alias("s"))
    schema = "state string, transitions long, one_step double, adjustment double, estimated boolean, converged boolean"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        states = pdf.groupby("state", as_index=False)[["n", "s"]].sum().sort_values("state")
        if len(states) > most_states:
            raise ValueError(f"more than {most_states} states")
        enough = states[states["n"] >= minimum]
        share = pdf.pivot_table(index="state", columns="next_state", values="n", aggfunc="sum", fill_value=0)
        inside = share.reindex(index=enough["state"], columns=enough["state"], fill_value=0).to_numpy(dtype=float) / enough["n"].to_numpy(dtype=float)[:, None]
        step = (enough["s"] / enough["n"]).to_numpy(dtype=float)
        dies = bool(len(enough)) and float(np.abs(np.linalg.eigvals(inside)).max()) < 1 - 1e-9
        solved = dict(zip(enough["state"], np.linalg.solve(np.eye(len(enough)) - inside, step) if dies else step, strict=True))
        return pd.DataFrame(
            {
                "state": states["state"], "transitions": states["n"], "one_step": states["s"] / states["n"],
                "adjustment": states["state"].map(solved).astype(float), "estimated": states["n"] >= minimum, "converged": dies,
            }
        )

    return cells.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(solve, schema)
