"""Nested walk-forward scoring from prefix moments.

One pass sums the cross-products of each session. Running sums of these over sessions make every train
set "sessions up to a" a row, and every test set "after a, up to b" a difference of two rows, so any
number of folds, inner folds and candidates costs small solves and no further look at the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .regression import moments
from .slices import Slices, ordered_scan, row_no, run_sum


class Candidate(NamedTuple):
    """A model to score: ridge on some of the features (ordinary least squares at penalty 0)."""

    name: str
    features: tuple[str, ...]
    alpha: float = 0.0
    threshold: float = 0.1  #: selected within this share of the best validation score
    control: bool = False  #: negative controls compete among themselves


def session_prefixes(df: DataFrame, groups: Sequence[str], session: str, features: Sequence[str], target: str, slices: Slices) -> DataFrame:
    """(groups, i, m): the moments of all sessions up to the i-th as one array; ``slices`` cut the session."""
    table = moments(df, [*groups, session], features, target)
    names = [c for c in table.columns if c.startswith("m_")]
    run = ordered_scan(table, groups, [session], slices, {**{n: run_sum(n) for n in names}, "i": row_no()})
    return run.select(*groups, "i", F.array(*names).alias("m"))


def window_moments(prefixes: DataFrame, windows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``windows(groups, ..., train_to, test_from, test_to)`` with the moments ``train`` of sessions 1 to train_to
    and ``test`` of those after test_from up to test_to."""
    out = windows
    for name in ("train_to", "test_from", "test_to"):
        side = prefixes.select(*groups, F.col("i").cast("long").alias(name), F.col("m").alias(f"__{name}"))
        out = out.join(side, [*groups, name], "left")
    lower = F.coalesce("__test_from", F.transform("__test_to", lambda _: F.lit(0.0)))
    test = F.zip_with("__test_to", lower, lambda a, b: a - b)
    return out.select(*windows.columns, F.col("__train_to").alias("train"), test.alias("test"))


def _square(flat: np.ndarray, p: int) -> np.ndarray:
    """The moment array as the full matrix over (1, features, target)."""
    out = np.zeros((p + 2, p + 2))
    out[0, 0], at = flat[0], 1
    for i in range(p + 1):
        out[0, i + 1] = out[i + 1, 0] = flat[at]
        at += 1
        for j in range(i, p + 1):
            out[i + 1, j + 1] = out[j + 1, i + 1] = flat[at]
            at += 1
    return out


def _ridge(m: np.ndarray, own: list[int], alpha: float) -> np.ndarray | None:
    """Intercept and coefficients of the features numbered ``own``, standardised while fitting."""
    n, y = m[0, 0], m.shape[0] - 1
    if n < len(own) + 2:
        return None
    at = [1 + k for k in own]
    mean = m[0, [*at, y]] / n
    cov = m[np.ix_([*at, y], [*at, y])] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0))
    scale = np.where(scale > 1e-12, scale, 1.0)
    gram = cov[:-1, :-1] / np.outer(scale, scale) + alpha / n * np.eye(len(own))
    if np.linalg.matrix_rank(gram) < len(own):
        return None
    beta = np.linalg.solve(gram, cov[:-1, -1] / scale) / scale
    return np.r_[mean[-1] - beta @ mean[:-1], beta]


def _scores(m: np.ndarray, own: list[int], beta: np.ndarray, train_mean: float) -> tuple[float, float | None, float, float]:
    """(rows, correlation of target and prediction, squared error, squared error of the train mean)."""
    n, y = m[0, 0], m.shape[0] - 1
    rows = [0, *[1 + k for k in own]]
    inner = m[np.ix_(rows, rows)]
    fitted, cross, total = beta @ inner @ beta, beta @ m[rows, y], beta @ inner[:, 0]
    sse = m[y, y] - 2 * cross + fitted
    sst = m[y, y] - 2 * train_mean * m[0, y] + train_mean**2 * n
    if n < 2:
        return n, None, sse, sst
    var_p, var_y, cov = fitted / n - (total / n) ** 2, m[y, y] / n - (m[0, y] / n) ** 2, cross / n - total * m[0, y] / n**2
    flat = var_p <= 1e-12 * max(1.0, (total / n) ** 2) or var_y <= 1e-12 * max(1.0, (m[0, y] / n) ** 2)
    return n, None if flat else float(cov / np.sqrt(var_p * var_y)), sse, sst


def score_windows(windows: DataFrame, features: Sequence[str], candidates: Sequence[Candidate], minimum: int) -> DataFrame:
    """Each window of ``window_moments`` for each candidate: ``candidate``, ``train_n``, ``test_n``, ``correlation``,
    ``sse``, ``sst``, ``coefficients`` (intercept first).

    A candidate is a part of the moment matrix. Too few rows on either side (``minimum``) or a train set
    that does not determine the fit gives null scores.
    """
    kept = [f for f in windows.schema.fields if f.name not in ("train", "test")]
    made = [("candidate", T.StringType()), ("train_n", T.DoubleType()), ("test_n", T.DoubleType()), ("correlation", T.DoubleType()), ("sse", T.DoubleType()), ("sst", T.DoubleType()), ("coefficients", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in made]])
    p, place = len(features), {f: k for k, f in enumerate(features)}
    choices = [(c, [place[f] for f in c.features]) for c in candidates]

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                sides = [np.zeros((p + 2, p + 2)) if row[s] is None else _square(np.asarray(row[s], dtype=float), p) for s in ("train", "test")]
                for c, own in choices:
                    out = {f.name: row[f.name] for f in kept} | {"candidate": c.name, "train_n": sides[0][0, 0], "test_n": sides[1][0, 0]}
                    out |= dict.fromkeys(("correlation", "sse", "sst", "coefficients"))
                    beta = _ridge(sides[0], own, c.alpha) if min(sides[0][0, 0], sides[1][0, 0]) >= minimum else None
                    if beta is not None:
                        n, correlation, sse, sst = _scores(sides[1], own, beta, sides[0][0, -1] / sides[0][0, 0])
                        out |= {"correlation": correlation, "sse": sse, "sst": sst, "coefficients": beta.tolist()}
                    rows.append(out)
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    return windows.mapInPandas(run, schema)


def _fold_windows(sizes: DataFrame, folds: int, minimum_sessions: int, embargo: int) -> DataFrame:
    """(groups, n, fold, first, last, known): fold tests sessions after first up to last; ``known`` end before the embargo."""
    width = F.greatest(F.floor((F.col("n") - minimum_sessions) / folds), F.lit(1))
    out = sizes.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("first", F.lit(minimum_sessions) + F.col("fold") * width)
    last = F.when(F.col("fold") == folds - 1, F.col("n")).otherwise(F.least(F.col("n"), F.col("first") + width))
    return out.withColumn("last", last).withColumn("known", F.col("first") - embargo).where("first < n AND known > 0")


def _session_counts(prefixes: DataFrame, groups: Sequence[str]) -> DataFrame:
    return prefixes.groupBy(*groups).agg(F.max("i").cast("long").alias("n"))


def _window(kind: str, train_to: Column, after: Column, upto: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), train_to.cast("long").alias("train_to"), after.cast("long").alias("test_from"), upto.cast("long").alias("test_to"))


def nested_walk_forward(
    df: DataFrame, groups: Sequence[str], session: str, features: Sequence[str], target: str, candidates: Sequence[Candidate], slices: Slices,
    *, folds: int, minimum_sessions: int, embargo: int, validation_share: float = 0.3, minimum: int = 30,
) -> DataFrame:
    """Every candidate in every outer fold: validation and outer score, support, selection and weight.

    An outer fold's earlier sessions, less the embargo, end in a validation part; candidates are fitted
    before it (again less the embargo), the validation score (absolute correlation) selects all within a
    candidate's threshold of the best and weighs them by score, and the outer sessions only evaluate.
    Negative controls are selected among themselves. Rows with a null feature or target take no part.
    """
    prefixes = cut_lineage(session_prefixes(df, groups, session, features, target, slices))
    plan = _fold_windows(_session_counts(prefixes, groups), folds, minimum_sessions, embargo)
    cut = F.floor(F.col("known") * (1 - validation_share))
    train_to = F.greatest(cut - embargo, F.lit(0))
    both = F.array(_window("validation", train_to, cut, F.col("known")), _window("outer", train_to, F.col("first"), F.col("last")))
    windows = window_moments(prefixes, plan.select(*groups, "fold", F.inline(both)), groups)
    scored = score_windows(windows, features, candidates, minimum)
    sides = scored.groupBy(*groups, "fold", "candidate").agg(
        F.max("train_n").alias("train_n"), F.max(F.when(F.col("kind") == "outer", F.col("test_n"))).alias("support"),
        F.max(F.when(F.col("kind") == "validation", F.col("correlation"))).alias("validation_score"),
        F.max(F.when(F.col("kind") == "outer", F.col("correlation"))).alias("outer_score"),
        F.max(F.when(F.col("kind") == "outer", F.col("coefficients"))).alias("coefficients"),
    )
    rules = df.sparkSession.createDataFrame([(c.name, c.threshold, c.control) for c in candidates], "candidate string, __threshold double, __control boolean")
    sides = sides.join(F.broadcast(rules), "candidate").withColumn("__s", F.abs("validation_score"))
    best = sides.groupBy(*groups, "fold", "__control").agg(F.max("__s").alias("__best"))
    marked = sides.join(best, [*groups, "fold", "__control"]).withColumn("selected", F.coalesce(F.col("__s") >= F.col("__best") * (1 - F.col("__threshold")), F.lit(False)))
    marked = cut_lineage(marked)
    sums = marked.where("selected").groupBy(*groups, "fold", "__control").agg(F.sum("__s").alias("__sum"), F.count(F.lit(1)).alias("__many"))
    share = F.when(F.col("__sum") > 0, F.col("__s") / F.col("__sum")).otherwise(1 / F.col("__many"))
    out = marked.join(sums, [*groups, "fold", "__control"], "left")
    return out.select(
        *groups, "fold", "candidate", "train_n", "support", "validation_score", "outer_score", "selected",
        F.when(F.col("selected"), share).otherwise(0.0).alias("weight"), "coefficients",
    )


def penalty_by_inner_folds(
    df: DataFrame, groups: Sequence[str], session: str, features: Sequence[str], target: str, alphas: Sequence[float], slices: Slices,
    *, folds: int, inner: int, minimum_sessions: int, embargo: int, minimum: int = 30,
) -> DataFrame:
    """(groups, fold, alpha, inner_r2, chosen, test_n, outer_r2): ridge penalties by expanding inner folds.

    The inner folds test the later half of the sessions known at the outer fold, each fitted on what comes
    before it less the embargo; the penalty with the least error over them (the smallest of equals) is
    chosen, and the outer score is that of a fit on all known sessions.
    """
    prefixes = cut_lineage(session_prefixes(df, groups, session, features, target, slices))
    plan = _fold_windows(_session_counts(prefixes, groups), folds, minimum_sessions, embargo)
    edge = [F.floor(F.col("known") * (inner + j) / (2 * inner)) for j in range(inner + 1)]
    parts = [_window("inner", F.greatest(edge[j] - embargo, F.lit(0)), edge[j], edge[j + 1]) for j in range(inner)]
    parts.append(_window("outer", F.col("known"), F.col("first"), F.col("last")))
    windows = window_moments(prefixes, plan.select(*groups, "fold", F.inline(F.array(*parts))), groups)
    candidates = [Candidate(repr(float(a)), tuple(features), float(a)) for a in alphas]
    scored = score_windows(windows, features, candidates, minimum).withColumn("alpha", F.col("candidate").cast("double"))
    is_inner = F.col("kind") == "inner"
    per = scored.groupBy(*groups, "fold", "alpha").agg(
        F.sum(F.when(is_inner, F.col("sse"))).alias("__sse"), F.sum(F.when(is_inner, F.col("sst"))).alias("__sst"),
        F.max(F.when(~is_inner, F.col("test_n"))).alias("test_n"),
        F.max(F.when(~is_inner & (F.col("sst") > 0), 1 - F.col("sse") / F.col("sst"))).alias("outer_r2"),
    )
    per = cut_lineage(per)
    best = per.where("__sse IS NOT NULL").groupBy(*groups, "fold").agg(F.min(F.struct("__sse", "alpha")).alias("__b"))
    return per.join(best, [*groups, "fold"], "left").select(
        *groups, "fold", "alpha", F.when(F.col("__sst") > 0, 1 - F.col("__sse") / F.col("__sst")).alias("inner_r2"),
        F.coalesce(F.col("alpha") == F.col("__b.alpha"), F.lit(False)).alias("chosen"), "test_n", "outer_r2",
    )
