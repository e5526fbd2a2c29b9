"""Models of many features from Gram matrices of blocks.

Each task sums the cross-products of its rows for every block it sees; entries are added up in Spark. What
follows works on as many small matrices as there are blocks, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _finite(vector: Column, width: int) -> Column:
    ok = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == width) & ok


def block_grams(df: DataFrame, block: str, vector: str, target: str, width: int, weight: str | None = None) -> DataFrame:
    """(block, gram): per block the matrix over (1, features, target) of sums of (weighted) products, row by row.

    Rows whose vector has another width or holds nulls or non-finite numbers, or whose block or target is
    null, take no part. Blocks are few (cross-validation or resampling units); a task returns one matrix
    for each it saw, entry by entry, so that adding up is shared by all tasks.
    """
    p = width + 2
    v = F.col(vector).cast("array<double>")
    rows = df.where(_finite(v, width) & F.col(target).isNotNull() & F.col(block).isNotNull())
    rows = rows.select(F.col(block).cast("long").alias("block"), v.alias("x"), F.col(target).cast("double").alias("y"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            own, y, w = (batch.column(k).to_numpy() for k in (0, 2, 3))
            x = batch.column(1).flatten().to_numpy().reshape(-1, width)
            z = np.c_[np.ones(len(y)), x, y]
            for b in np.unique(own):
                at = own == b
                sums[int(b)] = sums.get(int(b), 0.0) + z[at].T @ (z[at] * w[at, None])
        for b, gram in sums.items():
            columns = [np.full(p * p, b), np.arange(p * p, dtype=np.int32), gram.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "at", "s"])

    entries = rows.mapInArrow(run, "block long, at int, s double").groupBy("block", "at").agg(F.sum("s").alias("s"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda e: e["s"])
    return entries.groupBy("block").agg(packed.alias("gram"))


class Standard(NamedTuple):
    """Standardised moments: correlations of the features, their covariances with the target, and the way back."""

    n: float
    corr: np.ndarray
    push: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    target_mean: float
    target_variance: float


def standardised(gram: np.ndarray) -> Standard:
    n = gram[0, 0]
    mean = gram[0] / n
    cov = gram / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[1:-1], 0.0))
    scale = np.where(scale > 1e-12, scale, 1.0)
    return Standard(n, cov[1:-1, 1:-1] / np.outer(scale, scale), cov[1:-1, -1] / scale, mean[1:-1], scale, mean[-1], max(cov[-1, -1], 0.0))


def elastic_net(s: Standard, alpha: float, l1_ratio: float, start: np.ndarray | None = None, tolerance: float = 1e-10, rounds: int = 10_000) -> np.ndarray:
    """Standardised coefficients that minimise the mean squared error / 2 + alpha (l1_ratio |b| + (1 - l1_ratio) b^2 / 2),
    one after the other from the Gram matrix alone."""
    b = np.zeros(len(s.push)) if start is None else start.copy()
    own = np.diag(s.corr)
    pull = s.corr @ b
    for _ in range(rounds):
        largest = 0.0
        for j in range(len(b)):
            rest = s.push[j] - pull[j] + own[j] * b[j]
            below = own[j] + alpha * (1 - l1_ratio)
            new = np.sign(rest) * max(abs(rest) - alpha * l1_ratio, 0.0) / below if below > 0 else 0.0
            step = new - b[j]
            if step:
                pull += s.corr[:, j] * step
                b[j] = new
                largest = max(largest, abs(step))
        if largest < tolerance:
            break
    return b


def half_sample(blocks: Sequence[int], replicate: int, seed: int) -> set[int]:
    """Half of the blocks, by md5 of the replicate and the block."""
    order = sorted(blocks, key=lambda b: (md5(f"{seed}:{replicate}:{b}".encode()).hexdigest(), b))
    return set(order[: max(1, len(order) // 2)])


def elastic_net_paths(grams: DataFrame, width: int, alphas: Sequence[float], l1_ratio: float, *, replicates: int = 0, seed: int = 7) -> DataFrame:
    """(replicate, alpha, feature, coefficient, raw, intercept): warm-started paths of the whole table (replicate 0)
    and of half samples of its blocks. ``coefficient`` is standardised, ``raw`` in the feature's units.

    Every task has all block matrices (their number and size are parameters) and fits its share of replicates.
    """
    shares = max(1, min(16, replicates + 1))
    spread = grams.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    path = sorted(alphas, reverse=True)
    names = ["replicate", "alpha", "feature", "coefficient", "raw", "intercept"]

    def run(group: pa.Table) -> pa.Table:
        share = group.column("share")[0].as_py()
        blocks = {b: np.asarray(g, dtype=float).reshape(width + 2, width + 2) for b, g in zip(group.column("block").to_pylist(), group.column("gram").to_pylist(), strict=True)}
        out: list[list] = [[] for _ in names]
        for replicate in range(share, replicates + 1, shares):
            chosen = half_sample(sorted(blocks), replicate, seed) if replicate else set(blocks)
            s = standardised(sum(blocks[b] for b in sorted(chosen)))
            b = np.zeros(width)
            for alpha in path:
                b = elastic_net(s, alpha, l1_ratio, b)
                raw = b / s.scale
                rows = [[replicate] * width, [alpha] * width, range(width), b.tolist(), raw.tolist(), [float(s.target_mean - raw @ s.mean)] * width]
                for column, values in zip(out, rows, strict=True):
                    column.extend(values)
        kinds = (pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return spread.groupBy("share").applyInArrow(run, "replicate int, alpha double, feature int, coefficient double, raw double, intercept double")


def selection_frequency(paths: DataFrame) -> DataFrame:
    """(alpha, feature, frequency, positive, coefficient): how often half samples choose a feature, with the share of
    positive signs among these, beside the coefficient of the whole table."""
    drawn, chosen = F.col("replicate") > 0, F.col("coefficient") != 0
    return paths.groupBy("alpha", "feature").agg(
        F.try_divide(F.count(F.when(drawn & chosen, 1)), F.count(F.when(drawn, 1))).alias("frequency"),
        F.try_divide(F.count(F.when(drawn & (F.col("coefficient") > 0), 1)), F.count(F.when(drawn & chosen, 1))).alias("positive"),
        F.max(F.when(~drawn, F.col("coefficient"))).alias("coefficient"),
    )


def optimality(df: DataFrame, vector: str, target: str, width: int, paths: DataFrame, l1_ratio: float, tolerance: float = 1e-6) -> DataFrame:
    """(alpha, feature, active, gradient, satisfied): the conditions a minimum must meet, from the rows themselves.

    The gradient of the squared error is summed over all rows with the fitted residuals, not taken from the
    matrices the fit used.
    """
    whole = paths.where("replicate = 0")
    fits = whole.groupBy("alpha").agg(
        F.first("intercept").alias("intercept"), F.transform(F.array_sort(F.collect_list(F.struct("feature", "raw"))), lambda e: e["raw"]).alias("raw")
    )
    v = F.col(vector).cast("array<double>")
    rows = df.where(_finite(v, width) & F.col(target).isNotNull()).select(v.alias("x"), F.col(target).cast("double").alias("y"))
    fitted = rows.crossJoin(F.broadcast(fits))  # one row for each penalty of the path
    dot = F.aggregate(F.zip_with("x", "raw", lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
    residual = F.col("y") - F.col("intercept") - dot
    long = fitted.select("alpha", residual.alias("r"), F.posexplode("x").alias("feature", "v"))
    sums = long.groupBy("alpha", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("r") * F.col("v")).alias("rv"), F.avg("v").alias("m"), F.avg("r").alias("mr"), F.stddev_pop("v").alias("s"))
    both = sums.join(whole.select("alpha", "feature", "coefficient"), ["alpha", "feature"])
    b, l1 = F.col("coefficient"), F.col("alpha") * l1_ratio
    gradient = F.when(F.col("s") > 1e-12, (F.col("rv") - F.col("m") * F.col("mr")) / F.col("s")).otherwise(0.0) - F.col("alpha") * (1 - l1_ratio) * b
    apart = F.when(b == 0, F.abs(gradient) - l1).otherwise(F.abs(gradient - l1 * F.signum(b)))
    return both.select("alpha", "feature", (b != 0).alias("active"), gradient.alias("gradient"), (apart <= tolerance).alias("satisfied"))


# ---- conditional usefulness ---------------------------------------------------------------------------


def sweep(m: np.ndarray, k: int) -> np.ndarray:
    """The sweep of a symmetric matrix on pivot ``k``: it takes variable k into a regression, and the reverse step out."""
    d = m[k, k]
    out = m - np.outer(m[:, k], m[k]) / d
    out[k], out[:, k] = m[k] / d, m[:, k] / d
    out[k, k] = -1.0 / d
    return out


def unsweep(m: np.ndarray, k: int) -> np.ndarray:
    d = m[k, k]
    out = m - np.outer(m[:, k], m[k]) / d
    out[k], out[:, k] = -m[k] / d, -m[:, k] / d
    out[k, k] = -1.0 / d
    return out


def drop_fits(train: np.ndarray, clusters: Sequence[Sequence[int]], alpha: float) -> list[np.ndarray]:
    """Raw ridge coefficients (intercept first) with all features, then without each cluster, from one matrix.

    All features are swept in once; a cluster is left out by sweeping its members back.
    """
    s = standardised(train)
    p = len(s.push)
    m = np.zeros((p + 1, p + 1))
    m[:p, :p], m[:p, p], m[p, :p], m[p, p] = s.corr + alpha / s.n * np.eye(p), s.push, s.push, s.target_variance
    for k in range(p):
        m = sweep(m, k)

    def raw(swept: np.ndarray, without: Sequence[int]) -> np.ndarray:
        b = swept[:p, p].copy()
        b[list(without)] = 0.0
        b = b / s.scale
        return np.r_[s.target_mean - b @ s.mean, b]

    out = [raw(m, [])]
    for cluster in clusters:
        less = m
        for k in cluster:
            less = unsweep(less, k)
        out.append(raw(less, cluster))
    return out


def _out_of_sample(gram: np.ndarray, beta: np.ndarray, train_mean: float) -> float | None:
    """R2 of raw coefficients on a test matrix against the train mean."""
    full = np.r_[beta, -1.0]
    sse = float(full @ gram @ full)
    sst = float(gram[-1, -1] - 2 * train_mean * gram[0, -1] + train_mean**2 * gram[0, 0])
    return 1 - sse / sst if sst > 0 else None


def cluster_usefulness(grams: DataFrame, width: int, clusters: Sequence[Sequence[int]], alpha: float) -> DataFrame:
    """(cluster, full_r2, dropped_r2, delta, coefficients) from the matrices of blocks 0 (train) and 1 (test).

    Every cluster is left out of a refit; ``delta`` is what the held-out R2 loses. Cluster -1 is the full model
    with its coefficients.
    """
    names = ["cluster", "full_r2", "dropped_r2", "delta", "coefficients"]
    choices = [list(c) for c in clusters]

    def run(group: pa.Table) -> pa.Table:
        sides = {b: np.asarray(g, dtype=float).reshape(width + 2, width + 2) for b, g in zip(group.column("block").to_pylist(), group.column("gram").to_pylist(), strict=True)}
        rows = []
        if 0 in sides and 1 in sides:
            mean = sides[0][0, -1] / sides[0][0, 0]
            fits = drop_fits(sides[0], choices, alpha)
            full = _out_of_sample(sides[1], fits[0], mean)
            rows.append((-1, full, None, None, fits[0].tolist()))
            for k, beta in enumerate(fits[1:]):
                r2 = _out_of_sample(sides[1], beta, mean)
                rows.append((k, full, r2, None if r2 is None or full is None else full - r2, beta.tolist()))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        kinds = (pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    one = grams.where("block IN (0, 1)").withColumn("all", F.lit(0)).groupBy("all")  # two matrices
    return one.applyInArrow(run, "cluster int, full_r2 double, dropped_r2 double, delta double, coefficients array<double>")


def permuted_usefulness(
    rows: DataFrame, position: str, vector: str, target: str, width: int, coefficients: Sequence[float], train_mean: float,
    clusters: Sequence[Sequence[int]], *, block: int, repeats: int, seed: int,
) -> DataFrame:
    """(cluster, repeat, full_r2, permuted_r2, delta) of a fixed linear model when a cluster's columns move in blocks.

    ``rows`` are the held-out rows with their 0-based ``position``; blocks of ``block`` rows exchange places with
    blocks of their own length. The model is linear, so a cluster's columns matter only through one number a
    row, and a block of these numbers is what moves: no feature is copied. Places are drawn by md5.
    """
    beta = list(coefficients)
    v = F.col(vector).cast("array<double>")

    def part(members: Sequence[int]) -> Column:
        return sum((F.get(v, k) * float(beta[k + 1]) for k in members), F.lit(0.0))

    known = rows.where(_finite(v, width) & F.col(target).isNotNull() & F.col(position).isNotNull())
    y = F.col(target).cast("double")
    scored = known.select(
        F.expr(f"{position} div {block}").alias("block"), F.col(position).alias("at"),
        (y - float(beta[0]) - part(range(width))).alias("r"), F.array(*[part(c) for c in clusters]).alias("u"), y.alias("y"),
    )
    pick = F.array_sort(F.collect_list(F.struct("at", "r", "u")))
    blocks = scored.groupBy("block").agg(
        pick.alias("rows"), F.count(F.lit(1)).alias("n"),
        F.sum((F.col("y") - train_mean) ** 2).alias("sst"), F.sum(F.col("r") ** 2).alias("sse"),
    )
    blocks = cut_lineage(blocks.select("block", "n", "sst", "sse", F.transform("rows", lambda e: e["r"]).alias("r"), F.transform("rows", lambda e: e["u"]).alias("u")))
    draws = F.explode(F.sequence(F.lit(0), F.lit(len(clusters) * repeats - 1))).alias("draw")
    lot = F.md5(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string"), F.lit(":"), F.col("block").cast("string")))
    # The i-th block of a length gets the contents of the block with the i-th lot of that length.
    named = blocks.select("block", "n", draws)
    places = named.withColumn("i", F.row_number().over(Window.partitionBy("draw", "n").orderBy("block")))
    sources = named.withColumn("i", F.row_number().over(Window.partitionBy("draw", "n").orderBy(lot, "block"))).select("draw", "n", "i", F.col("block").alias("source"))
    moves = places.join(sources, ["draw", "n", "i"]).select("draw", "block", "source")
    cluster = F.expr(f"draw div {repeats}").cast("int")
    take = F.transform("u", lambda e: F.get(e, F.col("cluster")))
    own = moves.withColumn("cluster", cluster).join(blocks.select("block", "r", "u"), "block").select("draw", "cluster", "block", "source", "r", take.alias("own"))
    other = blocks.select(F.col("block").alias("source"), "u")
    both = own.join(other, "source").select("draw", "cluster", "r", "own", take.alias("moved"))
    error = F.aggregate(F.zip_with(F.zip_with("r", "own", lambda r, u: r + u), "moved", lambda a, u: (a - u) * (a - u)), F.lit(0.0), lambda s, e: s + e)
    sums = both.groupBy("draw", "cluster").agg(F.sum(error).alias("moved_sse"))
    totals = blocks.agg(F.sum("sst").alias("sst"), F.sum("sse").alias("sse"))
    out = sums.crossJoin(F.broadcast(totals))  # one row
    full, moved = 1 - F.col("sse") / F.col("sst"), 1 - F.col("moved_sse") / F.col("sst")
    return out.where("sst > 0").select("cluster", (F.col("draw") % repeats).alias("repeat"), full.alias("full_r2"), moved.alias("permuted_r2"), (full - moved).alias("delta"))


# ---- logistic fits ----------------------------------------------------------------------------------------


def logistic_fit(df: DataFrame, vector: str, target: str, width: int, penalty: float = 0.0, rounds: int = 50, tolerance: float = 1e-8) -> dict:
    """Logistic regression by reweighted moments: ``coefficients`` (intercept first, unpenalised), ``errors``, ``wald``
    z values, ``gradient`` (its largest entry at the end), ``n``, ``rounds``.

    Each round is one pass that sums the weighted cross-products and the working response; the driver solves
    one small system. Store a costly input first. Rows as in ``block_grams``; a target of one kind only gives
    the constant log odds of half a success added to each side.
    """
    beta = np.zeros(width + 1)
    v = F.col(vector).cast("array<double>")
    rows = df.where(_finite(v, width) & F.col(target).isNotNull()).select(F.lit(0).alias("block"), v.alias("x"), F.col(target).cast("double").alias("t"))
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("t")).first()
    if not n or ones in (0.0, float(n)):
        rate = ((ones or 0.0) + 0.5) / (n + 1.0)
        beta[0] = np.log(rate / (1 - rate))
        return {"coefficients": beta.tolist(), "errors": None, "wald": None, "gradient": 0.0, "n": n, "rounds": 0}
    penalise = penalty * np.eye(width + 1)
    penalise[0, 0] = 0.0
    for done in range(1, rounds + 1):
        dot = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(b)) for b in beta[1:]]), lambda a, b: a * b), F.lit(float(beta[0])), lambda s, e: s + e)
        linear = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), dot))
        staged = rows.withColumn("lin", linear).withColumn("p", 1 / (1 + F.exp(-F.col("lin"))))
        staged = staged.withColumn("w", F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-6))).withColumn("z", F.col("lin") + (F.col("t") - F.col("p")) / F.col("w"))
        gram = np.asarray(block_grams(staged, "block", "x", "z", width, "w").first()["gram"], dtype=float).reshape(width + 2, width + 2)
        inner, push = gram[:-1, :-1] + penalise, gram[:-1, -1]
        # The weighted response is X'W lin + X'(t - p), so what is beyond inner @ beta is the gradient.
        gradient = push - inner @ beta
        new = np.linalg.solve(inner, push) if np.linalg.matrix_rank(inner) == width + 1 else np.linalg.lstsq(inner, push, rcond=None)[0]
        moved = float(np.max(np.abs(new - beta)))
        if moved < tolerance:
            break
        beta = new
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(inner)), 0.0))
    return {
        "coefficients": beta.tolist(), "errors": errors.tolist(), "wald": np.where(errors > 0, beta / np.where(errors > 0, errors, 1), np.nan).tolist(),
        "gradient": float(np.max(np.abs(gradient))), "n": n, "rounds": done,
    }
