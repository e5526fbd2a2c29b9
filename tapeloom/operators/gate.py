"""A nonlinear gate: where will a model beat its baseline, as a function of the state?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .asof import asof_offsets
from .gram import logistic_fit
from .quantiles import quantiles
from .slices import Slices, ordered_scan, run_sum

KNOTS = (0.2, 0.4, 0.6, 0.8)


def forward_advantage(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, losses: Sequence[tuple[str, str]], window: int, slices: Slices, name: str = "height"
) -> DataFrame:
    """``df`` with the median over ``losses`` (model, baseline) of 1 - model loss / baseline loss, each summed from the
    row to the last one at most ``window`` later.

    Both ends are running sums, so no row is copied into a frame: the right edge is one as-of lookup. Null
    losses count as none; a window without baseline loss, or no window at all, gives null.
    """
    sums = {}
    for k, (model, base) in enumerate(losses):
        known = F.col(model).isNotNull() & F.col(base).isNotNull()
        sums[f"__m{k}"], sums[f"__b{k}"] = run_sum(F.when(known, F.col(model)).otherwise(0.0)), run_sum(F.when(known, F.col(base)).otherwise(0.0))
    names = list(sums)
    rows = cut_lineage(ordered_scan(df, keys, [ts, tie], slices, sums))
    edge = asof_offsets(
        rows, rows.select(*keys, F.col(ts).alias("__rts"), F.col(tie).alias("__rtie"), *names), keys=keys, id_cols=[ts, tie], left_ts=ts,
        offsets={"to": window}, right_ts="__rts", values=names, slices=slices, right_ties=["__rtie"], covered=False,
    )
    both = rows.join(edge, [*keys, ts, tie])
    shares = []
    for k, (model, base) in enumerate(losses):
        known = F.col(model).isNotNull() & F.col(base).isNotNull()
        own_m, own_b = (F.when(known, F.col(c)).otherwise(0.0) for c in (model, base))
        ahead_m, ahead_b = F.col(f"to___m{k}") - F.col(f"__m{k}") + own_m, F.col(f"to___b{k}") - F.col(f"__b{k}") + own_b
        shares.append(F.when(ahead_b > 1e-12, 1 - ahead_m / ahead_b))
    valid = F.array_sort(F.filter(F.array(*shares), lambda v: v.isNotNull()))
    n = F.size(valid)
    middle = (F.get(valid, F.floor((n - 1) / 2).cast("int")) + F.get(valid, F.floor(n / 2).cast("int"))) / 2
    return both.select(*df.columns, F.when(n > 0, middle).alias(name))


def spline_terms(df: DataFrame, columns: Sequence[str], train: Column, products: Sequence[tuple[int, int]], slices: dict[str, Slices]) -> list[Column]:
    """Basis columns from training rows: each column standardised, hinges at its training quintiles, and products.

    Means, deviations and knots are numbers of the training rows (six a column reach the driver).
    """
    own = df.where(train)
    stats = own.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    z, terms = [], []
    for c in columns:
        scale = stats[f"s_{c}"] if stats[f"s_{c}"] else 1.0
        z.append((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(scale))
        knots = quantiles(own, [], c, {f"k{i}": p for i, p in enumerate(KNOTS)}, slices[c]).first()
        terms.append(z[-1])
        terms += [F.greatest(z[-1] - F.lit((knots[f"k{i}"] - stats[f"m_{c}"]) / scale), F.lit(0.0)) for i in range(len(KNOTS))]
    return [*terms, *[z[i] * z[j] for i, j in products]]


def fit_gate(
    df: DataFrame, columns: Sequence[str], height: str, split: str, penalties: Sequence[float], products: Sequence[tuple[int, int]], slices: dict[str, Slices]
) -> tuple[DataFrame, dict]:
    """``df`` with ``gate``, the fitted chance that ``height`` is above zero, and the report of the fit.

    Fitted on rows with split 'train', the penalty by the log loss on 'validation' (the smaller of equals); rows
    without a height or a column teach nothing, without a column they get no gate.
    """
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    labelled = df.withColumn("__t", F.when(F.col(height).isNotNull() & complete, (F.col(height) > 0).cast("double")))
    terms = spline_terms(labelled, columns, (F.col(split) == "train") & F.col("__t").isNotNull(), products, slices)
    staged = cut_lineage(labelled.withColumn("__x", F.when(complete, F.array(*terms))))
    train, validation = (staged.where((F.col(split) == s) & F.col("__t").isNotNull()) for s in ("train", "validation"))

    def chance(beta: list[float]) -> Column:
        dot = F.aggregate(F.zip_with("__x", F.array(*[F.lit(b) for b in beta[1:]]), lambda a, b: a * b), F.lit(beta[0]), lambda s, e: s + e)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), dot))))

    fits = {p: logistic_fit(train, "__x", "__t", len(terms), p) for p in penalties}
    losses = []
    for p, fit in fits.items():
        g = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), chance(fit["coefficients"])))
        losses.append(F.avg(-F.when(F.col("__t") == 1, F.log(g)).otherwise(F.log(1 - g))).alias(f"p{len(losses)}"))
    scored = dict(zip(fits, validation.agg(*losses).first(), strict=True))
    best = min(fits, key=lambda p: (scored[p] if scored[p] is not None else float("inf"), p))
    gate = F.when(F.col("__x").isNotNull(), chance(fits[best]["coefficients"]))
    return staged.withColumn("gate", gate).drop("__t", "__x"), {"penalty": best, "losses": scored, **fits[best]}
