"""Response-surface robustness: lattice neighbours and connected regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _steps(cells: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Each cell copied to its lattice neighbours' coordinates (two per axis)."""
    moves = [
        F.struct(*[(F.col(a) + (d if a == axis else 0)).alias(a) for a in axes]) for axis in axes for d in (-1, 1)
    ]
    return cells.withColumn("__to", F.explode(F.array(*moves)))


def neighbour_agreement(cells: DataFrame, axes: Sequence[str], value: str) -> DataFrame:
    """Neighbours one step away on one axis: how many exist and share the sign."""
    sent = _steps(cells, axes).select(*[F.col(f"__to.{a}").alias(a) for a in axes], F.col(value).alias("__v"))
    joined = cells.join(sent, list(axes), "left")
    same = F.signum(value) == F.signum("__v")
    agg = joined.groupBy(*axes).agg(F.count("__v").alias("neighbours"), F.count(F.when(same, 1)).alias("agreeing"))
    return agg.withColumn("isolated", F.col("agreeing") == 0)


def lattice_edges(cells: DataFrame, axes: Sequence[str], node: str) -> DataFrame:
    """Edges between existing lattice neighbours, both directions."""
    sent = _steps(cells, axes).select(*[F.col(f"__to.{a}").alias(a) for a in axes], F.col(node).alias("src"))
    return sent.join(cells.select(*axes, F.col(node).alias("dst")), list(axes)).select("src", "dst")


def connected_components(nodes: DataFrame, edges: DataFrame, node: str, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node per node, by min-label joins with pointer jumping.

    Rounds grow with the logarithm of the diameter. Each round is written to the checkpoint folder
    so a lost executor can read it back.
    """
    edges = cut_lineage(edges)
    labels = cut_lineage(nodes.select(F.col(node), F.col(node).alias("component")))
    for _ in range(max_rounds):
        offered = edges.join(labels, edges["src"] == labels[node]).groupBy(F.col("dst").alias(node)).agg(F.min("component").alias("__o"))
        hooked = labels.join(offered, node, "left").select(node, "component", F.least("component", F.coalesce("__o", "component")).alias("__n"))
        jump = labels.select(F.col(node).alias("__n"), F.col("component").alias("__j"))
        step = cut_lineage(
            hooked.join(jump, "__n", "left").select(node, "component", F.least("__n", F.coalesce("__j", "__n")).alias("__n"))
        )
        moved = step.where(F.col("__n") != F.col("component")).limit(1).count()
        labels = step.select(node, F.col("__n").alias("component"))
        if not moved:
            return labels
    raise RuntimeError("components did not settle; raise max_rounds")


def correlation_clusters(pairs: DataFrame, threshold: float) -> DataFrame:
    """Clusters of features joined by |r| at or above a threshold (``a``, ``b``, ``r`` rows)."""
    strong = pairs.where(F.abs("r") >= threshold)
    edges = strong.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        strong.select(F.col("b").alias("src"), F.col("a").alias("dst"))
    )
    nodes = pairs.select(F.col("a").alias("feature")).unionByName(pairs.select(F.col("b").alias("feature"))).distinct()
    return connected_components(nodes, edges, "feature")
