"""Connected components of a graph of any size, as DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def connected_components(edges: DataFrame, kind: str = "components", max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Alternating large-star and small-star rounds: each hangs nodes on the smallest neighbour seen, so the
    number of rounds grows with the logarithm of the longest path, not with the path. Every round reads
    and writes edges in the shared folder, so a lost executor repeats one round at most. A hub with a
    third of the edges is one row in the table of minima, and the join that uses it reads two stored
    tables, so adaptive execution can split the hub's partition. Loops and null ends are ignored.
    The driver sees two numbers a round. Raises if ``max_rounds`` is not enough; it never returns a
    partial result.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    star = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), kind)
    seen = _digest(star)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        around = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = around.groupBy("a").agg(F.min("b").alias("m"))
        lowest = stored(lowest.select(F.col("a").alias("b"), F.least("a", "m").alias("m")), kind)
        large = stored(star.join(lowest, "b").select("a", F.col("m").alias("b")).distinct(), kind)
        parent = stored(large.groupBy("a").agg(F.min("b").alias("m")), kind)
        hung = large.join(parent, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        used = star, lowest, large, parent
        star = stored(hung.unionByName(parent.select("a", F.col("m").alias("b"))).distinct(), kind)
        discard(*used)
        before, seen = seen, _digest(star)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = star.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
