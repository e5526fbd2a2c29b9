"""Nearest vectors by inner product: a forest of random-projection trees and an exact rerank."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored, table
from .registry import query


class Settings(NamedTuple):
    trees: int = 8
    depth: int = 5  #: levels of a tree, fewer where leaves would hold less than ``leaf_rows`` vectors
    leaf_rows: int = 64
    probes: float = 0.18  #: share of all leaves a query visits
    sample: int = 20_000  #: vectors the trees are built on, at most; all vectors are indexed
    chunk: int = 20_000  #: vectors or queries of a leaf that meet in one task, at most
    seed: int = 11


class Forest(NamedTuple):
    """Hyperplanes of complete binary trees, level by level: ``normals[tree, node]`` and ``cuts[tree, node]``."""

    normals: np.ndarray
    cuts: np.ndarray
    depth: int

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(vectors), len(self.normals)), dtype=np.int32)
        for t, (normals, cuts) in enumerate(zip(self.normals, self.cuts, strict=True)):
            side, node = vectors @ normals.T > cuts, np.zeros(len(vectors), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + side[np.arange(len(vectors)), node]
            out[:, t] = node - (2**self.depth - 1)
        return out

    def visits(self, queries: np.ndarray, sizes: np.ndarray, probes: int, rows: int) -> Iterator[list[tuple[int, int]]]:
        """For each query the (tree, leaf) pairs to visit, by one priority queue over all trees.

        A branch's priority is the least margin by which the query lies on its side of the planes above
        it. Leaves are taken from the queue until there are ``probes`` and they hold ``rows`` vectors.
        """
        first_leaf = 2**self.depth - 1
        for q in queries:
            margins = self.normals @ q - self.cuts if self.depth else None
            queue = [(-np.inf, t, 0) for t in range(len(self.normals))]
            taken, held = [], 0
            while queue and (len(taken) < probes or held < rows):
                ahead, t, node = heapq.heappop(queue)
                if node >= first_leaf:
                    n = int(sizes[t, node - first_leaf])
                    if n:
                        taken.append((t, node - first_leaf))
                        held += n
                    continue
                m = margins[t, node]
                heapq.heappush(queue, (max(ahead, m), t, 2 * node + 1))
                heapq.heappush(queue, (max(ahead, -m), t, 2 * node + 2))
            yield taken


def build_forest(sample: np.ndarray, s: Settings, depth: int) -> Forest:
    """Each plane is normal to the difference of two sample vectors of its node and halves them."""
    rng = np.random.default_rng(s.seed)
    width, nodes = sample.shape[1], 2**depth - 1
    normals, cuts = np.zeros((s.trees, max(1, nodes), width)), np.zeros((s.trees, max(1, nodes)))
    for t in range(s.trees):
        rows_of = {0: np.arange(len(sample))}
        for node in range(nodes):
            rows = rows_of.pop(node)
            plane = np.zeros(width)
            if len(rows) > 1:
                a, b = rng.choice(rows, 2, replace=False)
                plane = sample[a] - sample[b]
            if not plane.any():
                plane = rng.standard_normal(width)
            plane /= np.linalg.norm(plane)
            along = sample[rows] @ plane
            cut = float(np.median(along)) if len(rows) else 0.0
            normals[t, node], cuts[t, node] = plane, cut
            rows_of[2 * node + 1], rows_of[2 * node + 2] = rows[along <= cut], rows[along > cut]
    return Forest(normals, cuts, depth)


def usable(vector: str) -> Column:
    """Vectors that are not null or zero and have finite components only."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors(vec_id, vector)`` with the largest inner
    product for each row of ``queries(query_id, vector)``, other than the row with the query's own id.

    The search is approximate: a vector is found if one of the visited leaves holds it. Inner products
    become angles by one more coordinate, sqrt(M^2 - |x|^2) with M the longest norm, so that the trees cut
    by what is asked for. Every vector is indexed in every tree; of equal vectors the ``k`` + 1 smallest
    ids are kept, as no others can be among the nearest. Leaves meet their queries as matrices, cut into
    chunks of rows and of queries, so neither a full leaf nor a popular one is one task's work. Scores are
    sums of double products of the original components, ties go to the smaller id.
    Unusable vectors and those of another length than most take no part. No usable vector gives no rows.
    """
    spark, s = vectors.sparkSession, settings
    small_batches(spark, 2048)
    own = vectors.where(usable("vector") & F.col("vec_id").isNotNull()).select("vec_id", "vector")
    own = own.withColumn("width", F.size("vector"))
    common = own.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    width = common.width
    same = Window.partitionBy("vector").orderBy("vec_id")
    own = own.where(F.col("width") == width).select("vec_id", "vector", F.row_number().over(same).alias("copy"))
    own = stored(own.where(F.col("copy") <= k + 1).drop("copy"), "neighbours-vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, longest = own.agg(F.count("*"), F.max(square)).first()
    lot = F.xxhash64(F.lit(s.seed), "vec_id")
    sample = _matrix(own.orderBy(lot, "vec_id").limit(s.sample).select("vector").toArrow().column(0), width)
    sample = np.c_[sample, np.sqrt(np.maximum(longest - (sample**2).sum(axis=1), 0))]
    depth = max(0, min(s.depth, int(np.log2(max(1, n / s.leaf_rows)))))
    forest = build_forest(sample, s, depth)

    dealt = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("leaf", T.IntegerType()), *own.schema.fields])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), width)
            x = np.c_[x, np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0))]
            leaves = forest.leaves(x)
            for t in range(s.trees):
                tree = pa.array(np.full(len(x), t, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([tree, pa.array(leaves[:, t]), *batch.columns], names=dealt.names)

    members = stored(own.mapInArrow(route, dealt), "neighbours-leaves")
    sizes = np.zeros((s.trees, 2**depth), dtype=np.int64)
    for r in members.groupBy("tree", "leaf").count().collect():  # trees * leaves rows
        sizes[r.tree, r["leaf"]] = r["count"]

    probes = max(1, int(np.ceil(s.probes * s.trees * 2**depth)))
    ask = queries.where(usable("vector") & (F.size("vector") == width) & F.col("query_id").isNotNull()).select("query_id", "vector")
    asked = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("leaf", T.IntegerType()), *ask.schema.fields])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1), width)
            q = np.c_[q, np.zeros(len(q))]
            pairs = [(i, t, leaf) for i, found in enumerate(forest.visits(q, sizes, probes, s.trees * (k + 1))) for t, leaf in found]
            for at in range(0, len(pairs), 8192):
                i, t, leaf = np.array(pairs[at : at + 8192], dtype=np.int32).T
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(leaf), *(c.take(pa.array(i)) for c in batch.columns)], names=asked.names)

    visits = stored(ask.mapInArrow(visit, asked), "neighbours-visits")
    # A leaf of many vectors, or one that many queries visit, is several pairs of chunks.
    load = visits.groupBy("tree", "leaf").count().collect()  # trees * leaves rows
    pieces = [(r.tree, r["leaf"], -(-int(sizes[r.tree, r["leaf"]]) // s.chunk), -(-r["count"] // s.chunk)) for r in load]
    cut = F.broadcast(spark.createDataFrame(pieces, "tree int, leaf int, rows int, asks int"))
    keys = ["tree", "leaf", "row_chunk", "ask_chunk"]

    def chunks(of: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), of - 1))

    left = members.join(cut, ["tree", "leaf"]).withColumn("row_chunk", F.pmod(F.xxhash64("vec_id"), "rows").cast("int"))
    left = left.withColumn("ask_chunk", chunks(F.col("asks"))).select(*keys, "vec_id", "vector")
    right = visits.join(cut, ["tree", "leaf"]).withColumn("ask_chunk", F.pmod(F.xxhash64("query_id"), "asks").cast("int"))
    right = right.withColumn("row_chunk", chunks(F.col("rows"))).select(*keys, "query_id", "vector")

    def rerank(rows: pa.Table, asks: pa.Table) -> pa.Table:
        ids, x = rows.column("vec_id").to_numpy(), _matrix(rows.column("vector"), width)
        by, q = asks.column("query_id").to_numpy(), _matrix(asks.column("vector"), width)
        out: list[list] = [[], [], []]
        for at in range(0, len(q) if len(x) else 0, 256):
            scores = q[at : at + 256] @ x.T
            scores[by[at : at + 256, None] == ids[None, :]] = -np.inf
            last = np.partition(scores, max(0, scores.shape[1] - k), axis=1)[:, max(0, scores.shape[1] - k)]
            near = (scores >= (last - 1e-9 * np.maximum(1, np.abs(last)))[:, None]) & (scores > -np.inf)
            i, j = np.nonzero(near)
            out[0].append(by[at + i])
            out[1].append(ids[j])
            out[2].append((x[j] * q[at + i]).sum(axis=1))  # row by row, so equal vectors get equal scores
        columns = [np.concatenate(c) if c else np.empty(0) for c in out]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c).cast(t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k).distinct()
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query("op2_projection_forest")
def op2_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vec_id divisible by 20, against all other vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(rows, rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"))
