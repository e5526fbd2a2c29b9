"""Hard negatives by exact inner products, several candidates packed into one integer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, table
from .registry import query


class Settings(NamedTuple):
    positives: int = 5
    negatives: int = 3
    low: int = 50  #: a negative's score lies between these percents of the positive's
    high: int = 95
    rows: int = 8192  #: candidates of a block
    anchors: int = 4096  #: anchors of a block
    tile: int = 128  #: anchors whose scores with a block are held at once


class Packing(NamedTuple):
    """Fields of one wide integer: each holds a sum of products of biased, so never negative, components."""

    bias: int  #: added to every component
    bits: int  #: of a field
    fields: int
    exact_double: bool  #: the integer fits into a double's 53 bits, so a matrix product is exact

    @classmethod
    def plan(cls, width: int, largest: int) -> Packing:
        """Fields for components of at most ``largest`` in size. Where two fields do not fit into a double the
        carriers are Python integers of eight fields, of any length."""
        bits = max(1, (width * (2 * largest) ** 2).bit_length())
        fields = 53 // bits
        return cls(largest, bits, fields, True) if fields >= 2 else cls(largest, bits, 8, False)

    def pack(self, rows: np.ndarray) -> np.ndarray:
        """Carriers (groups of candidates, components) of ``rows`` (candidates, components)."""
        biased = rows + self.bias
        short = -len(rows) % self.fields
        biased = np.concatenate([biased, np.zeros((short, rows.shape[1]), dtype=np.int64)]).reshape(-1, self.fields, rows.shape[1])
        kind = np.int64 if self.exact_double else object
        carriers = np.zeros((len(biased), rows.shape[1]), dtype=kind)
        for j in range(self.fields):
            carriers += biased[:, j].astype(kind) * (1 << (self.bits * j))
        return carriers.astype(np.float64) if self.exact_double else carriers

    def products(self, anchors: np.ndarray, carriers: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Inner products (anchors, candidates); ``sums`` are the candidates' sums of components.

        An anchor's biased component meets a carrier in one multiplication for all its fields; the carriers'
        sums are taken apart and the bias is taken out again.
        """
        biased = anchors + self.bias
        total = biased.astype(carriers.dtype) @ carriers.T
        total = total.astype(np.int64) if self.exact_double else total
        mask = (1 << self.bits) - 1
        parts = [(total >> (self.bits * j)) & mask for j in range(self.fields)]
        scores = np.stack(parts, axis=2).reshape(len(anchors), -1)[:, : len(sums)]
        outside = self.bias * (anchors.sum(axis=1)[:, None] + sums[None, :]) + anchors.shape[1] * self.bias**2
        return (scores - outside).astype(np.int64)


_NONE = np.iinfo(np.int64).min


def leading(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` largest entries above ``_NONE``; of equal ones the first columns."""
    if scores.shape[1] > k:
        last = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
        above, level = scores > last, scores == last
        take = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    else:
        take = np.ones_like(scores, dtype=bool)
    return np.nonzero(take & (scores > _NONE))


def _first_of_runs(run: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first ``k`` of their run of equal values."""
    at = np.arange(len(run))
    start = np.maximum.accumulate(np.where(np.r_[True, run[1:] != run[:-1]], at, 0)) if len(run) else at
    return at - start < k


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


class _Block:
    """Candidates of one block in the order of their ids, packed once."""

    def __init__(self, rows: pa.Table, packing: Packing, width: int) -> None:
        rows = rows.sort_by("vec_id")
        self.ids, self.labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        components = _matrix(rows.column("vector"), width)
        self.carriers, self.sums, self.packing = packing.pack(components), components.sum(axis=1), packing

    def tiles(self, asks: pa.Table, width: int, step: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first anchor, scores, same label, the anchor's own row) for ``step`` anchors at a time."""
        ids, labels, components = asks.column("anchor_id").to_numpy(), asks.column("label").to_numpy(), _matrix(asks.column("vector"), width)
        for at in range(0, len(ids) if len(self.ids) else 0, step):
            to = slice(at, at + step)
            scores = self.packing.products(components[to], self.carriers, self.sums)
            yield at, scores, labels[to, None] == self.labels[None, :], ids[to, None] == self.ids[None, :]


def best_positives(block: _Block, asks: pa.Table, width: int, s: Settings) -> pa.Table:
    ids, out = asks.column("anchor_id").to_numpy(), [[np.empty(0, np.int64)] for _ in range(3)]
    for at, scores, same, own in block.tiles(asks, width, s.tile):
        i, j = leading(np.where(same & ~own, scores, _NONE), s.positives)
        for column, values in zip(out, (ids[at + i], block.ids[j], scores[i, j]), strict=True):
            column.append(values)
    return pa.table([pa.array(np.concatenate(c)) for c in out], names=["anchor_id", "vec_id", "score"])


def best_negatives(block: _Block, asks: pa.Table, width: int, s: Settings) -> pa.Table:
    """The first negatives of each (anchor, positive) in this block: the rows in any positive's band are taken
    out of the scores once, and each positive then chooses among them."""
    ids = asks.column("anchor_id").to_numpy()
    lists = asks.column("positives").combine_chunks()
    ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
    pairs = lists.flatten()
    positive, level = pairs.field("positive_id").to_numpy(), pairs.field("positive_score").to_numpy()
    # 100 * score >= low * level and <= high * level in whole numbers; Python integers do not overflow.
    low = np.array([-(-s.low * int(x) // 100) for x in level], dtype=np.int64)
    high = np.array([s.high * int(x) // 100 for x in level], dtype=np.int64)
    out = [[np.empty(0, np.int64)] for _ in range(5)]
    for at, scores, same, _ in block.tiles(asks, width, s.tile):
        own = range(at, at + len(scores))
        least = np.array([low[ends[a] : ends[a + 1]].min() for a in own])
        most = np.array([high[ends[a] : ends[a + 1]].max() for a in own])
        i, j = np.nonzero((scores >= least[:, None]) & (scores <= most[:, None]) & ~same)
        found = scores[i, j]
        order = np.lexsort((j, -found, i))
        i, j, found = i[order], j[order], found[order]
        for k in range(s.positives):
            p = ends[at + i] + k
            known = p < ends[at + i + 1]
            p = np.where(known, p, 0)
            fits = np.flatnonzero(known & (found >= low[p]) & (found <= high[p]))
            fits = fits[_first_of_runs(i[fits], s.negatives)]
            own_p = p[fits]
            for column, values in zip(out, (ids[at + i[fits]], positive[own_p], level[own_p], block.ids[j[fits]], found[fits]), strict=True):
                column.append(values)
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    return pa.table([pa.array(np.concatenate(c)) for c in out], names=names)


def hard_negatives(vectors: DataFrame, anchors: str, settings: Settings = Settings()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors(vec_id long, label
    long, vector array<long>)``; ``anchors`` is the condition that makes a row an anchor.

    Scores are exact integer inner products. An anchor's positives are its best other rows of its label, a
    positive's negatives the best rows of other labels in the band of its score; ties go to the smaller id.
    Every anchor meets every row, in blocks: the positives are found first and set the bands of the second
    meeting, and each block gives at most a positive's or negative's number of rows for an anchor, so
    nothing else is shuffled. Rows with a null id, label, vector or component take no part, nor do empty
    vectors or those of another length than most (the shorter of two equally common). Of rows with one
    vec_id that with the smallest label and vector counts. Components so large that a score might not fit
    a long raise an error. No anchors or positives give no rows.
    """
    spark, s = vectors.sparkSession, settings
    small_batches(spark, 2048)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    own = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "vector").where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL) AND size(vector) > 0"
    )
    common = own.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if common is None:
        return spark.createDataFrame([], schema)
    width = common.width
    first = F.row_number().over(Window.partitionBy("vec_id").orderBy("label", "vector"))
    own = own.where(F.size("vector") == width).withColumn("nth", first).where("nth = 1").drop("nth")
    own = stored(own, "negatives-vectors")
    size = F.array_max(F.transform("vector", F.abs))
    n, asked, largest = own.agg(F.count("*"), F.count(F.when(F.expr(anchors), 1)), F.max(size)).first()
    largest = max(1, largest)
    if width * largest**2 * max(100, s.high) >= 1 << 63:
        raise ValueError(f"components of size {largest} may give scores beyond a long")
    packing = Packing.plan(width, largest)
    row_blocks, ask_blocks = -(-n // s.rows), -(-max(1, asked) // s.anchors)

    def every(blocks: int) -> Callable:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    keys = ["row_block", "ask_block"]
    left = own.withColumn("row_block", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int")).withColumn("ask_block", every(ask_blocks))
    # New names for the same columns, as both sides of the meeting come from one table.
    right = own.where(anchors).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("label"), F.col("vector").alias("vector"))
    right = right.withColumn("ask_block", F.pmod(F.xxhash64("anchor_id"), F.lit(ask_blocks)).cast("int"))

    def meet(asks: DataFrame, kernel: Callable, out: str) -> DataFrame:
        def run(rows: pa.Table, block_asks: pa.Table) -> pa.Table:
            return kernel(_Block(rows, packing, width), block_asks, width, s)

        asks = asks.withColumn("row_block", every(row_blocks))
        return left.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(run, out)

    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    positives = meet(right, best_positives, "anchor_id long, vec_id long, score long").withColumn("rank", rank).where(F.col("rank") <= s.positives)
    pair = F.struct(F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    bands = stored(positives.groupBy("anchor_id").agg(F.collect_list(pair).alias("positives")), "negatives-positives")
    found = meet(right.join(bands, "anchor_id"), best_negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    best = found.withColumn("rank", place).where(F.col("rank") <= s.negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""


@query("op13_packed_products", SQL)
def op13_packed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vec_id divisible by 50 among all vectors, components in steps of 1/256."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table(spark, sf_dir, "embeddings").where(finite).select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform(v, lambda x: F.floor(256 * x.cast("double"))).alias("vector"),
    )
    return hard_negatives(rows, "vec_id % 50 = 0")
