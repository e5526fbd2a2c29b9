"""Toxicity from confirmed toxic texts and unlabelled ones: non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_crc, small_batches, stored, table
from .registry import query

#: Bytes that separate words: ASCII other than digits and letters; A-Z become a-z.
_FOLD = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


class Settings(NamedTuple):
    """Bounds of the fit; none of them depends on the size of the corpus."""

    positives: int = 3000  #: confirmed toxic texts, at most
    unlabelled: int = 6000  #: texts without use of their labels, at most
    least_texts: int = 4  #: features in fewer sample texts have no weight
    features: int = 4000  #: features kept, those whose shares among positive and unlabelled texts differ most clearly
    members: int = 3  #: classifiers, each without one part of the sample; their margins are averaged
    steps: int = 120
    rate: float = 0.05
    sparsity: float = 2e-4  #: soft threshold for each unit of step, so that most features weigh nothing


class Model(NamedTuple):
    weights: dict[bytes, float]
    offset: float


def features_of(text: str | None) -> set[bytes]:
    """The distinct words of a text and their beginnings of 4 to 8 bytes, as insults come with many endings."""
    words = set((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())
    out = set(words)
    for n in range(4, 9):
        out.update([w[:n] for w in words if len(w) > n])
    return out


class _Sparse(NamedTuple):
    """Texts as rows of word columns; presence only, so a long text is not toxic for being long."""

    row: np.ndarray
    column: np.ndarray
    n: int

    def margins(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.n)

    def pull(self, of_row: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, weights=of_row[self.row], minlength=width)


def _sparse(texts: list[np.ndarray]) -> _Sparse:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    column = np.concatenate(texts).astype(np.int64) if len(texts) else np.empty(0, np.int64)
    return _Sparse(np.repeat(np.arange(len(texts)), sizes), column, len(texts))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """One linear classifier by the non-negative risk with logistic loss.

    With l(z) = log(1 + exp(-z)) the risk is prior * E_p l(g) + max(0, E_u l(-g) - prior * E_p l(-g)): the
    unlabelled texts stand for all, and what the positives among them add to the negative part is taken
    off. Where the negative part falls below zero the fit has begun to learn single unlabelled texts, and
    the step goes up that part instead of down the risk.
    """
    p, u = _sparse(positive), _sparse(unlabelled)
    w, b = np.zeros(width + 1), 0.0  # the last weight is the offset
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    share = max(prior, 1e-6)
    w[-1] = np.log(share / (1 - min(share, 1 - 1e-6)))
    for step in range(1, s.steps + 1):
        gp, gu = p.margins(w) + w[-1], u.margins(w) + w[-1]
        sp, su = _sigmoid(gp), _sigmoid(gu)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        on_p, on_u = -prior * sp / p.n, su / u.n  # the negative part
        if negative >= 0:
            on_p = on_p - prior * (1 - sp) / p.n
        else:
            on_p, on_u = -on_p, -on_u
        grad = np.r_[p.pull(on_p, width) + u.pull(on_u, width), on_p.sum() + on_u.sum()]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = s.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w -= move
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - s.rate * s.sparsity / (np.sqrt(second[:-1] / (1 - 0.999**step)) + 1e-4), 0)
    return w[:-1], float(w[-1] + b)


def calibrate(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset that minimise the same risk in the margin alone; for logistic loss it is convex."""
    if not len(positive) or not len(unlabelled):
        return 1.0, 0.0
    x, w = np.c_[unlabelled, np.ones(len(unlabelled))], np.array([1.0, 0.0])
    pull = prior * np.array([positive.mean(), 1.0])
    ridge = np.diag([1e-3 * (np.var(unlabelled) + 1e-9), 1e-6])
    for _ in range(60):
        p = _sigmoid(x @ w)
        grad = x.T @ p / len(x) - pull + ridge @ (w - [1.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0.0)), float(w[1])


def _feature_sets(docs: DataFrame) -> DataFrame:
    """(role, features): each sample text's features."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(features_of(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.binary()))], names=["role", "features"])

    schema = T.StructType([T.StructField("role", T.StringType()), T.StructField("features", T.ArrayType(T.BinaryType()))])
    return docs.select("role", "text").mapInArrow(run, schema)


def _clearest(sets: DataFrame, n_p: int, n_u: int, s: Settings) -> dict[bytes, int]:
    """The kept features, numbered: counted in Spark, and only the chosen ones reach the driver."""
    each = sets.select("role", F.explode("features").alias("f")).groupBy("f").agg(
        F.count(F.when(F.col("role") == "positive", 1)).alias("p"), F.count(F.when(F.col("role") == "unlabelled", 1)).alias("u")
    )
    p, u = F.col("p") / n_p, F.col("u") / n_u
    clear = F.abs(p - u) / F.sqrt(p * (1 - p) / n_p + u * (1 - u) / n_u + 1e-9)
    best = each.where(F.col("p") + F.col("u") >= s.least_texts).orderBy(clear.desc(), "f").limit(s.features)
    return {f: n for n, f in enumerate(sorted(bytes(r.f) for r in best.select("f").collect()))}


def _coded(sets: DataFrame, vocabulary: dict[bytes, int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Positive and unlabelled texts as numbers of kept features, in an order that reruns share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [[vocabulary[f] for f in t.as_py() if f in vocabulary] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.list_(pa.int32()))], names=["role", "codes"])

    out: dict[str, list[list[int]]] = {"positive": [], "unlabelled": []}
    for r in sets.mapInArrow(run, "role string, codes array<int>").collect():
        out[r.role].append(r.codes)
    return tuple([np.array(t, dtype=np.int64) for t in sorted(texts)] for texts in out.values())


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on bounded samples: confirmed toxic rows of ``labels(doc_id, label)`` and unlabelled ``docs``.

    Both are the rows with the smallest hashes of their ids, so a rerun gives the same model. Labels are
    used twice: to confirm the positives, and for the class prior, the share of 1 among all given labels.
    Null ids, labels other than 0 and 1, and null texts are left out. Without positives every score is 0.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)")
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = toxic / n if n else 0.0

    def first(rows: DataFrame, most: int, role: str) -> list[tuple]:
        lot = F.xxhash64(F.lit(role), "doc_id")
        return [(r.doc_id, role) for r in rows.select("doc_id").orderBy(lot, "doc_id").limit(most).collect()]

    chosen = first(known.where("label = 1"), settings.positives, "positive")
    chosen += first(docs.where("doc_id IS NOT NULL"), settings.unlabelled, "unlabelled")
    wanted = spark.createDataFrame(chosen, "doc_id long, role string")
    # At most positives + unlabelled ids: a broadcast of bounded size.
    sample = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    sets = stored(_feature_sets(sample), "toxicity-sample")
    sizes = {r.role: r["count"] for r in sets.groupBy("role").count().collect()}
    n_p, n_u = sizes.get("positive", 0), sizes.get("unlabelled", 0)
    if n_p < 2 or n_u < 2:
        return Model({}, -35.0)
    vocabulary = _clearest(sets, n_p, n_u, settings)
    p, u = _coded(sets, vocabulary)
    if not vocabulary:
        return Model({}, -35.0)
    # Each member learns on two of three parts; the third part's margins calibrate the average.
    weights, offset, held_p, held_u = np.zeros(len(vocabulary)), 0.0, [], []
    parts = max(2, settings.members)
    for m in range(parts):
        own_p, own_u = [x for i, x in enumerate(p) if i % parts != m], [x for i, x in enumerate(u) if i % parts != m]
        w, b = train(own_p, own_u, len(vocabulary), prior, settings)
        weights += w / parts
        offset += b / parts
        held_p.append(_sparse(p[m::parts]).margins(w) + b)
        held_u.append(_sparse(u[m::parts]).margins(w) + b)
    slope, shift = calibrate(np.concatenate(held_p), np.concatenate(held_u), prior)
    kept = {w: float(weights[i] * slope) for w, i in vocabulary.items() if weights[i]}
    return Model(kept, offset * slope + shift)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` and ``score``: the estimated chance that the text is toxic.

    Whole texts are read; null and empty ones get the score of a text without any weighted feature.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "score"] if keep is None else keep
    source = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = model.weights, model.weights.keys()
        for batch in batches:
            found = [sum(weights[w] for w in known & features_of(t.as_py())) for t in batch.column(len(keep))]
            values = _sigmoid(np.array(found, dtype=float) + model.offset)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(values, pa.float64())], names=[*keep, "score"])

    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema)


@query("op1_nonnegative_pu")
def op1_nonnegative_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every whole text. Labels and unlabelled texts for the fit come from ids whose crc32 mod 3
    is not 1. Repeated rows each return a row; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    learn = id_crc("doc_id") % 3 != 1
    labels = table(spark, sf_dir, "labels").where(learn).select("doc_id", F.col("toxic").cast("int").alias("label"))
    model = fit(docs.where(learn), labels)
    return score(docs, model, ["doc_id"]).select(
        "doc_id",
        (id_crc("doc_id") % 3 == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )
