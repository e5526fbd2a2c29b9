"""Quality by compression: a text is like the labelled texts whose dictionary makes it small."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_crc, small_batches, stored, table
from .registry import query


class Settings(NamedTuple):
    """Bounds of the fit and shape of the score; none of them depends on the size of the corpus."""

    per_class: int = 2000  #: labelled texts of a class behind its dictionary, at most
    calibration: int = 4000  #: other labelled texts that calibrate the score, at most
    piece_chars: int = 2000  #: what a dictionary text gives, from a place its id decides
    dictionary_bytes: int = 65536
    block_bytes: int = 1000  #: whole texts are compressed block by block, so the dictionary counts all through
    level: int = 3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    offset: float
    settings: Settings


def size_difference(text: str | None, good, bad, block: int) -> float:
    """(compressed with the bad dictionary - with the good one) / bytes, over all blocks of the text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return 0.0
    more = 0
    for at in range(0, len(raw), block):
        part = raw[at : at + block]
        more += len(bad.compress(part)) - len(good.compress(part))
    return more / len(raw)


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=level)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=data)


def _dictionary(pieces: list[bytes], settings: Settings) -> bytes:
    """A trained dictionary; the pieces themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(settings.dictionary_bytes, pieces, level=settings.level).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-settings.dictionary_bytes :]


def _differences(texts: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    small_batches(texts.sparkSession)
    source = texts.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = (_compressor(d, model.settings.level) for d in (model.good, model.bad))
        for batch in batches:
            found = [size_difference(t.as_py(), good, bad, model.settings.block_bytes) for t in batch.column(len(keep))]
            columns = [*batch.columns[: len(keep)], pa.array(found, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "__difference"])

    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField("__difference", T.DoubleType())])
    return source.mapInArrow(run, schema)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps; a small ridge keeps separable data finite."""
    w, design = np.zeros(2), np.c_[x, np.ones(len(x))]
    ridge = np.array([1e-4, 1e-4]) * max(1, len(x)) * np.array([np.var(x) + 1e-9, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge), design.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on a bounded sample of ``labels(doc_id, label)``, whose texts are looked up in ``docs``.

    Dictionaries are built from up to ``per_class`` texts of each label, taken from one half of the labelled
    ids; the score is calibrated on up to ``calibration`` rows of the other half, in their natural proportion. Samples are the rows with the smallest hashes of their ids,
    so a rerun gives the same model. Rows without a text or a label of 0 or 1 are left out. With no usable
    labels every score is one half.
    """
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").select("doc_id", F.col("label").cast("int"))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))

    def first(rows: DataFrame, n: int, role: str) -> list[tuple]:
        lot = F.xxhash64(F.lit(role), "doc_id")
        return [(r.doc_id, r.label, role) for r in rows.orderBy(lot, "doc_id", "label").limit(n).collect()]

    chosen = first(known.where(half == 1), settings.calibration, "calibration")
    for label in (0, 1):
        chosen += first(known.where((half == 0) & (F.col("label") == label)), settings.per_class, "dictionary")
    spark = docs.sparkSession
    wanted = spark.createDataFrame(chosen, "doc_id long, label int, role string")
    # At most 2 * per_class + calibration ids: a broadcast of bounded size.
    sample = stored(docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(wanted), "doc_id"), "quality-sample")
    start = 1 + F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - settings.piece_chars)).cast("int")
    pieces = sample.where("role = 'dictionary'").select("label", F.expr("text").substr(start, F.lit(settings.piece_chars)).alias("p"))
    rows = sorted((r.label, r.p.encode("utf-8", "surrogatepass")) for r in pieces.collect())
    good, bad = (_dictionary([p for label, p in rows if label == c and p], settings) for c in (1, 0))
    model = Model(good, bad, 0.0, 0.0, settings)
    found = _differences(sample.where("role = 'calibration'"), model, ["label"]).collect()
    if found:
        found = sorted((r["__difference"], r["label"]) for r in found)
        slope, offset = _logistic(np.array([x for x, _ in found]), np.array([y for _, y in found], dtype=float))
        model = model._replace(slope=slope, offset=offset)
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` and ``score`` (0 to 1, higher is better). Null and empty texts have no
    difference and get the score of a text that neither dictionary favours."""
    keep = [c for c in docs.columns if c != "score"] if keep is None else keep
    found = _differences(docs, model, keep)
    value = 1 / (1 + F.exp(-(F.col("__difference") * model.slope + model.offset)))
    return found.select(*keep, value.alias("score"))


def training_labels(labels: DataFrame) -> DataFrame:
    """Rows whose crc32(doc_id) mod 5 is not 0."""
    return labels.where(id_crc("doc_id") % 5 != 0).select("doc_id", F.col("quality").alias("label"))


#: Documents below this score are rejected.
ACCEPT = 0.3


@query("op10_compression_quality")
def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every whole text; repeated rows each return a row, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    return score(docs, model, ["doc_id"]).select(
        "doc_id",
        (id_crc("doc_id") % 5 == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows the classifier rejects."""
    model = fit(docs, training_labels(labels))
    return score(docs.withColumnRenamed("score", "__score"), model).where(F.col("score") >= ACCEPT).drop("score").withColumnRenamed("__score", "score")
