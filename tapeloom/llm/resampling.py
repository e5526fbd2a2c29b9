"""Importance resampling towards a target: n-gram buckets from an Aho-Corasick dictionary of words."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from typing import NamedTuple
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, small_batches, stored, table
from .registry import query


class Settings(NamedTuple):
    buckets: int = 10_000
    longest: int = 3  #: words of the longest feature
    least_words: int = 20  #: documents with fewer words are scored but not drawn
    percent: int = 5  #: of the documents long enough
    seed: int = 42
    block_bytes: int = 8 << 20  #: bytes of text that share a dictionary of their words


# Word bytes stay (letters in lower case), all others are delimiters; bytes above 127 belong to words.
_FOLD = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_END = b"\x01"  # stands between two texts like a word; no text holds it after folding


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


class Shift:
    """What a CRC32 becomes when zero bytes follow: a linear map, as four lookups by the bytes of the CRC."""

    SHORT = 64

    def __init__(self) -> None:
        step = _byte_table()
        one = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
        maps = [one]
        for _ in range(self.SHORT):
            maps.append((maps[-1] >> 8) ^ step[maps[-1] & 255])
        self.short = np.stack(maps[: self.SHORT])
        self.squares = [maps[self.SHORT]]  # 64, 128, 256, ... bytes

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        low = length & (self.SHORT - 1)
        out = self.short[low, 0, crc & 255]
        for k in range(1, 4):
            out ^= self.short[low, k, crc >> (8 * k) & 255]
        far, power = length // self.SHORT, 0
        while (far >> power).any():
            if power == len(self.squares):
                last = self.squares[-1]
                self.squares.append(self._apply(last, last))
            at = np.flatnonzero(far >> power & 1)
            out[at] = self._apply(self.squares[power], out[at])
            power += 1
        return out

    @staticmethod
    def _apply(maps: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return maps[0, crc & 255] ^ maps[1, crc >> 8 & 255] ^ maps[2, crc >> 16 & 255] ^ maps[3, crc >> 24]


class Dictionary:
    """An automaton of delimiter-bounded words; each carries its CRC32 and its length in bytes."""

    def __init__(self, words: set[bytes]) -> None:
        self.words = words
        known = [_END, *sorted(words)]
        self.crc = np.array([crc32(w) for w in known], dtype=np.uint32)
        self.length = np.array([len(w) for w in known], dtype=np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, word in enumerate(known):
            self.automaton.add_word(f" {word.decode('latin-1')} ", n)
        self.automaton.make_automaton()

    def scan(self, stream: str) -> np.ndarray:
        """Numbers of the words of ``stream`` in their order; two neighbours share the delimiter between them."""
        return np.fromiter((n for _, n in self.automaton.iter(stream)), dtype=np.int64)


class Features:
    """Buckets of all word runs of blocks of texts."""

    def __init__(self, s: Settings) -> None:
        self.s, self.shift, self.dictionary = s, Shift(), Dictionary(set())

    def block(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Words of each text, and for each run length (text number, bucket) of all runs of that many words.

        A run's CRC comes from those of the run without its last word and of that word: the first is moved
        on by a space and the word's length, so no run's bytes are put together or read. Words are split as
        bytes: a string would also be split at 0x85 and 0xA0, which are parts of letters here.
        """
        folded = [(t or b"").translate(_FOLD).split() for t in texts]
        words = set().union(*folded) if folded else set()
        if not words <= self.dictionary.words:
            self.dictionary = Dictionary(words)
        stream = b" %b " % b" ".join([b" ".join([*w, _END]) for w in folded])
        seen = self.dictionary.scan(stream.decode("latin-1"))
        of = np.cumsum(seen == 0) - (seen == 0)
        own, length = self.dictionary.crc[seen], self.dictionary.length[seen]
        real, space = seen != 0, np.uint32(crc32(b" "))
        counts = np.bincount(of[real], minlength=len(texts))
        crc, valid, out = own, real, []
        one = np.ones(1, dtype=np.int64)
        for n in range(self.s.longest):
            if n:
                crc = self.shift(self.shift(crc[:-1], np.broadcast_to(one, len(crc) - 1)) ^ space, length[n:]) ^ own[n:]
                valid = valid[:-1] & real[n:]
            out.append((of[: len(crc)][valid], (crc[valid] % np.uint32(self.s.buckets)).astype(np.int64)))
            if len(crc) < 2:
                break
        return counts, out


def _blocks(batches: Iterator[pa.RecordBatch], at: int, most: int) -> Iterator[tuple[list[pa.RecordBatch], list[bytes | None]]]:
    held, texts, size = [], [], 0
    for batch in batches:
        own = batch.column(at).cast(pa.binary()).to_pylist()
        held.append(batch)
        texts += own
        size += sum(len(t) for t in own if t)
        if size >= most:
            yield held, texts
            held, texts, size = [], [], 0
    if held:
        yield held, texts


def bucket_counts(texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(bucket, n): how many features of ``texts(text)`` fall into each bucket that has any.

    A task adds up its own buckets and gives one row for each.
    """
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(settings), np.zeros(settings.buckets, dtype=np.int64)
        for _, block in _blocks(batches, 0, settings.block_bytes):
            for _, buckets in features.block(block)[1]:
                total += np.bincount(buckets, minlength=settings.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Each bucket's gain, 1000 times the log of its smoothed share in the target over that in the corpus,
    rounded down. At most two numbers a bucket reach the driver."""
    sides = bucket_counts(docs, settings).select("bucket", "n", F.lit(0).alias("side"))
    sides = sides.unionByName(bucket_counts(target, settings).select("bucket", "n", F.lit(1).alias("side")))
    counts = np.zeros((2, settings.buckets))
    for row in sides.collect():
        counts[row.side, row.bucket] = row.n
    (s, t), m = counts, float(settings.buckets)
    total_s, total_t = s.sum() + m, t.sum() + m
    return np.array([floor(1000 * log((b + 1) * total_s / ((a + 1) * total_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], dtype=np.int64)


def with_weights(docs: DataFrame, gains: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row of ``docs(doc_id, text)``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(settings)
        for held, block in _blocks(batches, 1, settings.block_bytes):
            words, runs = features.block(block)
            number, weight = np.zeros(len(block), dtype=np.int64), np.zeros(len(block), dtype=np.int64)
            for of, buckets in runs:
                number += np.bincount(of, minlength=len(block))
                weight += np.bincount(of, weights=gains[buckets], minlength=len(block)).astype(np.int64)
            ids = pa.concat_arrays([b.column(0) for b in held])
            yield pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(number), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _noise(seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance_ranks(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of ``docs(doc_id, text)``, drawn towards ``target(text)``.

    ``weight`` sums the gains of a document's features, ``score`` adds a Gumbel variate from a hash of its
    id, so the highest scores are a draw without replacement; drawn rows are numbered, others have no rank.
    Texts are scanned twice, once to count and once to weigh, each block of texts with an automaton of its
    own distinct words, so there is no bound on the vocabulary. Null and empty texts have no features and
    weight 0; a null id counts as an empty one; repeated rows are rows of their own. Only the narrow
    scores are sorted, over all tasks.
    """
    weighed = with_weights(docs, bucket_gains(docs, target, settings), settings)
    rows = stored(weighed.withColumn("score", F.col("weight") + _noise(settings.seed)), "resampling-scores")
    enough = F.col("n_words") >= settings.least_words
    drawn = settings.percent * rows.where(enough).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = ranked(rows.where(enough), order, "resampling-order", "place").withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.select(*columns).unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")).select(*columns))


SQL = r"""WITH src AS (SELECT 0 AS side, row_number() OVER () AS uid, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM src),
f AS (SELECT side, uid, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS feature FROM w),
g AS (SELECT side, uid, feature, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM g)),
b AS (SELECT feature, list_transform(range(0, 4 * len(h)), lambda i: (strpos('0123456789ABCDEF', h[(i // 8) * 2 + 2 - ((i % 8) // 4)]) - 1) >> CAST(i % 4 AS INTEGER) & 1) AS bits FROM h),
c AS (SELECT feature, xor(list_reduce(list_prepend(4294967295, bits), lambda x, y: xor(x >> 1, 3988292384 * (xor(x, y) & 1))), 4294967295) % 10000 AS bucket FROM b),
k AS (SELECT side, uid, bucket, sum(n) AS n FROM g JOIN c USING (feature) GROUP BY ALL),
s AS (SELECT bucket, sum(n) FILTER (WHERE side = 0) AS s, sum(n) FILTER (WHERE side = 1) AS t FROM k GROUP BY 1),
z AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM s),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s, z),
d AS (SELECT uid, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM k JOIN gain USING (bucket) WHERE side = 0 GROUP BY 1),
o AS (SELECT uid, doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST('0x' || left(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS h FROM w LEFT JOIN d USING (uid) WHERE side = 0),
q AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE words >= 20) OVER () AS n FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM r"""


@query("op12_word_dictionary", SQL)
def op12_word_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark texts, and the twentieth of them that is drawn."""
    return importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def resampled(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` with a drawn ``doc_id``, whole; ids must be unique for an exact number of rows."""
    drawn = importance_ranks(docs, target, settings).where("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(stored(drawn, "resampling-drawn"), F.col("doc_id").eqNullSafe(F.col("__drawn")), "left_semi")
