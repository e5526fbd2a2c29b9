"""Documents that hold benchmark items, with up to a given share of edits."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table
from .registry import query

_GAP = re.compile(r"[\W_]+")


class Settings(NamedTuple):
    error_rate: float = 0.05  #: edits allowed for each normalised character of an item
    least_chars: int = 25  #: shorter items are searched without edits and as whole words
    block_chars: int = 400_000  #: characters of items searched in one pass over the documents


def normalised(text: str | None) -> str:
    """Lower case, with every run of characters that are no letters or digits as one space."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces with their places: whoever holds the item with so few edits holds one piece exactly."""
    n = errors + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern(NamedTuple):
    item_id: int | None
    text: str
    errors: int
    masks: dict[str, int]
    whole: bool = False  #: stands as whole words only


def pattern(item_id: int | None, text: str, rate: float) -> Pattern:
    masks: dict[str, int] = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << i
    return Pattern(item_id, text, int(rate * len(text)), masks)


def best_end(masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to a pattern; the first such end.

    Myers' bit-parallel recurrence: one integer holds which differences in a column are +1, another
    which are -1, so a text character costs a few word operations whatever the pattern's length.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, distance = full, 0, length
    best, end = length, 0
    for at, c in enumerate(text, 1):
        match = masks.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        if distance < best:
            best, end = distance, at
    return best, end


class Match(NamedTuple):
    item_id: int | None
    distance: int
    start: int
    stop: int


class Searcher:
    """Finds the items of one block in normalised text."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, least_chars: int = Settings().least_chars) -> None:
        self.patterns = [pattern(i, t, rate if len(t) >= least_chars else 0.0)._replace(whole=len(t) < least_chars) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, p in enumerate(self.patterns):
            for at, piece in [(-1, f" {p.text} ")] if p.whole else pieces(p.text, p.errors):
                where.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str) -> list[Match]:
        """The best match of each item, by distance and then place."""
        if self.empty or not text:
            return []
        starts: dict[int, set[int]] = {}
        # A space on either side, for items that must stand as whole words.
        for last, (length, places) in self.automaton.iter(f" {text} "):
            for n, at in places:
                starts.setdefault(n, set()).add(last - length - at)
        found = []
        for n, begins in starts.items():
            match = self._verify(self.patterns[n], text, sorted(begins))
            if match:
                found.append(match)
        return found

    @staticmethod
    def _verify(p: Pattern, text: str, begins: list[int]) -> Match | None:
        for at in begins:
            if at >= 0 and text.startswith(p.text, at):
                return Match(p.item_id, 0, at, at + len(p.text))
        best: Match | None = None
        i = 0
        while i < len(begins):  # windows that overlap are one window
            low, high = begins[i] - p.errors, begins[i] + len(p.text) + p.errors
            while i < len(begins) and begins[i] - p.errors <= high:
                high = begins[i] + len(p.text) + p.errors
                i += 1
            low = max(0, low)
            window = text[low:high]
            distance, end = best_end(p.masks, len(p.text), window)
            if distance <= p.errors and (best is None or distance < best.distance):
                mirrored = pattern(None, p.text[::-1], 0)
                _, back = best_end(mirrored.masks, len(p.text), window[:end][::-1][: len(p.text) + p.errors])
                best = Match(p.item_id, distance, low + end - back, low + end)
        return best


def _item_blocks(items: DataFrame, settings: Settings) -> Iterator[list[tuple[int | None, str]]]:
    """Blocks of normalised items, each bounded; the driver holds one block at a time."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // settings.block_chars))
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).select("item_id", "text").collect()
        texts = sorted({(r.item_id is None, r.item_id, normalised(r.text)) for r in rows}, key=str)
        yield [(i, t) for _, i, t in texts if t]


def matches(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), key: str = "doc_id") -> DataFrame:
    """(key, item_id, distance, start, stop): each document row's best match of each item it holds.

    ``items(item_id, text)`` is searched block by block against all documents, which are read once for
    each block and never shuffled. Distances and places are those of normalised text. Every match within
    the item's error budget is found: with budget e an item is cut into e + 1 pieces, one of which must
    stand in the document unchanged. Items shorter than ``least_chars`` have no budget and must stand as whole
    words. Null and empty texts hold nothing, items without letters or digits are in no text; repeated rows
    and items each give their rows.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key), F.col("text").alias("__text"))
    schema = T.StructType(
        [source.schema[key], T.StructField("item_id", T.LongType())]
        + [T.StructField(c, T.IntegerType()) for c in ("distance", "start", "stop")]
    )
    out = None
    for block in _item_blocks(items, settings):
        found = source.mapInArrow(_matching(block, settings, schema), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _matching(block: list, settings: Settings, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(block, settings.error_rate, settings.least_chars)
        for batch in batches:
            rows, found = [], []
            for n, text in enumerate(batch.column(1)):
                own = searcher.find(normalised(text.as_py()))
                rows += [n] * len(own)
                found += own
            if found:
                ids = batch.column(0).take(pa.array(rows, pa.int32()))
                item, distance, start, stop = zip(*found, strict=True)
                columns = [ids, pa.array(item, pa.int64()), *(pa.array(c, pa.int32()) for c in (distance, start, stop))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; rows pass through in place, without a shuffle."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for block in _item_blocks(items, settings):
        docs = docs.mapInArrow(_clean(block, settings, at), docs.schema)
    return docs


def _clean(block: list, settings: Settings, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(block, settings.error_rate, settings.least_chars)
        for batch in batches:
            keep = [not searcher.find(normalised(t.as_py())) for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


@query("op4_pigeonhole_decontamination")
def op4_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item, its edit distance and its place."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
