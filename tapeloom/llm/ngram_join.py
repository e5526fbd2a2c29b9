"""Documents with nearly equal shingle sets: count vectors in R-trees, bounded by summed minima."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, ranked, small_batches, stored, table
from .components import connected_components
from .registry import query


class Settings(NamedTuple):
    words: int = 3  #: of a shingle
    share: int = 90  #: two sets link when 100 * intersection >= share * union
    groups: int = 64  #: counts of a point
    fanout: int = 8  #: entries of a tree node
    tile_shingles: int = 250_000  #: shingles that one side of a task holds, but for a single longer document
    longest: int = 1 << 40  #: shingles of a document, an end for the table of size classes


# ---- shingle sets -------------------------------------------------------------------------------


class _Hashes(dict):
    """XXH64 of words, each computed once a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, words: int, hashes: dict) -> np.ndarray:
    """The distinct word shingles of a text as ascending 64-bit hashes; all its words are one, if there are fewer."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    own = np.array([hashes[t] for t in tokens], dtype=np.uint64)
    run = min(words, len(own))
    value = np.full(len(own) - run + 1, run, dtype=np.uint64)
    for k in range(run):
        value = _mixed(value * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - run + 1 + k])
    return np.unique(value)


# ---- dealing ------------------------------------------------------------------------------------
# Sets of at most U shingles that link differ in at most D = 2 U (100 - share) / (100 + share) shingles. Deal
# all shingles by hash into 2 (D + 1) bands: two linked sets have equal contents in all bands but D. So in any
# order of (band, contents) that both follow, their first D + 1 bands have one in common. Fullest bands come
# first, so that what is in common is long. Classes of sizes fix U: a set counts in its own class and as the
# smaller partner in the next one.


@lru_cache
def size_classes(share: int, longest: int) -> tuple[int, ...]:
    """Upper ends of the size classes: the smaller of two linked sets lies in the class of the larger or the one before."""
    ends = [1]
    while ends[-1] < longest:
        ends.append(max(ends[-1] + 1, -(-ends[-1] * 100 // share)))
    return tuple(ends)


def most_differences(size: int, share: int) -> int:
    return 2 * size * (100 - share) // (100 + share)


def band_keys(shingles: np.ndarray, s: Settings) -> np.ndarray:
    """One of these keys, at least, is shared by any two different sets that link."""
    if not len(shingles):
        return np.empty(0, dtype=np.uint64)
    ends = size_classes(s.share, s.longest)
    own, out = bisect_left(ends, len(shingles)), []
    for size_class in (own, own + 1):
        differ = most_differences(ends[size_class], s.share)
        if not differ:
            continue
        bands = 2 * (differ + 1)
        band = _mixed(shingles + np.uint64(size_class)) % np.uint64(bands)
        order = np.argsort(band, kind="stable")
        start = np.searchsorted(band[order], np.arange(bands, dtype=np.uint64))
        full = np.diff(np.r_[start, len(shingles)])
        contents = np.r_[np.uint64(0), np.cumsum(_mixed(shingles[order] ^ np.uint64(size_class * 0x632BE5AB)), dtype=np.uint64)]
        contents = contents[start + full] - contents[start]
        token = _mixed(contents + _mixed(np.arange(bands, dtype=np.uint64) + np.uint64(size_class << 32)))
        out.append(token[np.lexsort((token, -full))[: differ + 1]])
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def text_key() -> Column:
    """What tells texts apart without reading them again; a null text counts as an empty one."""
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def with_keys(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, uid, same_text, n_shingles, digest, keys) of ``docs(doc_id, text)``; no digest for an empty set."""
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), text_key().alias("same_text"), F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), s.words, hashes) for t in batch.column(3).cast(pa.binary())]
            digests = [hashlib.md5(x.tobytes()).digest() if len(x) else None for x in sets]
            keys = [band_keys(x, s).view(np.int64) for x in sets]
            columns = [*batch.columns[:3], pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "uid", "same_text", "n_shingles", "digest", "keys"])

    kept = [source.schema["doc_id"].simpleString().replace(":", " ", 1), "uid long", "same_text string"]
    return source.mapInArrow(run, ", ".join([*kept, "n_shingles long, digest binary, keys array<long>"]))


# ---- the tree -----------------------------------------------------------------------------------


def count_vectors(sets: list[np.ndarray], groups: int) -> np.ndarray:
    """How many shingles of each set fall into each group."""
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    group = (_mixed(np.concatenate(sets)) % np.uint64(groups)).astype(np.int64)
    return np.bincount(of * groups + group, minlength=len(sets) * groups).reshape(-1, groups).astype(np.int32)


class CountTree:
    """A packed R-tree of count vectors: every level's boxes as largest counts and smallest size.

    Points are ordered by halving along the coordinate of the widest spread, the size included, so boxes
    of neighbours are small.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, fanout: int) -> None:
        self.fanout = fanout
        self.order = self._spread(np.c_[counts, sizes], np.arange(len(sizes)), fanout)
        high, least = counts[self.order], sizes[self.order]
        self.levels = [(high, least)]  # points first, the root last
        while len(least) > 1:
            start = np.arange(0, len(least), fanout)
            high, least = np.maximum.reduceat(high, start), np.minimum.reduceat(least, start)
            self.levels.append((high, least))

    @staticmethod
    def _spread(points: np.ndarray, rows: np.ndarray, fanout: int) -> np.ndarray:
        todo, out = [rows], []
        while todo:
            own = todo.pop()
            if len(own) <= fanout:
                out.append(own)
                continue
            widest = int(np.argmax(np.ptp(points[own], axis=0)))
            own = own[np.argsort(points[own, widest], kind="stable")]
            half = fanout
            while 2 * half < len(own):
                half *= 2
            todo += [own[half:], own[:half]]
        return np.concatenate(out)


def _may_link(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray, share: int) -> np.ndarray:
    """Which boxes or points (i of a, j of b) may hold a link: the summed minima bound the overlap from above."""
    out = np.empty(len(i), dtype=bool)
    for at in range(0, len(i), 8192):
        k, m = i[at : at + 8192], j[at : at + 8192]
        overlap = np.minimum(a[0][k], b[0][m]).sum(axis=1, dtype=np.int64)
        out[at : at + 8192] = (100 + share) * overlap >= share * (a[1][k] + b[1][m])
    return out


def tree_join(a: CountTree, b: CountTree, share: int, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points that may link, in pieces: box pairs go down both trees depth first, so that few wait.

    A tree joined with itself gives each pair once and no point with itself.
    """
    itself, depth = a is b, max(len(a.levels), len(b.levels)) - 1
    todo = [(depth, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while todo:
        level, i, j = todo.pop()
        at_a, at_b = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
        fits = _may_link(a.levels[at_a], b.levels[at_b], i, j, share)
        i, j = i[fits], j[fits]
        if not len(i):
            continue
        if level == 0:
            apart = i < j if itself else np.ones(len(i), dtype=bool)
            yield a.order[i[apart]], b.order[j[apart]]
            continue
        down_a, down_b = level - 1 < at_a, level - 1 < at_b
        step_a, step_b = np.arange(a.fanout if down_a else 1), np.arange(b.fanout if down_b else 1)
        piece = max(1, most // (len(step_a) * len(step_b)))
        for at in range(0, len(i), piece):
            x, y = i[at : at + piece], j[at : at + piece]
            x = (x * (a.fanout if down_a else 1))[:, None, None] + step_a[None, :, None]
            y = (y * (b.fanout if down_b else 1))[:, None, None] + step_b[None, None, :]
            x, y = (z.ravel() for z in np.broadcast_arrays(x, y))
            inside = (x < len(a.levels[min(level - 1, at_a)][1])) & (y < len(b.levels[min(level - 1, at_b)][1]))
            if itself:
                inside &= x <= y
            todo.append((level - 1, x[inside], y[inside]))


class Overlaps:
    """Exact overlaps of pairs of sets, from bit sets over the shingles that more than one set has."""

    COLUMNS = 1 << 16

    def __init__(self, sets: list[np.ndarray]) -> None:
        flat = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(flat, kind="stable")
        flat, of = flat[order], of[order]
        new = np.r_[True, flat[1:] != flat[:-1]][: len(flat)]
        number = np.cumsum(new) - 1
        shared = np.bincount(number)[number] > 1
        number, of = number[shared], of[shared]
        number = np.cumsum(np.r_[True, number[1:] != number[:-1]]) - 1 if len(number) else number
        self.parts = []
        for low in range(0, int(number[-1]) + 1 if len(number) else 0, self.COLUMNS):
            at = (number >= low) & (number < low + self.COLUMNS)
            column = number[at] - low
            words = int(column.max()) // 64 + 1
            bits = np.zeros((len(sets), words), dtype=np.uint64)
            # Each (set, shingle) stands once, so sums of powers are unions.
            cell = of[at] * words + column // 64
            by_cell = np.argsort(cell, kind="stable")
            cell, power = cell[by_cell], np.uint64(1) << (column[by_cell] % 64).astype(np.uint64)
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            bits.reshape(-1)[cell[start]] = np.bitwise_or.reduceat(power, start)
            self.parts.append(bits)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.int64)
        for bits in self.parts:
            step = max(1, (1 << 20) // bits.shape[1])
            for at in range(0, len(i), step):
                out[at : at + step] += np.bitwise_count(bits[i[at : at + step]] & bits[j[at : at + step]]).sum(axis=1, dtype=np.int64)
        return out


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, s: Settings) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets numbered ``left`` and those numbered ``right`` (the same
    array: among them). Pairs that are connected already are not verified."""
    counts = count_vectors(sets, s.groups)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    a = CountTree(counts[left], sizes[left], s.fanout)
    b = a if left is right else CountTree(counts[right], sizes[right], s.fanout)
    overlaps, part, links = Overlaps(sets), np.arange(len(sets)), []
    for i, j in tree_join(a, b, s.share):
        i, j = left[i], right[j]
        for at in range(0, len(i), 4096):
            x, y = i[at : at + 4096], j[at : at + 4096]
            apart = part[x] != part[y]
            x, y = x[apart], y[apart]
            shared = overlaps(x, y)
            near = (100 + s.share) * shared >= s.share * (sizes[x] + sizes[y])
            for p, q in zip(x[near].tolist(), y[near].tolist(), strict=True):
                low, high = sorted((int(part[p]), int(part[q])))
                if low != high:
                    part[part == high] = low
                    links.append((p, q))
    return links


# ---- the join -----------------------------------------------------------------------------------


def _tiles(members: DataFrame, s: Settings) -> DataFrame:
    """``members(block, node, n_shingles, ...)`` with the tile of each: blocks one after the other and sizes
    ascending inside, cut where a tile's shingles are full."""
    placed = ranked(members, [F.col("block"), F.col("n_shingles"), F.col("node")], "ngrams-order", "place")
    # Shingles before a row: sums of stretches of places, then inside a stretch.
    stretch = F.floor(F.col("place") / 4096)
    sums = placed.groupBy(stretch.alias("stretch")).agg(F.sum("n_shingles").alias("all"))
    far = F.floor(F.col("stretch") / 4096)
    totals = sums.groupBy(far.alias("far")).agg(F.sum("all").alias("far_all"))
    earlier = (Window.unboundedPreceding, -1)
    totals = totals.select("far", F.coalesce(F.sum("far_all").over(Window.orderBy("far").rowsBetween(*earlier)), F.lit(0)).alias("far_before"))
    before = F.coalesce(F.sum("all").over(Window.partitionBy("far").orderBy("stretch").rowsBetween(*earlier)), F.lit(0))
    sums = sums.withColumn("far", far).withColumn("before", before).join(totals, "far")
    sums = sums.select("stretch", (F.col("before") + F.col("far_before")).alias("base"))
    inside = F.coalesce(F.sum("n_shingles").over(Window.partitionBy("stretch").orderBy("place").rowsBetween(*earlier)), F.lit(0))
    rows = placed.withColumn("stretch", stretch).withColumn("inside", inside).join(sums, "stretch")
    return rows.withColumn("tile", F.floor((F.col("base") + F.col("inside")) / s.tile_shingles)).drop("place", "stretch", "inside", "base")


def _cells(tiles: DataFrame, s: Settings) -> DataFrame:
    """(block, tile, a, b): the pairs of tiles each piece of a block goes to. A piece meets itself and those
    later pieces of its block whose sizes are near enough; most blocks lie in one tile."""
    pieces = tiles.groupBy("block", "tile").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    several = pieces.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block")
    cut = stored(pieces.join(several, "block", "left_semi"), "ngrams-pieces")
    first, second = (cut.select("block", *[F.col(c).alias(f"{c}_{x}") for c in ("tile", "least", "most")]) for x in ("a", "b"))
    pairs = first.join(second, "block").where("tile_a < tile_b").where(F.lit(s.share) * F.col("least_b") <= 100 * F.col("most_a"))
    pairs = stored(pairs.select("block", F.col("tile_a").alias("a"), F.col("tile_b").alias("b")), "ngrams-cells")
    own = pieces.select("block", "tile", F.col("tile").alias("a"), F.col("tile").alias("b"))
    return own.unionByName(pairs.select("block", F.col("a").alias("tile"), "a", "b")).unionByName(pairs.select("block", F.col("b").alias("tile"), "a", "b"))


def _cell_links(rows: pa.Table, s: Settings) -> pa.Table:
    order = np.argsort(rows.column("block").to_numpy(), kind="stable")
    rows = rows.take(pa.array(order))
    block, node, tile = (rows.column(c).to_numpy() for c in ("block", "node", "tile"))
    lists = rows.column("shingles").combine_chunks()
    ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
    flat = lists.flatten().to_numpy().view(np.uint64)
    low, high = rows.column("a")[0].as_py(), rows.column("b")[0].as_py()
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    for x, y in zip(start.tolist(), [*start[1:].tolist(), len(block)], strict=True):
        sets = [flat[ends[k] : ends[k + 1]] for k in range(x, y)]
        left = np.flatnonzero(tile[x:y] == low)
        right = left if low == high else np.flatnonzero(tile[x:y] == high)
        if len(left) > (low == high) and len(right):
            links = block_links(sets, left, right, s)
            if links:
                p, q = np.array(links, dtype=np.int64).T
                out.append((node[x + p], node[x + q]))
    return pa.table([pa.array(np.concatenate([o[k] for o in out])) for k in (0, 1)], names=["a", "b"])


def with_times(members: DataFrame, repeats: DataFrame) -> DataFrame:
    """``members`` with ``times`` of ``repeats(doc_id, same_text, times)``, 1 where a row is not repeated."""
    repeats = repeats.select(F.col("doc_id").alias("__id"), F.col("same_text").alias("__same"), "times")
    both = members.join(repeats, (F.col("same_text") == F.col("__same")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return both.select(*members.columns, F.coalesce("times", F.lit(1)).alias("times"))


def links_in_blocks(members: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) that connect the nodes of ``members(node, block, n_shingles, doc_id, same_text, times)`` exactly as
    all links inside their blocks would; ``same_text`` is ``text_key`` of the row of ``docs`` that stands for the
    node, and ``times`` how many rows equal it in id and text.

    A block is cut into tiles of bounded size, and each pair of its tiles that may hold links is one task.
    The texts of the members are read once more; a set is built once and goes straight to the cells of its
    tile, the only time sets cross the network. Members grow with the corpus and are never broadcast.
    """
    tiles = stored(_tiles(members, s), "ngrams-tiles")
    cells = _cells(tiles, s).groupBy("block", "tile").agg(F.collect_list(F.struct("a", "b")).alias("cells"))
    wanted = stored(tiles.join(cells, ["block", "tile"]).select("node", "block", "tile", "same_text", "doc_id", "times", "cells"), "ngrams-wanted")
    texts = docs.select(F.col("doc_id").alias("__id"), text_key().alias("__same"), "text")
    found = texts.join(wanted.hint("merge"), (F.col("__same") == F.col("same_text")) & F.col("__id").eqNullSafe(F.col("doc_id")))
    found = found.select("node", "block", "tile", "cells", "text", "times")
    if not wanted.where("times > 1").isEmpty():  # rows that repeat an id and its text are one
        found = found.where("times = 1").unionByName(found.where("times > 1").dropDuplicates(["node"]))
    small_batches(docs.sparkSession)
    names = ["node", "block", "tile", "a", "b", "shingles"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            sets = pa.array([shingle_set(t.as_py(), s.words, hashes).view(np.int64) for t in batch.column(4).cast(pa.binary())], pa.list_(pa.int64()))
            each = batch.column(3)
            of = pa.array(np.repeat(np.arange(batch.num_rows), each.value_lengths().to_numpy(zero_copy_only=False)))
            pair = each.flatten()
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in range(3)), pair.field("a"), pair.field("b"), sets.take(of)], names=names)

    dealt = found.drop("times").mapInArrow(build, "node long, block long, tile long, a long, b long, shingles array<long>")
    links = dealt.groupBy("a", "b").applyInArrow(lambda group: _cell_links(group, s), "a long, b long")
    links = stored(links, "ngrams-links")
    discard(tiles, wanted)
    return links


def similar_sets(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs(doc_id, text)``: the size of its set of word
    shingles and the smallest doc_id reachable over links of at least ``share`` percent Jaccard similarity.

    Equal sets are one point. Points that share a band (see above) lie in one block, so no link leaves its
    block; blocks are cut into tiles of bounded size, and each pair of a block's tiles that may hold links is
    one task, so a block of any size is many tasks. A task builds an R-tree of the tile's count vectors, goes
    down both trees where the summed minima of counts allow an overlap large enough, and verifies what
    arrives on the sets themselves; it returns a spanning forest of the links, never all pairs. Sets are
    64-bit hashes of shingles. Documents without words have an empty set, linked with nothing, and are
    their own component, as are those with a null id and no linked document that has one. Repeated rows are
    rows of their own; an empty table gives no rows.
    """
    s = settings
    rows = stored(with_keys(docs, s), "ngrams-rows")
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid", "same_text", "n_shingles")
    nodes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min(own).alias("own"))
    nodes = stored(nodes.select("digest", "own.*", F.col("own.uid").alias("node")), "ngrams-nodes")
    keys = rows.select("uid", "keys").join(nodes.select("uid", "node"), "uid").select(F.explode("keys").alias("key"), "node")
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").select("key", "low")
    edges = keys.join(stored(shared, "ngrams-keys"), "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    blocks = stored(connected_components(edges, "ngrams-blocks").select("node", F.col("component").alias("block")), "ngrams-blocks")

    members = nodes.select("node", "same_text", "n_shingles", "doc_id").join(blocks, "node")
    repeats = rows.groupBy("doc_id", "same_text").agg(F.count("*").alias("times")).where("times > 1")
    members = with_times(members, repeats)
    links = links_in_blocks(members, docs, s)
    member = connected_components(links, "ngrams-components").select("node", "component")
    both = stored(nodes.join(member, "node", "left").withColumn("component", F.coalesce("component", "node")), "ngrams-members")
    least = both.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = stored(both.select("digest", "component").join(least, "component").select("digest", "component_id"), "ngrams-classes")
    out = rows.where("digest IS NOT NULL").select("doc_id", "n_shingles", "digest").join(classes, "digest").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(rows.where("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


SQL = r"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT uid, doc_id, list_sort(list_distinct(CASE WHEN len(w) BETWEEN 1 AND 2 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS shingles FROM t),
d AS (SELECT uid, doc_id, len(shingles) AS n, md5(array_to_string(shingles, chr(10))) AS digest, shingles FROM s),
c AS (SELECT digest, min(doc_id) AS node, any_value(n) AS n, any_value(shingles) AS shingles FROM d WHERE n > 0 GROUP BY 1),
x AS (SELECT node, n, unnest(shingles) AS shingle FROM c),
o AS (SELECT a.node AS a, b.node AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS shared FROM x a JOIN x b ON a.shingle = b.shingle AND a.node < b.node AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE 100 * shared >= 90 * (total - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT node AS a, node AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS node, min(b) AS least FROM r GROUP BY 1)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id FROM d LEFT JOIN c ON d.digest = c.digest AND d.n > 0 LEFT JOIN m ON m.node = c.node"""


@query("op11_count_tree", SQL)
def op11_count_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents over links of at least 90 percent of their three-word shingles."""
    return similar_sets(table(spark, sf_dir, "documents"))
