"""Near copies by 64-bit SimHash fingerprints, searched with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log2, pi, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, small_batches, stored, table
from .components import connected_components
from .ngram_join import Settings, _Hashes, _mixed, band_keys, count_vectors, links_in_blocks, shingle_set, text_key, with_times
from .registry import query

#: Runs up to this long are compared offset by offset for a whole batch at once.
SHORT_RUN = 32
#: Longer runs are cut by further equal bits until they are at most this long.
BLOCK = 4096


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of one text as a signed 64-bit number; 0 for a text without words.

    A bit is set when more than half of the word shingles, repeats included, have it set in their XXH64
    (seed 42). Bits are counted by byte value, so the work for one shingle is eight counter steps.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [digest(b" ".join(tokens), 42)]
    else:
        hashes = [digest(b" ".join(tokens[i : i + words]), 42) for i in range(len(tokens) - words + 1)]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    bits = 2 * (counts @ _BITS_OF) > len(hashes)
    return int(np.packbits(bits.ravel(), bitorder="little").view("<i8")[0])


_BYTE_AT = np.arange(8, dtype=np.int64) * 256
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def with_fingerprints(docs: DataFrame, words: int = 3, keep: list[str] | None = None, name: str = "fp", wide: bool = False) -> DataFrame:
    """``keep`` columns of ``docs(text)`` plus fingerprint ``name``; whole texts, null and empty ones give 0."""
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    source = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    at = source.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = wide_fingerprint if wide else fingerprint
            fps = pa.array([made(t.as_py(), words) for t in batch.column(at)], pa.binary() if wide else pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], fps], names=[*keep, name])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[: len(keep)], T.StructField(name, T.BinaryType() if wide else T.LongType())]))


# ---- pivots -------------------------------------------------------------------------------------
# The reference fingerprints: zero, the 32 pairs of neighbouring bits, and 15 patterns that cover half
# of the bits. Random references tell fingerprints apart badly (all distances are near 32), while the
# distances to zero and to a pair give the number of ones in that pair: H(x, 0) + 2 - H(x, pair) = 2 ones.


def references() -> np.ndarray:
    pairs = [3 << (2 * i) for i in range(32)]
    wide = [sum(1 << b for b in range(64) if (b & k).bit_count() & 1) for k in range(1, 16)]
    return np.array([0, *pairs, *wide], dtype=np.uint64)


_REFERENCES = references()


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (rows) to the reference fingerprints (columns)."""
    return np.bitwise_count(fps.view(np.uint64)[:, None] ^ _REFERENCES).astype(np.int8)


def _close(fps: np.ndarray, dist: np.ndarray, i, j, radius: int) -> np.ndarray:
    """Which pairs (i, j) are within ``radius``: pivots discard, the fingerprints themselves decide."""
    maybe = np.abs(dist[i] - dist[j]).max(axis=1) <= radius
    a, b = fps.view(np.uint64)[i], fps.view(np.uint64)[j]
    maybe[maybe] = np.bitwise_count(np.broadcast_to(a, maybe.shape)[maybe] ^ b[maybe]) <= radius
    return maybe


def _flood(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct ``fps``: each joins the first member that reaches it."""
    dist, rest, links = distance_table(fps), np.arange(len(fps)), []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop()
            hit = _close(fps, dist, np.full(1, x), rest, radius)
            links += [(x, int(y)) for y in rest[hit]]
            front += rest[hit].tolist()
            rest = rest[~hit]
    return links


def forest(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect distinct fingerprints exactly as all links within ``radius`` would.

    Long runs are cut: with the bits that differ anywhere in the run dealt into radius + 1 parts, two
    fingerprints within the radius agree on one part, so each part's groups are searched on their own.
    """
    if len(fps) <= BLOCK:
        for i, j in _flood(fps, radius):
            yield int(fps[i]), int(fps[j])
        return
    raw = fps.view(np.uint64)
    varying = int(np.bitwise_or.reduce(raw) ^ np.bitwise_and.reduce(raw))
    bits = [b for b in range(64) if varying >> b & 1]
    if len(bits) <= radius:
        yield from ((int(fps[0]), int(y)) for y in fps[1:])
        return
    for part in range(radius + 1):
        own = np.uint64(sum(1 << b for b in bits[part :: radius + 1]))
        order = np.argsort(raw & own, kind="stable")
        cuts = np.flatnonzero(np.diff((raw & own)[order])) + 1
        for group in np.split(fps[order], cuts):
            if len(group) > 1:
                yield from forest(np.ascontiguousarray(group), radius)


class _Sets:
    """Union-find over the links of one batch, so that a batch never emits more links than it has rows."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[y]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _link_runs(code: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    length = np.diff(np.r_[start, len(code)])
    of_run = np.repeat(length, length)
    paired = np.flatnonzero((of_run > 1) & (of_run <= SHORT_RUN))
    links, sets = [], _Sets()
    code_p, fps_p = code[paired], np.ascontiguousarray(fps[paired])
    dist = distance_table(fps_p)
    for step in range(1, SHORT_RUN):
        i = np.flatnonzero(code_p[step:] == code_p[:-step])
        if not len(i):
            break
        i = i[_close(fps_p, dist, i, i + step, radius)]
        links += zip(fps_p[i].tolist(), fps_p[i + step].tolist(), strict=True)
    for s, n in zip(start[length > SHORT_RUN], length[length > SHORT_RUN], strict=True):
        links += forest(np.ascontiguousarray(fps[s : s + n]), radius)
    return [x for x in links if sets.join(*x)]


def equal_sets(n: int, radius: int) -> int:
    """How many of ``radius`` + k sets of bit pairs a search group fixes, so that a group of ``n`` random
    fingerprints holds few: a pair's count of ones carries 1.5 bits. More sets mean more groups for each
    fingerprint, but never other links."""
    k = 3
    while 48 * k / (radius + k) < log2(max(n, 2)) - 2 and comb(radius + k + 1, k + 1) <= 256:
        k += 1
    return k


def link_fingerprints(fps: DataFrame, radius: int = 3, fixed: int | None = None) -> DataFrame:
    """Links (a, b) among the distinct values of ``fps.fp`` that connect what lies within ``radius`` bits.

    The distance table deals fingerprints to search groups: the 32 bit pairs fall into ``radius`` + k
    sets, and two fingerprints within the radius have equal pivot coordinates on at least k sets. So each
    fingerprint goes to one group for every choice of k sets, pairs of a group whose pivot distances
    differ by more than the radius anywhere are discarded, and the rest are compared. No link is lost
    whatever k (``fixed``) is; by default it follows the number of fingerprints, see ``equal_sets``. A group gives at most one link for each member, not all its pairs; a group larger than a
    block is cut exactly, see ``forest``. A task holds one group's fingerprints (8 bytes each) at a time.
    """
    fixed = equal_sets(fps.count(), radius) if fixed is None else fixed
    sets = radius + fixed
    if sets > 32:
        raise ValueError("the radius must be below 30")
    masks = [sum(3 << (2 * p) for p in range(32) if p % sets == s) for s in range(sets)]
    chosen = [int(np.uint64(sum(masks[s] for s in own)).view(np.int64)) for own in combinations(range(sets), fixed)]
    fp = F.col("fp")
    low = fp.bitwiseAND(F.lit(0x5555555555555555))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(0x5555555555555555))
    ones = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # ones of each pair, in its two bits
    codes = F.array(*[F.xxhash64(F.lit(n), ones.bitwiseAND(F.lit(m))) for n, m in enumerate(chosen)])
    dealt = fps.select("fp").distinct().select("fp", F.explode(codes).alias("code"))
    dealt = dealt.repartition("code").sortWithinPartitions("code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_code, held = np.empty(0, np.int64), np.empty(0, np.int64)

        def out(links: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            if links:
                a, b = np.array(links, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            code, own = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            parts.append((code, own))
            if len(code) and code[0] == code[-1] == parts[0][0][-1]:
                continue  # still inside one group
            held_code, held = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            cut = int(np.searchsorted(held_code, held_code[-1], side="left"))
            parts = [(held_code[cut:], held[cut:])]
            yield from out(_link_runs(held_code[:cut], held[:cut], radius) if cut else [])
        if parts:
            held_code, held = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            yield from out(_link_runs(held_code, held, radius))

    small_batches(fps.sparkSession, 8192)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_copy_groups(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, component, group_id) for each distinct fingerprint of ``fps(fp, id)``, linked within ``radius``
    bits.

    ``group_id`` is the smallest id in the fingerprint's component (null ids count last). Equal
    fingerprints are one row before the search, so a group of copies of any size costs one row.
    """
    nodes = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    links = stored(link_fingerprints(nodes, radius), "simhash-links")
    member = connected_components(links, "simhash-components").select(F.col("node").alias("fp"), "component")
    linked = stored(nodes.join(member, "fp"), "simhash-members")
    least = linked.groupBy("component").agg(F.min("least").alias("group_id"))
    linked = linked.join(least, "component").select("fp", "component", "group_id")
    both = nodes.join(linked, "fp", "left")
    return both.select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("group_id", "least").alias("group_id"))


@query("op6_simhash_pivots")
def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the smallest doc_id reachable over links of at most 3 bits.

    Null and empty texts have fingerprint zero and are linked like others; repeated rows each return a
    row; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    fps = stored(with_fingerprints(docs, 3, keep=["doc_id"]), "simhash-fingerprints")
    groups = stored(near_copy_groups(fps.withColumnRenamed("doc_id", "id"), 3), "simhash-groups")
    return fps.join(groups, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("group_id").alias("component_id"),
    )


# ---- a given similarity -------------------------------------------------------------------------
# Three bits of 64 mean near identity. For a looser similarity the fingerprint is wider, so that the number
# of differing bits tells the similarity; sampled bits of it find most pairs, but not all, so the stage
# ``drop_near_copies`` does not search by them.


def wide_fingerprint(text: str | None, words: int = 5, lanes: int = 4) -> bytes:
    """SimHash of ``lanes`` times 64 bits, eight bytes a lane; zero bytes for a text without words.

    Lanes after the first come from mixing the same shingle hashes with other constants.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return bytes(8 * lanes)
    digest = xxhash.xxh64_intdigest
    starts = range(max(1, len(tokens) - words + 1))
    hashes = np.array([digest(b" ".join(tokens[i : i + words]), 42) for i in starts], dtype="<u8")
    out = []
    for lane in range(lanes):
        h = hashes
        if lane:
            h = h + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
        octets = h.view(np.uint8).reshape(-1, 8)
        counts = np.bincount((octets + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
        out.append(np.packbits((2 * (counts @ _BITS_OF) > len(h)).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def bits_apart(similarity: float, bits: int) -> float:
    """Expected differing bits of two texts whose shingle sets of one size have this Jaccard similarity."""
    return bits * acos(2 * similarity / (1 + similarity)) / pi


class Tables(NamedTuple):
    """Sampled bits of each table: two fingerprints that agree on all bits of one table are compared."""

    bits: int
    tables: int


def widest(similarity: float, bits: int, deviations: float = 3) -> int:
    """Differing bits up to which a pair is a candidate: three deviations above what this similarity gives."""
    apart = bits_apart(similarity, bits)
    return int(apart + deviations * sqrt(apart * (1 - apart / bits)))


def tables_for(n: int, similarity: float, recall: float = 0.97, width: int = 256) -> Tables:
    """As many bits as keep groups of ``n`` random fingerprints small, and as many tables as two texts of
    exactly this similarity need to become candidates with this chance (more similar ones do more surely).

    The chance is taken over all numbers of differing bits that the similarity gives, not at their mean.
    """
    bits = max(16, ceil(log2(max(n, 2))) - 3)
    share = bits_apart(similarity, 1)
    d = np.arange(widest(similarity, width) + 1)
    weight = np.array([comb(width, int(k)) * share**k * (1 - share) ** (width - k) for k in d.tolist()])
    if weight.sum() <= recall:
        raise ValueError(f"only {weight.sum():.4f} of such pairs lie within {d[-1]} bits")
    meet, tables = (1 - d / width) ** bits, 1
    while (weight * (1 - (1 - meet) ** tables)).sum() < recall:
        tables += 1
    return Tables(bits, tables)


def _wide_links(code: np.ndarray, fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Positions of linked rows within runs of equal ``code``: a spanning forest of each run's links."""
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    length = np.diff(np.r_[start, len(code)])
    of_run = np.repeat(length, length)
    at = np.flatnonzero((of_run > 1) & (of_run <= SHORT_RUN))
    links: list[tuple[int, int]] = []
    for step in range(1, SHORT_RUN):
        i = np.flatnonzero(code[at][step:] == code[at][:-step])
        if not len(i):
            break
        a, b = at[i], at[i + step]
        near = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1) <= most
        links += zip(a[near].tolist(), b[near].tolist(), strict=True)
    for s, n in zip(start[length > SHORT_RUN], length[length > SHORT_RUN], strict=True):
        rest = np.arange(s, s + n)
        while len(rest):
            front, rest = [int(rest[0])], rest[1:]
            while front and len(rest):
                x = front.pop()
                near = np.bitwise_count(fps[rest] ^ fps[x]).sum(axis=1) <= most
                links += [(x, int(y)) for y in rest[near]]
                front += rest[near].tolist()
                rest = rest[~near]
    return links


# ---- near copies by exact sets ------------------------------------------------------------------
# Two proposers, both exact: fingerprints within three bits, found by pivots, and sets that share a band (see
# ``ngram_join``), of which every pair of the given similarity has one. Count vectors bound the overlap of a pair
# from above, so a proposal of bands that cannot hold goes before blocks are made.

#: Members of a band up to this many are proposed pair by pair; more are searched as a group of their own.
PAIRED = 64
_FULL = 65_535


def _keys(shingles: np.ndarray, s: Settings) -> np.ndarray:
    """Band keys and a key of the whole set: texts that differ may have equal sets, which small sets have no band for."""
    own = np.uint64(len(shingles)) + _mixed(shingles).sum(dtype=np.uint64)
    return np.r_[band_keys(shingles, s), _mixed(own[None])] if len(shingles) else band_keys(shingles, s)


def _sketches(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, same_text, uid, fp, n_shingles, counts, keys) of each row: fingerprint, size, count vector and band keys
    of its set of shingles."""
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", text_key().alias("same_text"), F.monotonically_increasing_id().alias("uid"), F.col("text").alias("__text"))
    kept = ["doc_id", "same_text", "uid"]
    made = [
        T.StructField("fp", T.LongType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("counts", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(3).to_pylist()
            sets = [shingle_set((t or "").encode("utf-8", "surrogatepass"), s.words, hashes) for t in texts]
            counts = np.minimum(count_vectors(sets, s.groups), _FULL).astype("<u2")
            columns = [
                pa.array([fingerprint(t, s.words) for t in texts], pa.int64()), pa.array([len(x) for x in sets], pa.int64()),
                pa.array([x.tobytes() for x in counts], pa.binary()), pa.array([_keys(x, s).view(np.int64) for x in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=[*kept, *(f.name for f in made)])

    return source.mapInArrow(run, T.StructType([*(source.schema[c] for c in kept), *made]))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, uid), sorted by key, whose key another row has too."""
    held: tuple | None = None  # the last row waits for the one after it; whether the one before has its key
    for batch in batches:
        if not batch.num_rows:
            continue
        key, uid = (batch.column(k).to_numpy() for k in (0, 1))
        if held:
            key, uid = np.r_[held[0], key], np.r_[held[1], uid]
        same = key[1:] == key[:-1]
        keep = np.r_[bool(held and held[2]), same] | np.r_[same, False]
        out = keep[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(key[:-1][out]), pa.array(uid[:-1][out])], names=["key", "uid"])
        held = key[-1], uid[-1], keep[-1]
    if held and held[2]:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], names=["key", "uid"])


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut only where it changes."""
    parts: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append(batch)
        if batch.column(0)[0] == batch.column(0)[-1] == parts[0].column(0)[-1]:
            continue  # still inside one run
        whole = pa.Table.from_batches(parts)
        key = whole.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], side="left"))
        parts = whole.slice(cut).combine_chunks().to_batches()
        if cut:
            yield whole.slice(0, cut)
    if parts:
        yield pa.Table.from_batches(parts)


def _starts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return start, np.diff(np.r_[start, len(key)])


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(len(column), -1)


def _may_be_alike(counts: np.ndarray, size: np.ndarray, other: np.ndarray, other_size: np.ndarray, share: int) -> np.ndarray:
    """Whether the summed minima allow the overlap; a count that is full says nothing."""
    bound = np.minimum(counts, other).sum(axis=-1, dtype=np.int64)
    full = (counts == _FULL).any(axis=-1) & (other == _FULL).any(axis=-1)
    return full | ((100 + share) * bound >= share * (size + other_size))


def _flood_alike(node: np.ndarray, size: np.ndarray, counts: np.ndarray, share: int) -> list[tuple[int, int]]:
    """A spanning forest of what may be alike among the members of one band; over a block, all stay together."""
    if len(node) > BLOCK:
        return [(int(node[0]), int(y)) for y in node[1:]]
    rest, links = np.arange(len(node)), []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = _may_be_alike(counts[rest], size[rest], counts[x], size[x], share)
            links += [(int(node[x]), int(node[y])) for y in rest[near]]
            front += rest[near].tolist()
            rest = rest[~near]
    return links


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def pairs_by_bands(keys: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) that connect all nodes of ``nodes(node, n_shingles, counts)`` whose sets link, and few others.

    ``keys(key, node)`` are the band keys, of which linked sets share one. Where few nodes share a key all their pairs
    are tested, once each; where many do, the key's nodes are searched as a group; a group over a block
    stays whole, for the block's tiles to be decided.
    """
    spark, share = keys.sparkSession, s.share
    sized = nodes.select("node", "n_shingles")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _whole_runs(batches):
            key, node, size = (runs.column(k).to_numpy() for k in range(3))
            start, length = _starts(key)
            of_run = np.repeat(length, length)
            at = np.flatnonzero((of_run > 1) & (of_run <= PAIRED))
            found = [np.empty((0, 2), dtype=np.int64)]
            for step in range(1, PAIRED):
                i = np.flatnonzero(key[at][step:] == key[at][:-step])
                if not len(i):
                    break
                x, y = at[i], at[i + step]
                fits = share * size[y] <= 100 * size[x]
                found.append(np.c_[np.minimum(node[x], node[y]), np.maximum(node[x], node[y])][fits])
            pairs, many = np.unique(np.concatenate(found), axis=0), np.flatnonzero(of_run > PAIRED)
            columns = [np.r_[pairs[:, 0], node[many]], np.r_[pairs[:, 1], np.zeros(len(many), np.int64)], np.r_[np.zeros(len(pairs), np.int64), key[many]]]
            alone = np.r_[np.zeros(len(pairs), bool), np.ones(len(many), bool)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(alone)], names=["a", "b", "key", "many"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, n, m = (batch.column(k).to_numpy() for k in range(4))
                near = _may_be_alike(_vectors(batch.column(4)), n, _vectors(batch.column(5)), m, share)
                yield _pair_batch(a[near], b[near])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _whole_runs(batches):
            key, node, size = (runs.column(k).to_numpy() for k in range(3))
            counts, sets = _vectors(runs.column(3)), _Sets()
            links = [x for at, n in zip(*_starts(key), strict=True) for x in _flood_alike(node[at : at + n], size[at : at + n], counts[at : at + n], share) if sets.join(*x)]
            if links:
                yield _pair_batch(*np.array(links, dtype=np.int64).T)

    small_batches(spark, 16_384)
    members = keys.join(sized, "node").select("key", "node", "n_shingles")
    found = members.repartition("key").sortWithinPartitions("key", "n_shingles", "node").mapInArrow(deal, "a long, b long, key long, many boolean")
    found = stored(found, "simhash-pairs")
    first, second = (nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("counts").alias(f"counts_{x}")) for x in "ab")
    few = found.where("NOT many").select("a", "b").distinct().join(first, "a").join(second, "b")
    few = few.select("a", "b", "n_a", "n_b", "counts_a", "counts_b").mapInArrow(test, "a long, b long")
    many = found.where("many").select("key", F.col("a").alias("node")).join(nodes.select("node", "n_shingles", "counts"), "node")
    many = many.select("key", "node", "n_shingles", "counts").repartition("key").sortWithinPartitions("key", "n_shingles", "node")
    many = many.mapInArrow(search, "a long, b long")
    out = stored(few.unionByName(many), "simhash-alike")
    discard(found)
    return out


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component kept: the one with the smallest doc_id, then text hash.

    Links join texts whose five-word shingle sets have at least the given similarity; texts without words
    are linked with each other. Equal texts are one node before the search. SimHash fingerprints within three
    bits, found by pivots (``near_copy_groups``), and shared bands (``pairs_by_bands``) propose; bands leave no
    link out, so the result does not hang on chance. What proposals connect is a block; all pairs of a block are
    then decided on the exact sets (``links_in_blocks``), so a proposal that fails parts nobody and no table of pairs
    is made. Texts are never written: they are read for the sketches, for the sets of proposed nodes, and
    to be returned, where rows to leave out are told by id and text hash. Rows equal in both are one.
    Null ids come after all others.
    """
    s = Settings(words=words, share=round(100 * similarity))
    whole = stored(_sketches(docs, s), "simhash-sketches")
    small_batches(docs.sparkSession, 65_536)
    keys = whole.select(F.explode("keys").alias("key"), "uid").repartition("key").sortWithinPartitions("key")
    keys = stored(keys.mapInArrow(_shared, "key long, uid long"), "simhash-keys")
    rows = stored(whole.drop("keys"), "simhash-rows")
    discard(whole)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")).alias("least")
    nodes = rows.groupBy("same_text").agg(F.min("uid").alias("node"), *[F.first(c).alias(c) for c in ("fp", "n_shingles", "counts")], least)
    nodes = stored(nodes, "simhash-nodes")
    of = rows.select("uid", "same_text").join(nodes.select("same_text", "node"), "same_text").select("uid", "node")
    banded = pairs_by_bands(keys.join(of, "uid").select("key", "node").distinct(), nodes, s)
    groups = stored(near_copy_groups(nodes.select("fp", F.col("node").alias("id"))), "simhash-groups")
    near = nodes.select("node", "fp").join(groups, "fp").where("node <> group_id").select(F.col("node").alias("a"), F.col("group_id").alias("b"))
    proposed = stored(banded.unionByName(near).distinct(), "simhash-candidates")
    discard(keys, banded, groups)
    blocks = connected_components(proposed, "simhash-blocks").select("node", F.col("component").alias("block"))
    seen = stored(rows.groupBy("doc_id", "same_text").agg(F.count("*").alias("times")), "simhash-seen")
    members = nodes.join(blocks, "node").select("node", "block", "n_shingles", "least.doc_id", "same_text")
    members = stored(with_times(members, seen.where("times > 1")), "simhash-members")
    links = links_in_blocks(members, docs, s)
    discard(proposed, members)
    member = stored(connected_components(links, "simhash-components").select("node", "component"), "simhash-classes")
    whole = nodes.select("node", "same_text", "least").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = stored(whole, "simhash-whole")
    first = whole.groupBy("component").agg(F.min(F.struct("least.last", "least.doc_id", "same_text")).alias("first"))
    kept = whole.join(first, "component").select("same_text", "first")
    seen, used = seen.join(kept, "same_text"), seen
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("same_text") == F.col("first.same_text"))
    marks = seen.withColumn("stays", stays).where("NOT stays OR times > 1")
    marks = stored(marks.select(F.col("doc_id").alias("__id"), F.col("same_text").alias("__same"), "stays"), "simhash-marks")
    discard(rows, nodes, links, member, whole, used)
    marked = (text_key() == F.col("__same")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    alone = docs.join(marks.drop("stays"), marked, "left_anti")
    if marks.where("stays").isEmpty():
        return alone
    again = docs.join(marks.where("stays"), marked).dropDuplicates(["__id", "__same"])
    return alone.unionByName(again.select(*docs.columns))
