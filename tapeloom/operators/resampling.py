"""Resampling without moving rows: stationary block bootstrap and true permutation tests.

Draws are digits of an md5 of (seed, replicate, row), so any engine can repeat them, and a lost task
draws the same again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .slices import Slices, nxt, ordered_scan, row_no, run_sum, total

STRETCH = 8192  #: positions whose restarts one row of the plan holds
PLACES = 131_072  #: places drawn at once
ENDS_PER_TASK = 2_000_000  #: run ends that one task looks up


def _key(seed: int, groups: Sequence[str], position: Column) -> Column:
    session = F.concat_ws("|", *[F.col(g).cast("string") for g in groups])
    return F.concat(F.lit(f"{seed}:"), F.col("replicate").cast("string"), F.lit(":"), session, F.lit(":"), position.cast("string"))


def _digits(key: Column, n: int) -> Column:
    return F.conv(F.substring(F.md5(key), 1, n), 16, 10).cast("long")


def _digests(keys: np.ndarray, sizes: np.ndarray, owner: np.ndarray, place: np.ndarray, tail: bytes) -> np.ndarray:
    """First 16 hex digits of md5(key of the owner, place as text, tail) as numbers, for many places at once."""
    out = np.empty(len(place), dtype=np.uint64)
    width = np.searchsorted(10 ** np.arange(1, 19), place, side="right") + 1
    kinds = sizes[owner] * 32 + width
    letters = keys.view(np.uint8).reshape(len(keys), -1)
    for kind in np.unique(kinds).tolist():
        size, digits = divmod(kind, 32)
        same = np.flatnonzero(kinds == kind)
        length = size + digits + len(tail)
        for at in range(0, len(same), 16_384):  # small enough to stay in the processor's cache
            pick = same[at : at + 16_384]
            text = np.zeros((len(pick), ((length + 8) // 64 + 1) * 64), dtype=np.uint8)
            text[:, :size] = letters[owner[pick], :size]
            rest = place[pick]
            for d in range(size + digits - 1, size - 1, -1):
                text[:, d] = rest % 10 + 48
                rest = rest // 10
            text[:, size + digits : length] = np.frombuffer(tail, dtype=np.uint8)
            text[:, length] = 0x80
            text[:, -8:] = np.frombuffer((8 * length).to_bytes(8, "little"), dtype=np.uint8)
            out[pick] = _md5_starts(np.ascontiguousarray(text.view("<u4").T))
    return out


def _md5_starts(words: np.ndarray) -> np.ndarray:
    """First eight bytes of the md5 of padded messages, one a column of 32-bit words, as big-endian numbers."""
    state = [np.full(words.shape[1], v, dtype=np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    for block in range(0, len(words), 16):
        a, b, c, d = state
        for i in range(64):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f = f + a + words[block + g] + np.uint32(int(abs(math.sin(i + 1)) * (1 << 32)))
            turn = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[i // 16][i % 4]
            a, d, c, b = d, c, b, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn)))
        state = [s + v for s, v in zip(state, (a, b, c, d), strict=True)]
    return state[0].byteswap().astype(np.uint64) << np.uint64(32) | state[1].byteswap()


def stationary_runs(sessions: DataFrame, groups: Sequence[str], replicates: int, mean_length: float, seed: int) -> DataFrame:
    """Runs (groups, n, replicate, start, length) of the stationary bootstrap of sessions (groups, n rows).

    A replicate walks through each session's n places: it starts anywhere, goes on to the next row, and
    at every place restarts anywhere with chance 1 / ``mean_length``; after the last row comes the first.
    So lengths are geometric and a session is resampled from itself. Restarts are decided place by place,
    which lets stretches of a long session be drawn apart; a stretch learns only the last restart before it.
    """
    if mean_length < 1:
        raise ValueError("the mean run is at least one row")
    stretch = max(STRETCH, int(mean_length))  # so that looking back costs no more than the stretch itself
    n = F.col("n").cast("long")
    plan = sessions.where("n > 0").select(*groups, n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {stretch}"))).alias("stretch"))
    plan = plan.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    # Sessions are few rows, which would arrive in one task; the draws are as many as their rows and replicates.
    tasks = int(sessions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = plan.repartition(tasks, *groups, "replicate", "stretch")
    plan = plan.select(*groups, "n", "replicate", (F.col("stretch") * stretch).alias("__low"), _key(seed, groups, F.lit("")).alias("__key"))
    heads = [*groups, "n", "replicate"]
    schema = T.StructType([*[plan.schema[c] for c in heads], T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    chance = int((1 << 32) / mean_length)
    always = chance >= 1 << 32

    def restarts(keys: np.ndarray, sizes: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.ones(len(place), dtype=bool) if always else (place == 0) | (_digests(keys, sizes, owner, place, b"") >> np.uint64(32) < chance)

    def runs_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, heads_of = batch.select(heads), [k.encode() for k in batch.column("__key").to_pylist()]
        keys, sizes = np.array(heads_of), np.array([len(k) for k in heads_of])
        n, low = batch.column("n").to_numpy(), batch.column("__low").to_numpy()
        count = np.minimum(n - low, stretch)
        owner = np.repeat(np.arange(len(n)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + low[owner]
        new = restarts(keys, sizes, owner, place)
        owner, place = owner[new], place[new]
        # A stretch that does not begin with a restart goes on with the run of the last restart before it.
        _, first = np.unique(owner, return_index=True)
        carried = np.setdiff1d(np.arange(len(n)), owner[first][place[first] == low[owner[first]]])
        source, seeking, upto = np.full(len(n), -1), carried, low[carried]
        while len(seeking):
            back = np.minimum(upto, max(16, int(4 * mean_length)))
            who = np.repeat(np.arange(len(seeking)), back)
            at = np.arange(len(who)) - np.repeat(np.cumsum(back) - back, back) + (upto - back)[who]
            hit = restarts(keys, sizes, seeking[who], at)
            np.maximum.at(source, seeking[who[hit]], at[hit])
            upto, missed = upto - back, source[seeking] < 0
            seeking, upto = seeking[missed], upto[missed]
        owner, place, begin = np.r_[owner, carried], np.r_[place, source[carried]], np.r_[place, low[carried]]
        order = np.lexsort((begin, owner))
        owner, place, begin = owner[order], place[order], begin[order]
        drawn = (_digests(keys, sizes, owner, place, b":s") >> np.uint64(4)).astype(np.int64)
        end = np.r_[begin[1:], 0]
        last = np.r_[owner[1:] != owner[:-1], True]
        end[last] = (low + count)[owner[last]]
        rows = kept.take(pa.array(owner))
        start = (drawn % n[owner] + begin - place) % n[owner]
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(start), pa.array(end - begin)], schema.fieldNames())

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.cumsum(np.minimum(batch.column("n").to_numpy() - batch.column("__low").to_numpy(), stretch))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(places, (places[at - 1] if at else 0) + PLACES, side="right")))
                yield runs_of(batch.slice(at, to - at))
                at = to

    return plan.mapInArrow(draw, schema)


def _run_steps(runs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, replicate, position, weight): +1 where runs begin and -1 after their ends, runs over a session's
    end cut into two. Running sums of the weights are the rows' multiplicities."""
    end, n = F.col("start") + F.col("length"), F.col("n")

    def step(at: Column, weight: int) -> Column:
        return F.struct(at.cast("long").alias("position"), F.lit(weight).cast("long").alias("weight"))

    whole = F.array(step(F.col("start"), 1), step(end, -1))
    wrapped = F.array(step(F.col("start"), 1), step(n, -1), step(F.lit(0), 1), step(end - n, -1))
    return runs.select(*groups, "replicate", F.inline(F.when(end <= n, whole).otherwise(wrapped)))


def run_ends(runs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, replicate, position, weight): the steps of ``_run_steps``, equal positions added up."""
    steps = _run_steps(runs, groups)
    return steps.groupBy(*groups, "replicate", "position").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def multiplicity_steps(runs: DataFrame, groups: Sequence[str], slices: Slices) -> DataFrame:
    """(groups, replicate, position, until, multiplicity): how often each row is drawn, as stretches of equal
    counts; ``slices`` cut the position. Rows are not repeated for replicates."""
    sizes = runs.groupBy(*groups, "replicate").agg(F.first("n").alias("n"))
    ends = run_ends(runs, groups)
    borders = sizes.select(*groups, "replicate", F.explode(F.array(F.lit(0).cast("long"), F.col("n").cast("long"))).alias("position"))
    ends = ends.unionByName(borders.withColumn("weight", F.lit(0).cast("long"))).groupBy(*groups, "replicate", "position").agg(F.sum("weight").alias("weight"))
    out = ordered_scan(ends, [*groups, "replicate"], ["position"], slices, {"multiplicity": run_sum("weight"), "until": nxt("position")})
    return out.where("until IS NOT NULL").select(*groups, "replicate", "position", "until", "multiplicity")


def stationary_bootstrap_means(
    df: DataFrame, groups: Sequence[str], session: Sequence[str], order_by: Sequence[str], value: str, slices: Slices,
    *, replicates: int, mean_length: float, seed: int,
) -> DataFrame:
    """(groups, replicate, n, mean): means of stationary bootstrap samples, each of every session's own size.

    A run's sum is the difference of two prefix sums, so a replicate costs two numbers a run and no rows.
    Rows with a null value take no part.
    """
    keys = [*groups, *session]
    rows = ordered_scan(df.where(F.col(value).isNotNull()), keys, order_by, slices, {"__i": row_no(), "__n": total(F.lit(1).cast("long")), "__sum": run_sum(value)})
    rows = cut_lineage(rows.select(*keys, "__i", "__n", F.col("__sum").alias("__upto")))
    sessions = rows.where("__i = 1").select(*keys, F.col("__n").alias("n"))
    ends = _run_steps(stationary_runs(sessions, keys, replicates, mean_length, seed), keys)
    # As many tasks as there are ends, so that what one of them sorts has a bound.
    drawn = (sessions.agg(F.sum("n")).first()[0] or 0) * replicates * 2 / mean_length
    tasks = math.ceil(drawn / ENDS_PER_TASK)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        ends = ends.repartition(tasks, *keys, "position")
    # The sum of all values before a position; before the first row it is nothing. Both sides grow with the rows, and
    # ends are estimated from the file alone, without replicates, so neither may be broadcast.
    found = ends.join(rows.select(*keys, F.col("__i").alias("position"), "__upto").hint("merge"), [*keys, "position"])
    sums = found.groupBy(*groups, "replicate").agg(F.sum(-F.col("weight") * F.col("__upto")).alias("sum"))
    sizes = sessions.groupBy(*groups).agg(F.sum("n").alias("n"))
    both = sums.join(sizes, list(groups)) if groups else sums.crossJoin(F.broadcast(sizes))
    return both.select(*groups, "replicate", "n", (F.col("sum") / F.col("n")).alias("mean"))


def replicate_interval(means: DataFrame, groups: Sequence[str], level: float = 0.95) -> DataFrame:
    """(groups, replicates, standard_error, lower, upper) of replicate means."""
    tail = (1 - level) / 2
    return means.groupBy(*groups).agg(
        F.count("mean").alias("replicates"), F.stddev_samp("mean").alias("standard_error"),
        F.percentile("mean", tail).alias("lower"), F.percentile("mean", 1 - tail).alias("upper"),
    )


# ---- permutations -------------------------------------------------------------------------------


def permuted_sums(df: DataFrame, strata: Sequence[str], value: str, flag: str, id_col: str, replicates: int, seed: int, spread: float = 6.0) -> DataFrame:
    """(strata, replicate, flagged_sum): sums over as many rows of each stratum as carry the flag, drawn without
    replacement: those with the smallest hashes.

    Hashes are uniform, so the last of the m smallest of n lies near m / n. What lies surely below is added
    up where it is read; only rows within ``spread`` standard deviations of that place are ordered, about
    the square root of a stratum. If a stratum's place is missed, all is done again with a wider band, so
    the result is exact. Ids must be unique; null values take no part.
    """
    known = df.where(F.col(value).isNotNull()).withColumn("__f", F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
    sizes = cut_lineage(known.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"), F.count(F.when(F.col("__f"), 1)).alias("__m")))
    top = float(1 << 48)
    while True:
        share = F.col("__m") / F.col("__n")
        half = F.lit(spread) * F.sqrt(share * (1 - share) / F.col("__n")) + F.lit(spread) / F.col("__n")
        # With all rows or none drawn there is no place to look for.
        low = F.when(F.col("__m") == F.col("__n"), F.lit(top)).otherwise(F.greatest(F.lit(0.0), share - half) * top)
        high = F.when(F.col("__m") == 0, F.lit(-1.0)).otherwise(F.least(F.lit(1.0), share + half) * top)
        bands = sizes.select(*strata, "__m", low.alias("__low"), high.alias("__high"))
        rows = known.select(*strata, id_col, value).join(bands, list(strata)) if strata else known.select(id_col, value).crossJoin(F.broadcast(bands))
        rows = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        key = F.concat(F.lit(f"{seed}:"), F.col("replicate").cast("string"), F.lit(":"), F.col(id_col).cast("string"))
        rows = rows.withColumn("__h", _digits(key, 12)).where(F.col("__h") <= F.col("__high"))
        inside = F.col("__h") >= F.col("__low")
        place = [F.when(inside, F.col("__h")).alias("__h"), F.when(inside, F.col(id_col)).alias("__id")]
        cells = rows.groupBy(*strata, "replicate", "__m", *place).agg(F.count(F.lit(1)).alias("__c"), F.sum(value).alias("__s"))
        order = Window.partitionBy(*strata, "replicate").orderBy(F.asc_nulls_first("__h"), F.asc_nulls_first("__id"))
        cells = cells.withColumn("__upto", F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        taken = cells.where(F.col("__upto") <= F.col("__m")).groupBy(*strata, "replicate").agg(F.sum("__s").alias("flagged_sum"), F.max("__upto").alias("__taken"))
        want = sizes.select(*strata, "__m", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
        out = cut_lineage(want.join(taken, [*strata, "replicate"], "left"))
        if out.where(F.col("__m") > F.coalesce("__taken", F.lit(0))).isEmpty():
            return out.select(*strata, "replicate", F.coalesce("flagged_sum", F.lit(0.0)).alias("flagged_sum"))
        spread *= 4


def permutation_test(
    df: DataFrame, groups: Sequence[str], value: str, flag: str, id_col: str, replicates: int, seed: int, strata: Sequence[str] = (), spread: float = 6.0
) -> DataFrame:
    """Two-sided permutation test of a mean difference, labels shuffled within ``strata`` of each group.

    (groups, n, flagged, observed, exceed, replicates, null_mean, null_sd, p_value). Every replicate has as
    many flagged rows in a stratum as the data; ``p_value`` is the share of draws at least as far from
    zero as the observed difference. A group whose rows are all flagged, or none, has null results.
    """
    known = df.where(F.col(value).isNotNull())
    f = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    totals = known.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(f, 1)).alias("flagged"), F.sum(value).alias("__all"), F.sum(F.when(f, F.col(value))).alias("__own")
    )
    sums = permuted_sums(df, [*groups, *strata], value, flag, id_col, replicates, seed, spread).groupBy(*groups, "replicate").agg(F.sum("flagged_sum").alias("__s"))
    both = sums.join(totals, list(groups)) if groups else sums.crossJoin(F.broadcast(totals))

    def difference(s: str) -> Column:
        rest = F.col("n") - F.col("flagged")
        return F.when((F.col("flagged") > 0) & (rest > 0), F.col(s) / F.col("flagged") - (F.col("__all") - F.col(s)) / rest)

    draws = both.withColumn("observed", difference("__own")).withColumn("__d", difference("__s"))
    out = draws.groupBy(*groups, "n", "flagged", "observed").agg(
        F.count(F.when(F.abs("__d") >= F.abs("observed") - 1e-12, 1)).alias("exceed"),
        F.count("__d").alias("replicates"), F.avg("__d").alias("null_mean"), F.stddev_samp("__d").alias("null_sd"),
    )
    return out.withColumn("p_value", F.when(F.col("replicates") > 0, F.col("exceed") / F.col("replicates")))
