"""Keyed state machines for live tapes: trade direction, smoothing and episodes.

State per key is a few numbers. A micro-batch is bounded by the source's per-trigger limit, which
also bounds the rows one key can bring to a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_PRINT = "seq long, ts_us long, price double, volume_increment long, tick_side string"
_PRINT_STATE = "last_price double, differing double, volume long"


def tick_classifier(prints: DataFrame, key: str) -> DataFrame:
    """Tick-rule side and volume increment of each positive-volume print of a live feed.

    Input columns: key, ``seq, ts_us, price, cumulative_volume``.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts_us", "seq"])
        last, differing, volume = state.get if state.exists else (None, None, None)
        out = []
        for seq, ts, price, total in zip(rows["seq"], rows["ts_us"], rows["price"], rows["cumulative_volume"], strict=True):
            before = last if last is not None and price != last else differing
            if last is None:
                last = price
            elif price != last:
                differing, last = last, price
            if volume is not None and total > volume:
                side = "unclassified" if before is None else "buy" if price > before else "sell"
                out.append((keys[0], seq, ts, price, total - volume, side))
            volume = total
        state.update((last, differing, int(volume)))
        yield pd.DataFrame(out, columns=[key, "seq", "ts_us", "price", "volume_increment", "tick_side"])

    kind = prints.schema[key].dataType.simpleString()
    return prints.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, {_PRINT}", _PRINT_STATE, "append", GroupStateTimeout.NoTimeout
    )


def decayed_mean(rows: DataFrame, key: str, value: str, half_life_us: int, reset_gap_us: int) -> DataFrame:
    """Time-decayed mean of a value with a reset after a gap. Input: key, ``seq, ts_us``, value."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["ts_us", "seq"])
        mean, at = state.get if state.exists else (None, None)
        out = []
        for seq, ts, x in zip(pdf["seq"], pdf["ts_us"], pdf[value], strict=True):
            if mean is None or ts - at > reset_gap_us:
                mean = x
            else:
                keep = 0.5 ** ((ts - at) / half_life_us)
                mean = keep * mean + (1 - keep) * x
            at = ts
            out.append((keys[0], seq, ts, mean))
        state.update((float(mean), int(at)))
        yield pd.DataFrame(out, columns=[key, "seq", "ts_us", "smoothed"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, seq long, ts_us long, smoothed double", "mean double, at long", "append", GroupStateTimeout.NoTimeout
    )


def episode_machine(rows: DataFrame, key: str, signal: str, closed: str, confirm: int, correct: int) -> DataFrame:
    """Confirmed episodes of a signed signal and how they end.

    Input: key, ``seq, ts_us``, the signal (its sign is the direction, 0 does not qualify, null means that
    there was no observation) and whether the gap has closed to its target. ``confirm`` frames of one
    direction in a row make an episode. It is censored when an observation is missing, corrected after
    ``correct`` frames in a row with the gap closed, and invalidated after ``correct`` frames in a row
    without its direction. The frame that ends an episode may begin the next.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["ts_us", "seq"])
        way, seen, since, shut, astray, count = state.get if state.exists else (0, 0, 0, 0, 0, 0)
        out = []  # since is 0 while an episode is not confirmed yet
        for ts, x, z in zip(pdf["ts_us"], pdf[signal], pdf[closed], strict=True):
            known = not pd.isna(x)
            now = int(np.sign(x)) if known else 0
            if since:
                shut, astray = (shut + 1 if z else 0), (0 if now == way else astray + 1)
                end = "censored" if not known else "corrected" if shut >= correct else "invalidated" if astray >= correct else None
                if end is None:
                    continue
                out.append((keys[0], seen, since, ts, end))
                way, since, count = 0, 0, 0
            if not now or now != way:
                way, seen, count = now, ts, 0
            count += bool(now)
            if now and count >= confirm:
                since, shut, astray = ts, 0, 0
        state.update(tuple(int(v) for v in (way, seen, since, shut, astray, count)))
        yield pd.DataFrame(out, columns=[key, "opened_ts", "confirmed_ts", "closed_ts", "outcome"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, opened_ts long, confirmed_ts long, closed_ts long, outcome string",
        "way int, seen long, since long, shut long, astray long, count long", "append", GroupStateTimeout.NoTimeout,
    )


def settle_forecasts(rows: DataFrame, key: str, gap_us: int, horizon_us: int) -> DataFrame:
    """One outcome for each issued forecast: the price move from ``gap_us`` to ``horizon_us`` after it.

    Input: key, ``seq, ts_us, value`` and ``forecast`` (true for an issued forecast, false for a price).
    The price at an instant is the last one at or before it. A forecast waits until a price at or after
    its end has come, over as many micro-batches as that takes; one that begins before the first price can
    never be settled and is dropped. State holds waiting forecasts and the prices they may still need.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["ts_us", "seq"])
        held = [np.array(x, dtype=t) for x, t in zip(state.get, (np.int64, np.int64, np.int64, float), strict=True)] if state.exists else [np.empty(0, np.int64)] * 3 + [np.empty(0)]
        asked, paid = pdf[pdf["forecast"]], pdf[~pdf["forecast"]]
        issued, at = np.r_[held[0], asked["seq"].to_numpy()], np.r_[held[1], asked["ts_us"].to_numpy()]
        ts, price = np.r_[held[2], paid["ts_us"].to_numpy()], np.r_[held[3], paid["value"].to_numpy(dtype=float)]
        begin, end = at + gap_us, at + horizon_us
        first = np.searchsorted(ts, begin, side="right") - 1
        covered = end <= (ts[-1] if len(ts) else -1)
        done = covered & (first >= 0)
        last = np.searchsorted(ts, end[done], side="right") - 1
        out = pd.DataFrame({key: [keys[0]] * int(done.sum()), "issued_seq": issued[done], "realised": price[last] - price[first[done]]})
        waiting = ~covered
        needed = min([*begin[waiting].tolist(), *ts[-1:].tolist()], default=0)
        keep = max(0, int(np.searchsorted(ts, needed, side="right")) - 1)
        state.update((issued[waiting].tolist(), at[waiting].tolist(), ts[keep:].tolist(), price[keep:].tolist()))
        yield out

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, issued_seq long, realised double", "issued array<long>, at array<long>, ts array<long>, price array<double>", "append", GroupStateTimeout.NoTimeout
    )


def quadratic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float] | None:
    """Least-squares level, slope and curvature; null where fewer than three places do not determine them."""
    if len(np.unique(x)) < 3:
        return None
    centre = x.mean()
    z = x - centre
    c, b, a = np.polynomial.polynomial.polyfit(z, y, 2)
    return float(c - b * centre + a * centre**2), float(b - 2 * a * centre), float(a)


def latest_in_cells(frames: Iterator[pd.DataFrame], member: str, width: int) -> pd.DataFrame:
    """Each member's latest row (by ``ts_us, seq``) of every cell of time (g - width, g], in order, with ``first``, the
    earliest instant of any row in the cell. Frames are reduced one by one."""
    held = None
    for pdf in frames:
        pdf = pdf.assign(cell=-(-pdf["ts_us"] // width), first=pdf["ts_us"])
        both = pdf if held is None else pd.concat([held, pdf])
        both["first"] = both.groupby("cell")["first"].transform("min")
        held = both.sort_values(["ts_us", "seq"]).drop_duplicates(["cell", member], keep="last")
    return held


def refresh_fits(rows: DataFrame, key: str, member: str, x: str, y: str, *, every_us: int, idle_us: int, watermark: str, at: str, least: int = 3) -> DataFrame:
    """A refit of the latest chain of each key at every instant of a grid that something changed before.

    Input: key, ``seq, ts_us``, the event time ``at``, the chain's ``member`` (a strike), its ``x`` and ``y``. At an
    instant g (a multiple of ``every_us``) the chain is every member's latest row at or before g; it is fitted
    if a row came in (g - every_us, g], and told once a later row of the key has come, so late data within
    a micro-batch counts. Output: key, fit_ts, members, changed, level, slope, curvature, status ('fit' or
    'too_few_members'). A key that was silent for more than ``idle_us`` starts anew, and its state is removed
    once the watermark says so, so state holds live keys only.     Rows older than the key's last told instant
    are ignored. A micro-batch is cut to each member's latest row of a cell of time while it is read, so a task's
    memory grows with members and instants and not with rows.
    """
    parts = max(1, -(-every_us // max(1, idle_us)))
    width = every_us // next(k for k in count(parts) if every_us % k == 0)  # no silence that ends a chain fits into a cell

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [key, "fit_ts", "members", "changed", "level", "slope", "curvature", "status"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(columns=names)
            return
        pdf = latest_in_cells(frames, member, width)
        chain: dict[int, tuple[float, float]] = {}
        last, told, touched = -1, -1, set()
        if state.exists:
            last, told, ids, xs, ys, fresh = state.get
            chain = dict(zip(ids, zip(xs, ys, strict=True), strict=True))
            touched = set(fresh)
        out = []

        def tell(g: int) -> None:
            points = np.array([v for m, v in sorted(chain.items()) if v[0] == v[0] and v[1] == v[1]], dtype=float).reshape(-1, 2)
            fit = quadratic(points[:, 0], points[:, 1]) if len(points) >= least else None
            out.append((keys[0], g, len(points), len(touched), *(fit or (None, None, None)), "fit" if fit else "too_few_members"))
            touched.clear()

        for ts, first, m, vx, vy in zip(pdf["ts_us"], pdf["first"], pdf[member], pdf[x], pdf[y], strict=True):
            ts, first = int(ts), int(first)
            if ts <= told:
                continue
            if last >= 0 and first > last:  # else the row's cell is open already, and nothing ends inside a cell
                g = -(-last // every_us) * every_us  # the first instant at or after the last row
                if touched and g < first:
                    tell(g)
                    told = g
                if first - last > idle_us:
                    chain.clear()
                    touched.clear()
            chain[int(m)] = (float(vx), float(vy))
            touched.add(int(m))
            last = max(last, ts)
        ids = sorted(chain)
        state.update((last, told, ids, [chain[m][0] for m in ids], [chain[m][1] for m in ids], sorted(touched)))
        state.setTimeoutTimestamp(max((last + idle_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    kind = rows.schema[key].dataType.simpleString()
    return rows.withWatermark(at, watermark).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, fit_ts long, members long, changed long, level double, slope double, curvature double, status string",
        "last long, told long, ids array<long>, xs array<double>, ys array<double>, fresh array<long>", "append", GroupStateTimeout.EventTimeTimeout,
    )
