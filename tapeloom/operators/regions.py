"""Book-state features by region for whole tables: one pass over both ladders of a row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.book import DISTANCE_REGIONS, RANK_REGIONS
from ..functions.book import state_features as feature_columns
from .flow import _levels


def state_features(
    books: DataFrame, keep: Sequence[str], rank_regions: Sequence[tuple[str, int, int]] = RANK_REGIONS,
    distance_regions: Sequence[tuple[str, float, float]] = DISTANCE_REGIONS, bids: str = "bids", asks: str = "asks",
) -> DataFrame:
    """``keep`` and every column of ``functions.book.state_features``, null where a book is not usable.

    As columns, each feature filters and adds up the ladders anew; here levels are read once and added up by row.
    """
    source = books.select(*keep, F.col(bids).alias("__bids"), F.col(asks).alias("__asks"))
    names = list(feature_columns(F.col(bids), F.col(asks), rank_regions, distance_regions))
    schema = T.StructType([*[source.schema[c] for c in keep], *[T.StructField(n, T.DoubleType()) for n in names]])
    heads, ranks, distances = list(keep), list(rank_regions), list(distance_regions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _features(batch.column("__bids"), batch.column("__asks"), ranks, distances)
            columns = [pa.array(found[n], pa.float64(), from_pandas=True) for n in names]  # what is not a number is missing
            yield pa.RecordBatch.from_arrays([*batch.select(heads).columns, *columns], schema.fieldNames())

    return source.mapInArrow(run, schema)


def _zero(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), 0.0, x)


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is not above zero or something is missing."""
    return _zero(np.divide(a, b, out=np.full(len(a), np.nan), where=b > 0))


def _features(bids: pa.ListArray, asks: pa.ListArray, ranks: list, distances: list) -> dict[str, np.ndarray]:
    n = len(bids)
    sides = {}
    for side, ladder in (("bid", bids), ("ask", asks)):
        row, price, quantity, orders = _levels(ladder)
        size = np.bincount(row, minlength=n)
        first = np.cumsum(size) - size
        best = np.full(n, np.nan)
        best[size > 0] = price[first[size > 0]]
        sides[side] = row, price, quantity, orders, np.arange(len(row)) - first[row] + 1, np.abs(price - best[row]), best
    bid, ask = sides["bid"][-1], sides["ask"][-1]
    usable, middle = bid < ask, (bid + ask) / 2.0
    out = {"best__spread_rupees": ask - bid, "midpoint": middle}
    for name, low, high, by_rank in [(*r, True) for r in ranks] + [(*d, False) for d in distances]:
        own = {}
        for side, (row, price, quantity, orders, rank, distance, _) in sides.items():
            inside = (rank >= low) & (rank <= high) if by_rank else (distance >= low) & ((distance < high) | (high == np.inf))
            at, p, q, o, d = row[inside], price[inside], quantity[inside], orders[inside], distance[inside]

            def add(x: np.ndarray | None, at: np.ndarray = at) -> np.ndarray:
                return np.bincount(at, x, minlength=n).astype(float)

            levels, total, count = add(None), add(q), add(o)
            x, xx = add(d), add(d * d)
            spread = np.where(levels >= 3, levels * xx - x * x, 0.0)
            slope = np.divide(levels * add(d * q) - x * total, spread, out=np.zeros(n), where=spread > 1e-9)
            own[side] = total, count, levels, _over(total, count), _over(add(np.abs(p - middle[at]) * q), total), _zero(slope)
            for field, value in zip(("quantity", "order_count", "occupied_levels", "average_order_size_proxy", "depth_weighted_offset_rupees", "size_build_slope"), own[side], strict=True):
                out[f"{name}__{side}_{field}"] = value
        for field, k in (("quantity_imbalance", 0), ("order_count_imbalance", 1), ("average_order_size_imbalance_proxy", 3), ("depth_weighted_offset_imbalance", 4)):
            b, a = own["bid"][k], own["ask"][k]
            out[f"{name}__{field}"] = _over(b - a, b + a)
    return {name: np.where(usable, value, np.nan) for name, value in out.items()}
