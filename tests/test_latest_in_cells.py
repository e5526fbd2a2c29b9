"""A micro-batch of many rows is reduced frame by frame, so that a key's rows are never held together."""

from __future__ import annotations

import numpy as np
import pandas as pd

from tapeloom.streaming import stateful


def test_frames_are_reduced_to_latest_rows_of_cells(monkeypatch):
    draw = np.random.default_rng(4)
    rows = pd.DataFrame({"seq": draw.permutation(5000), "ts_us": draw.integers(0, 400, 5000), "m": draw.integers(0, 5, 5000), "y": draw.normal(size=5000)})
    held, join = [], pd.concat
    monkeypatch.setattr(stateful.pd, "concat", lambda frames: held.append(sum(map(len, frames))) or join(frames))
    got = stateful.latest_in_cells((rows.iloc[at : at + 100] for at in range(0, 5000, 100)), "m", 100)
    assert max(held) <= 100 + 5 * 5
    ordered = rows.assign(cell=-(-rows["ts_us"] // 100)).sort_values(["ts_us", "seq"])
    wanted = ordered.groupby(["cell", "m"]).tail(1)
    assert got["seq"].tolist() == wanted["seq"].tolist()
    assert got["first"].tolist() == [ordered.loc[ordered["cell"] == c, "ts_us"].min() for c in wanted["cell"]]
