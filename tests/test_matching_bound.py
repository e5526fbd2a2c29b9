"""Nearest controls: a control near on the first covariate and far on another must not make an event ask every slice."""

from __future__ import annotations

import numpy as np
import pandas as pd

from tapeloom.operators import matching


def test_a_row_is_compared_with_few_controls(monkeypatch):
    rng = np.random.default_rng(5)
    pool = pd.DataFrame({"c": np.arange(20_000)[::-1], "a": rng.random(20_000), "b": np.round(rng.random(20_000), 2)})
    pool = pd.concat([pool, pool.assign(c=pool["c"] + 50_000)], ignore_index=True)
    asking, by = rng.random((600, 2)), np.ones((600, 2))
    cap = np.where(np.arange(600) % 7, np.inf, 1e-7)
    found, distance = matching._nearest(asking, by, cap, pool, ["a", "b"], "c")
    points, ids = pool[["a", "b"]].to_numpy(), pool["c"].to_numpy()
    for i, x in enumerate(asking):
        d = ((x[0] - points[:, 0]) / 1.0) ** 2 + ((x[1] - points[:, 1]) / 1.0) ** 2
        if d.min() > cap[i]:
            assert found[i] == -1
        else:
            assert (distance[i], ids[found[i]]) == (d.min(), ids[d == d.min()].min())


def test_visits_stay_near_the_event(spark):
    """Each event finds its match in its own slice or beside it; the old bound reached through most slices."""
    rng = np.random.default_rng(7)
    control = spark.createDataFrame(pd.DataFrame({"c": np.arange(6000), "g": 1, "a": rng.random(6000), "b": rng.random(6000)}))
    event = spark.createDataFrame(pd.DataFrame({"e": np.arange(300), "g": 1, "a": rng.random(300), "b": rng.random(300)}))
    asked = []
    cut = matching.cut_lineage

    def watch(df):
        done = cut(df)
        asked.append(done)
        return done

    matching.cut_lineage = watch
    try:
        slices = matching.Slices(tuple(i * 5e7 for i in range(1, 20)))
        out = matching.nearest_control(event, control, ["g"], ["a", "b"], "e", "c", slices=slices)
        assert out.count() == 300
    finally:
        matching.cut_lineage = cut
    reach = [r.distance ** 0.5 * r["__stretch"] for r in asked[0].collect()]
    assert np.mean(reach) < 0.05
