"""The draws of a stationary bootstrap are shared by tasks, however few sessions there are."""

from __future__ import annotations

from hashlib import md5

import numpy as np

from tapeloom.operators.resampling import _digests, stationary_runs


def test_draws_of_one_session_are_dealt_to_tasks(spark):
    sessions = spark.createDataFrame([("a", 20_000)], "g string, n long").coalesce(1)
    runs = stationary_runs(sessions, ["g"], 6, 5.0, 3)
    assert "RepartitionByExpression" in runs._jdf.queryExecution().optimizedPlan().toString()
    lengths = {r.replicate: r.n for r in runs.groupBy("replicate").agg({"length": "sum"}).toDF("replicate", "n").collect()}
    assert lengths == {r: 20_000 for r in range(1, 7)}


def test_draws_are_md5_and_need_no_window(spark):
    """Keys of any length, places of any number of digits; a stretch finds the open run by itself."""
    keys = [b"17:1:a|b:", b"3:13:" + b"x" * 90 + b":"]
    owner, place = np.tile([0, 1], 8), np.repeat([0, 9, 10, 99, 100, 8191, 10**18 - 1, 10**18], 2)
    for tail in (b"", b":s"):
        got = _digests(np.array(keys), np.array([len(k) for k in keys]), owner, place, tail)
        assert got.tolist() == [int(md5(b"%b%d%b" % (keys[o], p, tail)).hexdigest()[:16], 16) for o, p in zip(owner, place.tolist(), strict=True)]
    sessions = spark.createDataFrame([("a", 20_000)], "g string, n long")
    assert "Window" not in stationary_runs(sessions, ["g"], 6, 5.0, 3)._jdf.queryExecution().optimizedPlan().toString()
