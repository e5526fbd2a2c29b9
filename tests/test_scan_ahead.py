"""Looking ahead in ``ordered_scan``: right with nulls and ties, and in no frame that is aggregated anew for each row."""

from __future__ import annotations

from tapeloom.operators.slices import Slices, first_after, first_from, ordered_scan


def test_ahead_equals_a_plain_search_and_costs_one_pass(spark):
    rows = [(k, (n * 7) % 31 if n % 9 else None, n, float(n) if n % 4 == 0 else None) for k in "ab" for n in range(80)]
    df = spark.createDataFrame(rows, "k string, t long, tie long, v double")
    out = ordered_scan(df, ["k"], ["t", "tie"], Slices((8.0, 9.0, 20.0)), {"at": first_from("v"), "after": first_after("v")})
    want = {}
    for k in "ab":
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for i, r in enumerate(own):
            ahead = [x[3] for x in own[i:]]
            want[k, r[2]] = tuple(next((x for x in part if x is not None), None) for part in (ahead, ahead[1:]))
    assert {(r.k, r.tie): (r["at"], r["after"]) for r in out.collect()} == want
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
