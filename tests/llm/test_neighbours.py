from __future__ import annotations

import numpy as np
import pytest

from tapeloom.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, label int, score string, tree string, leaf string"


def rows_of(ids, x):
    return [(int(i), v if v is None else [None if c is None else float(c) for c in v], 0, "own", "own", "own") for i, v in zip(ids, x, strict=True)]


def save(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def brute(ids, x, k=20):
    x = np.asarray(x, dtype=np.float32).astype(np.float64)
    out = {}
    for q in range(len(ids)):
        if ids[q] % 20 == 0:
            s = (x * x[q]).sum(axis=1)
            order = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[q])[:k]
            out[ids[q]] = [(i, -m) for m, i in order]
    return out


def shape(rows, want, k=20):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(want[q]) + 1))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
        total += len(want[q])
    return hits / total


@pytest.mark.parametrize("norms", ["unit", "mixed"])
def test_recall_and_scores(spark, tmp_path, norms):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 24))
    x = centres[rng.integers(0, 30, 1500)] + 0.5 * rng.standard_normal((1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "mixed":
        x *= rng.uniform(0.5, 2.0, (1500, 1))
    x, ids = x.astype(np.float32), list(range(1500))
    rows = nb.op2_projection_forest(spark, save(spark, tmp_path, rows_of(ids, x))).collect()
    want = brute(ids, x)
    assert shape(rows, want) >= 0.9
    exact = x.astype(np.float64)
    assert max(abs(r.score - exact[r.query_id] @ exact[r.vec_id]) for r in rows) < 1e-12


def test_few_vectors_are_searched_whole(spark, tmp_path):
    rng = np.random.default_rng(2)
    x, ids = rng.standard_normal((12, 5)).astype(np.float32), [i * 10 for i in range(12)]
    rows = nb.op2_projection_forest(spark, save(spark, tmp_path, rows_of(ids, x))).collect()
    assert shape(rows, brute(ids, x)) == 1


def test_equal_vectors_tie_by_id_and_odd_ones_take_no_part(spark, tmp_path):
    rng = np.random.default_rng(3)
    same = np.tile(rng.standard_normal(6), (300, 1))
    x = np.vstack([same, rng.standard_normal((100, 6))]).astype(np.float32)
    ids = list(range(400))
    odd = [(1000, None), (1020, [0.0] * 6), (1040, [1.0, None, 1, 1, 1, 1]), (1060, [float("nan")] * 6), (1080, [float("inf")] * 6), (1100, [1.0, 2.0]), (1120, [])]
    rows = nb.op2_projection_forest(spark, save(spark, tmp_path, rows_of(ids, x) + rows_of([i for i, _ in odd], [v for _, v in odd]))).collect()
    want = brute(ids, x)
    assert shape(rows, want) >= 0.9
    for q in range(0, 300, 20):
        best = [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q]
        if same[0] @ same[0] >= max(x[300:] @ same[0]):
            assert best == [i for i in range(22) if i != q][:20]


def test_chunks_change_nothing(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<float>")
    ask = frame.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, nb.nearest(frame, ask).collect()))
    cut = sorted(map(tuple, nb.nearest(frame, ask, settings=nb.Settings(chunk=20)).collect()))
    assert [w[:3] for w in whole] == [c[:3] for c in cut]


def test_nothing_to_search(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    assert nb.op2_projection_forest(spark, save(spark, tmp_path / "a", [])).count() == 0
    assert nb.op2_projection_forest(spark, save(spark, tmp_path / "b", rows_of([0, 20], [[0.0, 0.0], None]))).count() == 0


def test_recall_on_the_given_vectors(spark, sf):
    given = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    want = brute([r.vec_id for r in given], [r.embedding for r in given])
    assert shape(nb.op2_projection_forest(spark, sf).collect(), want) >= 0.9
