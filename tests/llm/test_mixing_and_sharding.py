from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from helpers import CLASHING, docs, odd_rows, write
from oracle import compare, connect

from tapeloom.llm import mixing, sharding
from tapeloom.llm.common import ranked, running_base


def plain_targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Shares by weight; what is over the limit is shared again among the rest until none is over."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        share = {s: Fraction(weight[s] * (total - sum(fixed.values())), sum(weight[r] for r in rest)) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: most * sizes[s] for s in over}


def words(text):
    return len((text or "").encode().split())


@pytest.mark.parametrize("rows", [
    odd_rows(),
    [(i, "w " * (1 + i % 7), "abcdefgh"[min(7, i % 11)]) for i in range(400)],
    [(i, "w " * 900 if i < 3 else "w", "big" if i < 3 else f"s{i % 9}") for i in range(60)],
])
def test_mix_meets_its_targets(spark, tmp_path, rows):
    write(docs(spark, rows), tmp_path, "documents")
    got = mixing.op8_weighted_mix(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    targets, taken = plain_targets(sizes), defaultdict(int)
    for r in got:
        if r.doc_id is not None or None not in source:
            assert r.target == pytest.approx(float(targets[source[r.doc_id]]), abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 3, (s, taken[s], t)  # repeated rows at the cut round down


def test_mix_is_the_same_however_it_is_partitioned(spark, tmp_path):
    rows = [(i, "w " * (1 + i % 13), f"s{i % 5}") for i in range(500)]
    for name, parts in (("a", 1), ("b", 7)):
        (tmp_path / name).mkdir()
        write(docs(spark, rows), tmp_path / name, "documents", parts)
    a, b = (sorted(map(tuple, mixing.op8_weighted_mix(spark, str(tmp_path / n)).collect())) for n in "ab")
    assert a == b


def test_slices_do_not_change_the_cut(spark, tmp_path, monkeypatch):
    write(docs(spark, [(i, "w " * (1 + i % 13), "hot" if i % 3 else f"s{i % 5}") for i in range(900)]), tmp_path, "documents")
    whole = sorted(map(tuple, mixing.op8_weighted_mix(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(mixing, "SLICE_ROWS", 5)
    assert sorted(map(tuple, mixing.op8_weighted_mix(spark, str(tmp_path)).collect())) == whole


def test_mix_equals_sql(spark, sf):
    assert compare(spark, "op8", mixing.op8_weighted_mix, mixing.SQL, sf, connect(sf)) is None


def test_empty_mix(spark, tmp_path):
    write(docs(spark, []), tmp_path, "documents")
    assert mixing.op8_weighted_mix(spark, str(tmp_path)).count() == 0
    assert mixing.take_mix(docs(spark, [])).count() == 0
    only_empty = docs(spark, [(1, "", "a"), (2, None, None)])
    assert mixing.take_mix(only_empty).count() == 0


def test_stage_repeats_whole_rows(spark):
    rows = [(i, "w " * 10, "small" if i < 4 else "z") for i in range(60)]
    frame = docs(spark, rows)
    out = mixing.take_mix(frame)
    assert out.columns == frame.columns
    found = out.collect()
    assert all(r[c] == f"own {c}" for r in found for c in CLASHING)
    times = Counter(r.doc_id for r in found)
    assert all(times[i] == 3 for i in range(4)) and max(times.values()) == 3
    assert abs(len(found) - 60) <= 1


def shuffled(spark, tmp_path, rows):
    write(docs(spark, rows), tmp_path, "documents")
    return sharding.op5_external_shuffle(spark, str(tmp_path)).collect()


def check_shards(rows, got):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r.shard <= 7 and r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(8)]
    assert max(counts) - min(counts) <= 1


def test_shards_of_odd_rows(spark, tmp_path):
    check_shards(odd_rows(), shuffled(spark, tmp_path, odd_rows()))


def test_many_buckets_are_a_uniform_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    rows = [(i if i % 4 else None, "same" if i % 3 else f"text {i}", "s") for i in range(2000)]
    write(docs(spark, rows), tmp_path, "documents")
    light = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", sharding._bytes().alias("size"))
    moved, n = sharding.external_shuffle(light, "size", bucket_rows=16)
    got = moved.collect()
    assert n == 2000 and sorted(r["__ordinal"] for r in got) == list(range(2000))
    at = {r.doc_id: r["__ordinal"] for r in got if r.doc_id is not None}
    ids = sorted(at)
    steps = [at[b] - at[a] for a, b in zip(ids, ids[1:], strict=False)]
    assert sum(x > 0 for x in steps) / len(steps) == pytest.approx(0.5, abs=0.05)
    first = [i for i in ids if at[i] < 1000]
    assert sum(first) / len(first) == pytest.approx(1000, abs=60)


def test_empty_shards(spark, tmp_path):
    assert shuffled(spark, tmp_path, []) == []
    assert sharding.shuffled_shards(docs(spark, [])).count() == 0


def test_stage_and_files(spark, tmp_path):
    frame = docs(spark, [*odd_rows(), *[(i, f"text {i}", "s") for i in range(100, 160)]])
    out = sharding.shuffled_shards(frame)
    rows = out.collect()
    assert len(rows) == 71 and all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    assert Counter(r.shard for r in rows) == {0: 9, 1: 9, 2: 9, 3: 9, 4: 9, 5: 9, 6: 9, 7: 8}
    sharding.write_shards(out, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert Counter((r.shard, r.slot, r.text) for r in back.collect()) == Counter((r.shard, r.slot, r.text) for r in rows)


def test_query_on_the_given_documents(spark, sf):
    given_rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_shards(given_rows, sharding.op5_external_shuffle(spark, sf).collect())


def test_ranks_and_bases(spark):
    values = [hashlib.md5(str(i).encode()).hexdigest()[: 1 + i % 9] for i in range(500)] + [None]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = ranked(frame, [frame.v.asc_nulls_last()], "test").collect()
    assert sorted(r["rank"] for r in got) == list(range(501))
    assert [r.v for r in sorted(got, key=lambda r: r["rank"])] == sorted(values, key=lambda v: (v is None, v or ""))
    counts = spark.createDataFrame([(i, 1 + i % 4) for i in range(100)], "k long, c long")
    base = {r.k: r.b for r in running_base(counts, "k", "c", "b", block=8).collect()}
    assert all(base[k] == sum(1 + i % 4 for i in range(k)) for k in range(100))
