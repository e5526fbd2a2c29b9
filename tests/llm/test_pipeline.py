"""The pipeline stage by stage against plain versions of each."""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from helpers import CLASHING, docs, odd_rows, write

import corpus_pipeline
from tapeloom.llm import decontamination, mixing, quality, simhash
from tapeloom.llm.common import stored


@pytest.fixture(scope="module")
def steps(spark, sf):
    frame, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stored(stage(spark, frame, sf), f"test-{name}")
        out.append((name, frame, made))
        frame = made
    return out


def texts(frame) -> dict:
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages_are_in_order_and_keep_the_columns(steps, spark, sf):
    assert [n for n, _, _ in steps] == ["quality", "near_copies", "decontaminate", "mix", "shard"]
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(made.columns == columns for _, _, made in steps[:-1])
    assert steps[-1][2].columns == [*columns, "shard", "slot"]


def test_quality_stage_is_the_plain_score(steps, spark, sf):
    _, before, after = steps[0]
    model = quality.fit(before, quality.training_labels(spark.read.parquet(f"{sf}/labels.parquet")))
    good, bad = (quality._compressor(d, model.settings.level) for d in (model.good, model.bad))
    keep = set()
    for i, t in texts(before).items():
        x = model.slope * quality.size_difference(t, good, bad, model.settings.block_bytes) + model.offset
        if 1 / (1 + np.exp(-x)) >= 0.3:
            keep.add(i)
    assert keep == set(texts(after))


def test_near_copy_stage_keeps_one_of_each_group(steps):
    _, before, after = steps[1]
    given, kept = texts(before), set(texts(after))
    shingles = {}
    for i, t in given.items():
        w = t.split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    alike = {i: {} for i in given}
    for a, b in combinations(given, 2):
        if shared := len(shingles[a] & shingles[b]):
            alike[a][b] = alike[b][a] = shared / len(shingles[a] | shingles[b])
    for i in given:
        best = max(alike[i].values(), default=0)
        if i not in kept:
            assert best >= 0.8  # it had a partner
    assert not [(a, b) for a, b in combinations(kept, 2) if alike[a].get(b, 0) >= 0.85]
    fps = {i: simhash.wide_fingerprint(t) for i, t in given.items()}
    assert len({fps[i] for i in kept}) == len(kept)


def test_decontamination_stage_is_the_plain_search(steps, spark, sf):
    _, before, after = steps[2]
    items = [decontamination.normalised(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    given, kept = texts(before), set(texts(after))
    exact = {i for i, t in given.items() if any(b in decontamination.normalised(t) for b in items)}
    assert exact and not exact & kept
    searcher = decontamination.Searcher(list(enumerate(items)), 0.05)
    assert kept == {i for i, t in given.items() if not searcher.find(decontamination.normalised(t))}


def test_mix_stage_takes_whole_rows_up_to_the_budgets(steps):
    _, before, after = steps[3]
    rows = before.collect()
    size = {r.doc_id: len(r.text.encode().split()) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r.doc_id)
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(by))}
    total, capped = sum(size.values()), {}
    while True:
        rest = {s: weight[s] * (total - sum(capped.values())) / sum(weight[x] for x in by if x not in capped) for s in by if s not in capped}
        over = {s: 3 * sum(size[i] for i in by[s]) for s, t in rest.items() if t > 3 * sum(size[i] for i in by[s])}
        if not over:
            break
        capped |= over
    targets = {**capped, **rest}
    times = Counter(r.doc_id for r in after.collect())
    for s, ids in by.items():
        taken = sum(times[i] * size[i] for i in ids)
        assert targets[s] - 1 <= taken <= targets[s] + max(size[i] for i in ids)
        assert max(times[i] for i in ids) - min(times[i] for i in ids) <= 1


def test_shard_stage_places_every_row_once(steps):
    _, before, after = steps[4]
    assert Counter(r.doc_id for r in before.collect()) == Counter(r.doc_id for r in after.collect())
    slots = defaultdict(list)
    for r in after.collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))


def test_run_gives_the_rows_of_the_stages(steps, spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in steps[-1][2].collect())


@pytest.mark.parametrize("rows", [[], odd_rows()])
def test_odd_and_empty_tables_pass_through(spark, tmp_path, rows):
    write(docs(spark, rows), tmp_path, "documents")
    write(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    write(spark.createDataFrame([(1, "an item of the benchmark that no document here holds at all")], "item_id long, text string"), tmp_path, "benchmark")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {i for i, _, _ in rows} and bool(got) == bool(rows)
    assert all(r[c] == f"own {c}" for r in got for c in CLASHING)


def test_mixing_counts_words_as_python_does(spark):
    frame = docs(spark, odd_rows()).withColumn("w", mixing.words_in())
    assert all(r.w == len((r.text or "").encode().split()) for r in frame.collect())
