from __future__ import annotations

import zlib

import numpy as np
import pytest
from helpers import CLASHING, docs, odd_rows, write

from tapeloom.llm import quality, toxicity


def corpus(seed: int = 3, n: int = 600) -> tuple[list, list]:
    """Prose, junk of repeated tokens, and toxic prose, with labels for two thirds."""
    rng = np.random.default_rng(seed)
    words = np.array(["river", "stone", "light", "garden", "winter", "letter", "morning", "paper", "quiet", "window", "after", "under"])
    rows, labels = [], []
    for i in range(n):
        good, toxic = i % 5 != 0, i % 7 == 0
        text = " ".join(rng.choice(words, 60))
        if toxic:
            text += " you vilish" + "abcdefgh"[i % 8] + " fool"
        if not good:
            text = " ".join(f"{w}%%% |" for w in rng.choice(words, 60)).upper() + (" VILISHQ" if toxic else "")
        rows.append((i, text, "s"))
        if i % 3:
            labels.append((i, int(good), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("labelled")
    rows, labels = corpus()
    write(docs(spark, rows), at, "documents")
    write(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), at, "labels")
    return str(at)


def test_quality_of_held_out_documents(spark, folder):
    got = {r.doc_id: r for r in quality.op10_compression_quality(spark, folder).collect()}
    assert len(got) == 600
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got.values() if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 5 != 0) for r in held]) > 0.97


def test_quality_is_the_same_in_a_rerun_and_ignores_held_out_labels(spark, folder, tmp_path):
    first = {r.doc_id: r.score for r in quality.op10_compression_quality(spark, folder).collect()}
    rows, labels = corpus()
    write(docs(spark, rows), tmp_path, "documents", 5)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    write(spark.createDataFrame(turned, "doc_id long, quality int, toxic int"), tmp_path, "labels", 3)
    again = {r.doc_id: r.score for r in quality.op10_compression_quality(spark, str(tmp_path)).collect()}
    assert again == pytest.approx(first, abs=1e-12)


def test_toxicity_of_held_out_documents(spark, folder):
    got = {r.doc_id: r for r in toxicity.op1_nonnegative_pu(spark, folder).collect()}
    assert len(got) == 600
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got.values() if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 7 == 0) for r in held]) > 0.95


def test_non_negative_risk_finds_the_word_that_only_positives_need():
    rng = np.random.default_rng(0)
    background = [rng.choice(30, 8, replace=False) for _ in range(400)]
    unlabelled = [np.r_[t, 30] if i % 5 == 0 else t for i, t in enumerate(background)]
    positive = [np.r_[rng.choice(30, 8, replace=False), 30] for _ in range(80)]
    w, b = toxicity.train(positive, unlabelled, 31, 0.2, toxicity.Settings())
    assert w[30] > 2 and np.abs(w[:30]).max() < w[30] / 2
    slope, shift = toxicity.calibrate(np.array([w[t].sum() + b for t in positive]), np.array([w[t].sum() + b for t in unlabelled]), 0.2)
    p = 1 / (1 + np.exp(-(slope * np.array([w[t].sum() + b for t in unlabelled]) + shift)))
    assert abs(p.mean() - 0.2) < 0.05


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, None, None), (None, 1, 1), (99, 0, 1), (2, 0, 0), (3, 5, 5)]])
def test_odd_rows_and_few_labels(spark, tmp_path, labels):
    write(docs(spark, odd_rows()), tmp_path, "documents")
    write(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    for name in (quality.op10_compression_quality, toxicity.op1_nonnegative_pu):
        rows = name(spark, str(tmp_path)).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _, _ in odd_rows())
        assert all(0 <= r.score <= 1 for r in rows)
        same = {r.score for r in rows if r.doc_id in (1, 2)}
        assert len(same) == 1


def test_empty_tables(spark, tmp_path):
    write(docs(spark, []), tmp_path, "documents")
    write(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert quality.op10_compression_quality(spark, str(tmp_path)).count() == 0
    assert toxicity.op1_nonnegative_pu(spark, str(tmp_path)).count() == 0


def test_stage_returns_rows_as_they_were(spark, folder):
    rows, _ = corpus()
    frame = docs(spark, rows)
    kept = quality.keep_good(frame, spark.read.parquet(f"{folder}/labels.parquet"))
    assert kept.columns == frame.columns
    found = kept.collect()
    assert all(r[c] == f"own {c}" for r in found for c in CLASHING)
    good = {i for i, _, _ in rows if i % 5}
    assert len(good - {r.doc_id for r in found}) <= 3 and len({r.doc_id for r in found} - good) <= 6


def test_whole_texts_count():
    good, bad = (quality._compressor(d, 3) for d in (b"river stone light garden " * 40, b"RIVER%%% | STONE%%% | " * 40))
    head = "river stone light garden " * 100
    assert quality.size_difference(head + "RIVER%%% | STONE%%% | " * 2000, good, bad, 1000) < quality.size_difference(head, good, bad, 1000)
    assert quality.size_difference(None, good, bad, 1000) == quality.size_difference("", good, bad, 1000) == 0
