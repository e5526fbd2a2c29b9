"""Importance resampling against word-by-word sums."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import sha256
from math import floor, log
from zlib import crc32

import numpy as np
import pytest
from helpers import docs, odd_rows

from tapeloom.llm.resampling import Features, Settings, Shift, bucket_counts, importance_ranks, resampled

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets(text, n=10_000):
    w = words(text)
    runs = [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    return [crc32(r.encode("utf-8")) % n for r in runs]


def plain(rows, target, percent=5):
    s, t = Counter(b for _, text in rows for b in buckets(text)), Counter(b for text in target for b in buckets(text))
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out = []
    for i, text in rows:
        own = buckets(text)
        weight = sum(floor(1000 * log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in own)
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), len(words(text)) >= 20])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): n + 1 for n, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in out]


def key(row):
    return tuple((x is not None, x or 0) for x in row)


@pytest.mark.parametrize("length", [0, 1, 63, 64, 65, 1000, 70_001])
def test_shift_is_a_crc_of_what_follows(length):
    head, tail = b"some words", b"x" * length
    moved = Shift()(np.array([crc32(head)], dtype=np.uint32), np.array([length]))
    assert int(moved[0]) ^ crc32(tail) == crc32(head + tail)


def test_runs_get_the_buckets_of_their_bytes():
    texts = ["One, two--THREE four", "", None, "a", "a b", "naïve 日本語 words ünder İ", "long " + "y" * 500 + " tail", "\x01 odd \x02 bytes"]
    counts, runs = Features(Settings()).block([None if t is None else t.encode() for t in texts])
    assert counts.tolist() == [len(words(t)) for t in texts]
    got = [Counter() for _ in texts]
    for of, own in runs:
        for n, b in zip(of.tolist(), own.tolist(), strict=True):
            got[n][b] += 1
    assert got == [Counter(buckets(t)) for t in texts]


def test_blocks_do_not_change_counts(spark):
    table = docs(spark, odd_rows())
    whole = {tuple(r) for r in bucket_counts(table).collect()}
    assert whole == {tuple(r) for r in bucket_counts(table, Settings(block_bytes=1)).collect()}


def test_ranks_equal_plain_sums(spark):
    rows = [(i, f"word{i % 7} " * (i % 40) + " ".join(f"w{(i * k) % 11}" for k in range(i % 30)), "a") for i in range(150)]
    rows += [(7, rows[7][1], "b"), (149, rows[149][1], "c"), (None, rows[120][1], None)] + odd_rows()
    target = ["w1 w2 w3 w4 w5", None, "", "word3 word3"]
    got = importance_ranks(docs(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), Settings(percent=20))
    want = plain([(i, t) for i, t, _ in rows], target, 20)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_empty_tables(spark):
    none, no_target = docs(spark, []), spark.createDataFrame([], "text string")
    assert importance_ranks(none, no_target).count() == 0
    rows = importance_ranks(docs(spark, odd_rows()), no_target).collect()
    assert len(rows) == len(odd_rows()) and all(r.weight == 0 for r in rows if not r.n_features)


def test_drawn_rows_keep_their_columns(spark):
    rows = [(i, f"a{i} b c d e f g h i j k l m n o p q r s t u", "x") for i in range(40)]
    table = docs(spark, rows)
    drawn = resampled(table, spark.createDataFrame([("a3 b c",)], "text string"))
    assert drawn.columns == table.columns and drawn.count() == 2


def test_letters_that_hold_space_like_bytes_stay_whole():
    texts = ["voilà à la carte", "Ångström Å 中文 中", "one two … \u0085x", "à"]
    counts, runs = Features(Settings()).block([t.encode() for t in texts])
    assert counts.tolist() == [len(words(t)) for t in texts]
    got = Counter(b for _, own in runs for b in own.tolist())
    assert got == Counter(b for t in texts for b in buckets(t))
