from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from helpers import CLASHING, docs, odd_rows, write
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import simhash
from tapeloom.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps: dict) -> dict:
    """Smallest key reachable over links of at most 3 bits, all pairs compared."""
    up = {k: k for k in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {k: find(k) for k in fps}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbÄé \t\n\x0b\x0c\x1c. ")), max_size=60))
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


def cluster(rng, n, spread):
    """Fingerprints around a centre, each with up to ``spread`` bits changed."""
    centre = int(rng.integers(0, 2**63))
    out = set()
    while len(out) < n:
        x = centre
        for b in rng.choice(64, size=int(rng.integers(0, spread + 1)), replace=False):
            x ^= 1 << int(b)
        out.add(x)
    return out


def as_signed(values):
    return [int(np.uint64(v).view(np.int64)) for v in values]


def test_sets_follow_the_number_of_fingerprints():
    assert [simhash.equal_sets(n, 3) for n in (0, 1, 10**5, 10**7, 10**8, 10**9, 10**11)] == [3, 3, 3, 3, 4, 5, 8]


@pytest.mark.parametrize(("radius", "fixed"), [(0, 3), (1, 4), (3, 3), (3, None), (3, 5), (5, 3)])
def test_links_connect_as_all_pairs_do(spark, radius, fixed, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)  # so that long groups are cut
    rng = np.random.default_rng(radius)
    values = cluster(rng, 150, 2) | cluster(rng, 150, 9) | {int(rng.integers(0, 2**64, dtype=np.uint64)) for _ in range(150)} | {0}
    frame = spark.createDataFrame([(v,) for v in as_signed(values)], "fp long")
    links = [(r.a, r.b) for r in simhash.link_fingerprints(frame, radius, fixed).collect()]
    assert all((a ^ b & (2**64 - 1) if a >= 0 and b >= 0 else (a ^ b) & (2**64 - 1)).bit_count() <= radius for a, b in links)
    up = {v: v for v in as_signed(values)}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {v: find(v) for v in up}
    want = {v: v for v in up}

    def root(x):
        while want[x] != x:
            x = want[x]
        return x

    for a, b in combinations(up, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
            x, y = sorted((root(a), root(b)))
            want[y] = x
    assert {v: root(v) for v in up} == got


def test_forest_of_a_long_run_is_exact(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(5)
    values = np.array(as_signed(cluster(rng, 400, 6)), dtype=np.int64)
    links = list(simhash.forest(values, 3))
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in links)
    monkeypatch.setattr(simhash, "BLOCK", 4096)
    whole = list(simhash.forest(values, 3))

    def sets(pairs):
        found = simhash._Sets()
        for a, b in pairs:
            found.join(a, b)
        return {int(v): found.find(int(v)) for v in values}

    assert sets(links) == sets(whole)


def test_pivot_distances_give_pair_counts():
    x = np.array([0x123456789ABCDEF0], dtype=np.int64)
    table = simhash.distance_table(x)[0]
    for pair in range(32):
        ones = (int(x[0]) >> 2 * pair & 3).bit_count()
        assert table[0] + 2 - table[1 + pair] == 2 * ones


def test_query_over_odd_rows(spark, tmp_path):
    write(docs(spark, odd_rows()), tmp_path, "documents")
    rows = simhash.op6_simhash_pivots(spark, str(tmp_path)).collect()
    given_rows = odd_rows()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _, _ in given_rows)
    by = {i: t for i, t, _ in given_rows if i is not None}
    groups = plain_groups({i: plain_fingerprint(t) for i, t in by.items()})
    for r in rows:
        if r.doc_id is not None:
            assert r.fingerprint == f"{plain_fingerprint(by[r.doc_id]):016x}"
            assert r.component_id == groups[r.doc_id]
        else:
            assert r.component_id in (1, 3)


def test_query_equals_brute_force(spark, sf):
    rows = simhash.op6_simhash_pivots(spark, sf).collect()
    groups = plain_groups({r.doc_id: int(r.fingerprint, 16) for r in rows})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert int(r.fingerprint, 16) == plain_fingerprint(texts[r.doc_id])
        assert r.component_id == groups[r.doc_id]


def test_empty_table(spark, tmp_path):
    write(docs(spark, []), tmp_path, "documents")
    assert simhash.op6_simhash_pivots(spark, str(tmp_path)).count() == 0
    assert simhash.drop_near_copies(docs(spark, [])).count() == 0


def test_stage_keeps_one_row_of_each_group(spark):
    frame = docs(spark, odd_rows())
    kept = simhash.drop_near_copies(frame).collect()
    assert sorted((r.doc_id, r.source) for r in kept) == [(1, "a"), (3, "a"), (5, "a"), (7, "c"), (8, "c")]
    assert all(r[c] == f"own {c}" for r in kept for c in CLASHING)


def test_components_of_paths_stars_and_loops(spark):
    rng = np.random.default_rng(1)
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, x) for x in range(1001, 1400)]
    ring = [(2000 + i, 2000 + (i + 1) % 50) for i in rng.permutation(50).tolist()]
    odd = [(7, 7), (None, 3), (5000, 5001), (5001, 5000)]
    frame = spark.createDataFrame(path + star + ring + odd, "a long, b long")
    got = {r.node: r.component for r in connected_components(frame).collect()}
    want = {n: 0 for n in range(61)} | {n: 1000 for n in range(1000, 1400)} | {n: 2000 for n in range(2000, 2050)} | {5000: 5000, 5001: 5000}
    assert got == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bits_and_tables_of_a_similarity():
    assert simhash.bits_apart(1.0, 256) == 0 and simhash.bits_apart(0.0, 256) == 128
    assert simhash.bits_apart(0.8, 64) == pytest.approx(9.7, abs=0.1)
    small, large = simhash.tables_for(100, 0.8), simhash.tables_for(10**9, 0.8)
    assert small.bits == 16 and large.bits == 27 and large.tables > small.tables
    for plan in (small, large):
        assert 1 - (1 - (1 - simhash.bits_apart(0.8, 1)) ** plan.bits) ** plan.tables >= 0.97


def test_wide_fingerprints_begin_with_the_narrow_one():
    for text in ("", None, "one", "a b c d e f g h i j k l m"):
        wide = simhash.wide_fingerprint(text, words=3)
        assert len(wide) == 32 and int.from_bytes(wide[:8], "little", signed=True) == simhash.fingerprint(text)
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 60)) for _ in range(40)]
    raw = np.frombuffer(b"".join(simhash.wide_fingerprint(t) for t in texts), dtype=np.uint64).reshape(-1, 4)
    lanes = np.bitwise_count(raw[:, :1] ^ raw[:, 1:]).mean()
    assert 30 < lanes < 34


def similar_corpus(seed=4, bases=60, words=150):
    """Each base with copies of 1, 2 and 12 changed words: (doc_id, text, source)."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    rows = []
    for b in range(bases):
        base = rng.choice(vocabulary, words)
        for edits in (0, 1, 2, 12):
            copy = base.copy()
            copy[rng.choice(words, edits, replace=False)] = [f"x{b}_{edits}_{i}" for i in range(edits)]
            rows.append((len(rows), " ".join(copy), "s"))
    return rows


def shingle_similarity(a, b, k=5):
    x, y = ({tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_stage_joins_what_is_similar_and_nothing_else(spark):
    rows = similar_corpus()
    kept = {r.doc_id for r in simhash.drop_near_copies(docs(spark, rows)).collect()}
    near = [i for i, t, _ in rows if i % 4 in (1, 2)]
    assert all(shingle_similarity(rows[i][1], rows[i - i % 4][1]) > 0.8 for i in near)
    assert sum(i in kept for i in near) <= 0.05 * len(near)
    far = [i for i, t, _ in rows if i % 4 == 3]
    assert max(shingle_similarity(rows[i][1], rows[i - 3][1]) for i in far) < 0.6
    assert all(i in kept for i in far) and all(i in kept for i in range(0, len(rows), 4))


def test_wide_links_of_long_runs_are_forests(spark):
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 2**63, 4).astype(np.uint64)
    values = np.tile(centre, (200, 1))
    for row in values[:150]:
        for b in rng.choice(256, 10, replace=False):
            row[b // 64] ^= np.uint64(1 << int(b % 64))
    values[150:] = rng.integers(0, 2**63, (50, 4)).astype(np.uint64)
    links = simhash._wide_links(np.zeros(200, np.int64), values, 41)
    assert len(links) == 149 and {i for pair in links for i in pair} == set(range(150))
    short = simhash._wide_links(np.repeat(np.arange(10), 20), values, 41)
    assert all(a // 20 == b // 20 and np.bitwise_count(values[a] ^ values[b]).sum() <= 41 for a, b in short)


def test_stage_decides_by_the_exact_similarity(spark):
    """Pairs just above the similarity are joined, pairs just below are not, whatever their fingerprints say."""
    rng = np.random.default_rng(11)
    rows, close = [], {}
    for p in range(240):
        base = [f"p{p}_{i}" for i in rng.permutation(200)]
        copy = list(base)
        for at in range(18, 18 + 20 * (4 if p % 2 else 6), 20):
            copy[at] = f"changed{p}_{at}"  # every change costs five shingles of 196
        rows += [(2 * p, " ".join(base), "s"), (2 * p + 1, " ".join(copy), "s")]
        close[2 * p + 1] = shingle_similarity(rows[-1][1], rows[-2][1])
    kept = {r.doc_id for r in simhash.drop_near_copies(docs(spark, rows)).collect()}
    assert {2 * p for p in range(240)} <= kept
    above, below = [i for i, x in close.items() if x >= 0.8], [i for i, x in close.items() if x < 0.8]
    assert len(above) == len(below) == 120 and min(close[i] for i in above) < 0.83 and max(close[i] for i in below) > 0.7
    assert all(i in kept for i in below)
    assert sum(i in kept for i in above) <= 0.05 * len(above)


def test_a_failed_forest_link_does_not_part_a_group(spark):
    """The first member is near all others by fingerprint only; the others are joined with each other."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.permutation(200)]
    odd = [f"odd{i}" if i % 20 == 18 and i < 138 else w for i, w in enumerate(base)]  # 6 changes: below 0.8
    rows = [(0, " ".join(odd), "s")]
    for n in range(1, 41):
        copy = list(base)
        copy[190 + n % 4] = f"own{n}"
        rows.append((n, " ".join(copy), "s"))
    assert max(shingle_similarity(rows[0][1], t) for _, t, _ in rows[1:]) < 0.8
    assert {r.doc_id for r in simhash.drop_near_copies(docs(spark, rows)).collect()} == {0, 1}
