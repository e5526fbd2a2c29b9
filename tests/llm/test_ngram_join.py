"""The n-gram join against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import docs, odd_rows

from tapeloom.llm.ngram_join import CountTree, Overlaps, Settings, _Hashes, band_keys, block_links, count_vectors, shingle_set, similar_sets, size_classes, tree_join


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2)) if len(words) > 2 else frozenset([tuple(words)])


def linked(a, b, share=90):
    return bool(a) and bool(b) and 100 * len(a & b) >= share * len(a | b)


def components(items, link):
    part = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if part[i] != part[j] and link(items[i], items[j]):
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    return part


def plain(rows):
    sets = [shingles(t) for _, t, _ in rows]
    part = components(sets, linked)
    least = {}
    for (i, _, _), p in zip(rows, part, strict=True):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    return [(i, len(s), least.get(p)) for (i, _, _), s, p in zip(rows, sets, part, strict=True)]


def corpus(seed, texts=60, copies=4):
    """Texts of all lengths with chains of copies that differ in a few words, so that similarities lie around the limit."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(texts):
        words = [f"w{rnd.randrange(60)}" for _ in range(int(2 ** rnd.uniform(0, 9)))]
        for _ in range(copies):
            rows.append((len(rows), " ".join(words).upper() if rnd.random() < 0.2 else "  ".join(words), "a"))
            for _ in range(rnd.randrange(1 + max(1, len(words) // 60))):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(1000)}"
    return rows


def key(row):
    return tuple((x is not None, x or 0) for x in row)


def test_linked_sets_share_a_key():
    rnd, s, tried = random.Random(5), Settings(), 0
    for _ in range(1500):
        n = rnd.choice([8, 9, 10, 11, 12, 18, 19, 20, 40, 99, 100, 101, 250])
        flat = np.array([rnd.getrandbits(64) for _ in range(2 * n)], dtype=np.uint64)
        most = n // 9 + 2
        a, b = np.unique(flat[: n + rnd.randrange(most)]), np.unique(flat[rnd.randrange(most) : n + rnd.randrange(most)])
        shared = len(np.intersect1d(a, b))
        if len(a) != len(b) and 100 * shared >= 90 * (len(a) + len(b) - shared) or (shared < len(a) == len(b) and 190 * shared >= 90 * 2 * len(a)):
            tried += 1
            assert len(np.intersect1d(band_keys(a, s), band_keys(b, s)))
    assert tried > 300


def test_classes_follow_the_share():
    ends = size_classes(90, 10**6)
    for small, large in zip(ends, ends[1:], strict=False):
        assert 100 * small <= 90 * large or large == small + 1


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 300])
def test_tree_gives_every_pair_that_may_link(n):
    rng = np.random.default_rng(n)
    base = [rng.integers(0, 2**63, size, dtype=np.uint64) for size in rng.integers(5, 90, 12)]
    sets = [np.unique(np.r_[base[k % 12][: rng.integers(4, 90)], rng.integers(0, 2**63, rng.integers(0, 4), dtype=np.uint64)]) for k in range(n)]
    counts, sizes = count_vectors(sets, 16), np.array([len(x) for x in sets])

    def may(i, j):
        return 190 * np.minimum(counts[i], counts[j]).sum() >= 90 * (sizes[i] + sizes[j])

    tree = CountTree(counts, sizes, 4)
    got = [tuple(sorted(p)) for i, j in tree_join(tree, tree, 90, 64) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(n) for j in range(i + 1, n) if may(i, j)}
    few = max(1, n // 9)
    other = CountTree(counts[:few], sizes[:few], 4)
    got = {p for i, j in tree_join(tree, other, 90, 64) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == {(i, j) for i in range(n) for j in range(few) if may(i, j)}
    i, j = np.triu_indices(n, 1)
    assert Overlaps(sets)(i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]


def test_links_of_a_block_span_its_components():
    hashes = _Hashes()
    sets = [shingle_set(t.encode(), 3, hashes) for _, t, _ in corpus(3, 30) if t]
    everything = np.arange(len(sets))
    links = block_links(sets, everything, everything, Settings())
    part = list(range(len(sets)))
    for a, b in links:
        low, high = sorted((part[a], part[b]))
        part = [low if p == high else p for p in part]
    assert part == components([set(x.tolist()) for x in sets], linked) and len(links) < len(sets)


@pytest.mark.parametrize("settings", [Settings(), Settings(tile_shingles=500, groups=8, fanout=2)])
def test_classes_equal_all_pairs(spark, settings):
    rows = corpus(11)
    rows += [(9_000 + i, rows[100][1], "b") for i in range(20)] + [rows[3], (None, rows[20][1], None)] + odd_rows()
    got = [tuple(r) for r in similar_sets(docs(spark, rows), settings).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_a_large_block_is_many_tiles(spark):
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*words[: i % 40], f"x{i}", *words[i % 40 + 1 :]]), "a") for i in range(150)]
    got = [tuple(r) for r in similar_sets(docs(spark, rows), Settings(tile_shingles=900)).collect()]
    assert sorted(got) == sorted(plain(rows))


def test_no_rows_and_no_words(spark):
    assert similar_sets(docs(spark, [])).count() == 0
    got = similar_sets(docs(spark, [(1, "", "a"), (2, None, "a"), (2, " \t", "a")])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]
