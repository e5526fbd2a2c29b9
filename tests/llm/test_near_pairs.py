"""The near-copy stage loses no pair of the given similarity, whatever the texts."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from helpers import docs

from tapeloom.llm import simhash
from tapeloom.llm.ngram_join import Settings


def near_texts(pairs: int, seed: int) -> list[str]:
    """Pairs of texts just at or above a similarity of 0.8, each of its own words: far apart in fingerprints, if near in sets."""
    rng, out = random.Random(seed), []
    for n in range(pairs):
        size = rng.randrange(60, 400)
        words = [f"w{n}x{k}" for k in range(size + 4)]
        # All of the changed shingles at one end: (size - cut) / (size + cut) is the similarity.
        cut = size // 9
        out += [" ".join(words), " ".join([*words[: size + 4 - cut], *(f"o{n}x{k}" for k in range(cut))])]
    return out


def shingles(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept_by_all_pairs(texts: list[str]) -> set[int]:
    sets, part = [shingles(t) for t in texts], list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((part[a], part[b]))
            part = [low if p == high else p for p in part]
    return {part.index(p) for p in set(part)}


def test_no_pair_at_the_similarity_is_lost(spark):
    texts = near_texts(400, 1)
    rng = random.Random(2)
    common = [f"c{k}" for k in range(200)]
    # Texts that share a passage and are not near, and texts of few words with equal sets or none.
    texts += [" ".join([*common[:40], *(f"p{n}x{k}" for k in range(rng.randrange(20, 60)))]) for n in range(150)]
    texts += ["a b a b a b", "a b a b a b a", "A b a b a b a b", "", " ", "one", "One", "two three"]
    kept = {r.doc_id for r in simhash.drop_near_copies(docs(spark, [(n, t, "en") for n, t in enumerate(texts)])).collect()}
    assert kept == kept_by_all_pairs(texts)


@pytest.mark.parametrize(("paired", "block"), [(2, 5), (64, 4096)])
def test_bands_of_any_size_propose_every_near_pair(spark, monkeypatch, paired, block):
    """Clusters of variants of one text: bands with many members, searched as groups or kept whole."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng, rows = random.Random(3), []
    for c in range(4):
        words = [f"k{c}x{k}" for k in range(150)]
        for _ in range(40):
            own = list(words)
            for at in rng.sample(range(150), rng.randrange(0, 6)):
                own[at] = f"e{rng.random()}"
            rows.append(" ".join(own))
    kept = {r.doc_id for r in simhash.drop_near_copies(docs(spark, [(n, t, "en") for n, t in enumerate(rows)])).collect()}
    assert kept == kept_by_all_pairs(rows)


def test_count_vectors_never_refuse_a_near_pair():
    rng, s = np.random.default_rng(4), Settings(words=5, share=80)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        all_of = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = np.unique(all_of[: n + n // 9]), np.unique(np.r_[all_of[:n], all_of[n + n // 9 : n + 2 * (n // 9)]])
        near = 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        x, y = simhash.count_vectors([a, b], s.groups).astype("<u2")
        assert not near or simhash._may_be_alike(x, len(a), y, len(b), 80)
        assert not near or set(simhash._keys(a, s).tolist()) & set(simhash._keys(b, s).tolist())
