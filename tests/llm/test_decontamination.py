from __future__ import annotations

import re

import numpy as np
from helpers import CLASHING, docs, odd_rows, write
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import decontamination as dc


def plain_best(pattern: str, text: str) -> int:
    """Smallest edit distance of ``pattern`` to any substring, by the full table."""
    column = list(range(len(pattern) + 1))
    best = column[-1]
    for c in text:
        before, column[0] = column[:], 0
        for i, p in enumerate(pattern, 1):
            column[i] = min(before[i] + 1, column[i - 1] + 1, before[i - 1] + (p != c))
        best = min(best, column[-1])
    return best


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc ", min_size=1, max_size=40), st.text(alphabet="abc ", max_size=60))
def test_bit_parallel_distance_is_the_table_one(pattern, text):
    distance, end = dc.best_end(dc.pattern(0, pattern, 0).masks, len(pattern), text)
    assert distance == plain_best(pattern, text)
    assert 0 <= end <= len(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcde ", min_size=20, max_size=80), st.integers(0, 6), st.data())
def test_every_item_within_its_budget_is_found(item, edits, data):
    item = dc.normalised(item)
    if len(item) < 10:
        return
    changed = list(item)
    for _ in range(edits):
        at = data.draw(st.integers(0, len(changed) - 1))
        kind = data.draw(st.sampled_from("rid"))
        if kind == "r":
            changed[at] = "x"
        elif kind == "i":
            changed.insert(at, "y")
        elif len(changed) > 1:
            del changed[at]
    text = "zz zz " + "".join(changed) + " zz"
    searcher = dc.Searcher([(1, item)], 0.1, least_chars=0)
    found = searcher.find(text)
    exact = plain_best(item, text)
    assert bool(found) == (exact <= int(0.1 * len(item)))
    if found:
        assert found[0].distance == exact


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEM = "The quick brown fox jumps over the lazy dog, while seven wizards make toxic brew for the evil queen and jack."


def test_matches_have_places_and_distances(spark):
    changed = ITEM.replace("lazy", "lzy").replace("seven", "sevven")
    rows = [(1, f"Before. {ITEM.upper()} After.", "s"), (2, f"x {changed} y", "s"), (3, "nothing here", "s"), (4, ITEM[:60], "s")]
    got = {r.doc_id: r for r in dc.matches(docs(spark, rows), items(spark, [(9, ITEM)])).collect()}
    assert set(got) == {1, 2}
    assert got[1].distance == 0 and got[2].distance == 2
    assert dc.normalised(rows[0][1])[got[1].start : got[1].stop] == dc.normalised(ITEM)
    assert dc.normalised(rows[1][1])[got[2].start : got[2].stop] == dc.normalised(changed)


def test_short_items_stand_as_whole_words_without_edits(spark):
    short = [(1, "What is 2 plus 2?"), (2, "plus"), (3, "東京の人口"), (4, "?!"), (5, "What is 3 plus 3?")]
    rows = [(1, "so: what is 2, plus 2", "s"), (2, "surplus of what is 2 plus 22", "s"), (3, "東京の人口 は", "s"), (4, "plus", "s"), (5, "whatis 2 plus 2 x", "s")]
    got = sorted((r.doc_id, r.item_id, r.distance) for r in dc.matches(docs(spark, rows), items(spark, short)).collect())
    assert got == [(1, 1, 0), (1, 2, 0), (2, 2, 0), (3, 3, 0), (4, 2, 0), (5, 2, 0)]
    place = dc.matches(docs(spark, rows[:1]), items(spark, short[:1])).first()
    assert dc.normalised(rows[0][1])[place.start : place.stop] == "what is 2 plus 2"
    kept = dc.drop_contaminated(docs(spark, rows), items(spark, short[:1])).collect()
    assert {r.doc_id for r in kept} == {2, 3, 4, 5}


def test_blocks_of_items_find_the_same(spark):
    many = [(n, f"{ITEM} number {n} {'abcdefghij'[n % 10] * 5}") for n in range(30)] + [(None, ITEM), (7, None), (8, ""), (9, "tiny")]
    rows = [(1, many[3][1] + " and " + many[17][1], "s"), (2, many[29][1], "s"), (3, None, "s")]
    one = dc.matches(docs(spark, rows), items(spark, many)).collect()
    cut = dc.matches(docs(spark, rows), items(spark, many), dc.Settings(block_chars=500)).collect()
    assert sorted(map(str, one)) == sorted(map(str, cut)) and one


def test_odd_and_empty_tables(spark, tmp_path):
    frame = docs(spark, [*odd_rows(), (20, ITEM, None)])
    found = dc.matches(frame, items(spark, [(1, ITEM), (1, ITEM), (2, None)])).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(20, 1)}
    assert dc.matches(frame, items(spark, [])).count() == 0
    assert dc.matches(docs(spark, []), items(spark, [(1, ITEM)])).count() == 0
    kept = dc.drop_contaminated(frame, items(spark, [(1, ITEM)]))
    assert kept.columns == frame.columns and kept.count() == len(odd_rows())
    assert all(r[c] == f"own {c}" for r in kept.collect() for c in CLASHING)
    write(docs(spark, []), tmp_path, "documents")
    write(items(spark, []), tmp_path, "benchmark")
    assert dc.op4_pigeonhole_decontamination(spark, str(tmp_path)).count() == 0


def test_query_finds_what_plain_search_finds(spark, sf):
    found = {(r.doc_id, r.item_id): r.distance for r in dc.op4_pigeonhole_decontamination(spark, sf).collect()}
    texts = {r.doc_id: dc.normalised(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bench = {r.item_id: dc.normalised(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in texts.items() for i, b in bench.items() if b in t}
    assert exact and exact <= set(found) and all(found[k] == 0 for k in exact)
    rng = np.random.default_rng(2)
    sample = [d for d in rng.permutation(list(texts)).tolist() if len(texts[d]) < 600][:12]
    assert len(sample) == 12
    for d in sample:  # the full table over whole short texts
        if len(texts[d]) < 900:
            for i, b in list(bench.items())[:15]:
                assert (plain_best(b, texts[d]) <= int(0.05 * len(b))) == ((d, i) in found)


def test_normal_form():
    assert dc.normalised("  A--b_c\n(Ü)  ") == "a b c ü"
    assert re.fullmatch(r"[^\W_]+( [^\W_]+)*", dc.normalised(ITEM))
