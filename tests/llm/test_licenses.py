from __future__ import annotations

import re

import pytest
from helpers import docs, odd_rows, write
from oracle import compare, connect

from tapeloom.llm import licenses as li

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(text):
    words, hits = WORD.findall((text or "").translate(LOWER)), []
    for t in li.TEMPLATES:
        p = t.words.split()
        if t.base:
            hits += [(i, t.label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


NOTICE = li.TEMPLATES[3].words
TEXTS = [
    "Released under the MIT License. And under the MIT-license, under the mit license!",
    "cc by nc cc by nc by nc", "Apache License, Version 2.0; apache license version 2", "apache license version two", "under the mit licenses",
    "x " * 5000 + "CC BY-NC 4.0 " + "y " * 5000,
    NOTICE.title(), NOTICE.replace("granted", "now granted").replace("software", "program"), " ".join(NOTICE.split()[:8]), " ".join(reversed(NOTICE.split())),
    "This work is licensed under the GNU General Public License, version 3.", "mit", "ünder the mit license", "under\u00a0the mit license", "under the mit licénse",
]


def test_base_places_and_labels(spark):
    rows = [*odd_rows(), *[(100 + n, t, "s") for n, t in enumerate(TEXTS)]]
    got = li.scan_licenses(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows if i is not None}
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in texts.items():
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert by[106].labels == "mit" and by[106].score == 1 and by[107].labels == "mit"
    assert by[108].labels == by[109].labels == "" and by[110].labels == "gpl"


def test_empty_table(spark, tmp_path):
    write(docs(spark, []), tmp_path, "documents")
    assert li.op9_diagonal_licenses(spark, str(tmp_path)).count() == 0


def test_short_templates_are_refused():
    with pytest.raises(ValueError):
        li.template_grams((li.Template("x", "two words", True),))


def test_query_equals_sql_and_brute_force(spark, sf):
    assert compare(spark, "op9", li.op9_diagonal_licenses, li.SQL, sf, connect(sf)) is None
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in li.op9_diagonal_licenses(spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])


def test_words_left_out_keep_the_label(spark):
    words, rows = NOTICE.split(), []
    for gone in (1, 3):
        for at in range(len(words) - gone + 1):
            rows.append((len(rows), " ".join(words[:at] + words[at + gone :]), gone))
    got = {r.doc_id: r for r in li.scan_licenses(docs(spark, [(i, f"intro {t} outro", "s") for i, t, _ in rows])).collect()}
    grams = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
    for i, t, _ in rows:
        w = t.split()
        left = len(grams & {tuple(w[k : k + 3]) for k in range(len(w) - 2)}) / len(grams)
        assert left >= li.ENOUGH and got[i].labels == "mit" and got[i].score == pytest.approx(left), t
    swapped = " ".join(words[9:] + words[:9])  # the places fall back once, so this is no omission
    assert li.scan_licenses(docs(spark, [(0, swapped, "s")])).collect()[0].labels == ""


def test_sql_has_the_rule_of_the_places(spark, tmp_path):
    words = NOTICE.split()
    cut = [" ".join(words[:at] + words[at + gone :]) for gone in (1, 3) for at in range(0, len(words) - gone + 1, 2)]
    rows = [(n, t, "s") for n, t in enumerate([*TEXTS, *cut, " ".join(words[9:] + words[:9])])]
    write(docs(spark, rows), tmp_path, "documents")
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(spark, "op9", li.op9_diagonal_licenses, li.SQL, str(tmp_path), con) is None
