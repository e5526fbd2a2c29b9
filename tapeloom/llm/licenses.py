"""License texts in documents: k-gram hits vote for the diagonal on which a template lies."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table
from .registry import query


class Template(NamedTuple):
    label: str
    words: str
    base: bool  #: counts where it stands word by word; others count where most of it stands


# The phrases asked for, and the opening words of public license texts and notices.
TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", False),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", False),
    Template("gpl", "this work is licensed under the gnu general public license version", False),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", False),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", False),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", False),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", False),
)

GRAM = 3
#: A template counts where so much of its grams vote for diagonals that are neighbours.
ENOUGH = 0.6
#: Diagonals this near are one place: so many words may be put in or left out between two votes.
NEAR = 3

_FOLD = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_START = 0  # the gram every document has once, so that documents without hits keep a row


def _grams(words: list[bytes]) -> list[int]:
    digest = xxhash.xxh64_intdigest
    return [digest(b" ".join(words[i : i + GRAM]), 9) | 1 for i in range(len(words) - GRAM + 1)]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def template_grams(templates: tuple[Template, ...]) -> list[tuple]:
    """(gram, template, place, grams): a row for each gram of each template, and the row of the start gram."""
    rows = [(_START, -1, 0, 0)]
    for n, t in enumerate(templates):
        grams = _signed(_grams(t.words.encode("utf-8").split())).tolist()
        if not grams:
            raise ValueError(f"template {t.words!r} has fewer than {GRAM} words")
        rows += [(g, n, place, len(grams)) for place, g in enumerate(grams)]
    return rows


def _rolling(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, n_words, grams): hashes of all word k-grams of whole texts, the start gram first."""
    small_batches(docs.sparkSession)
    source = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, offsets, grams = [], [0], []
            for text in batch.column(2):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
                own = _grams(words)
                counts.append(len(words))
                grams += [_signed([_START]), _signed(own)]
                offsets.append(offsets[-1] + 1 + len(own))
            flat = np.concatenate(grams) if grams else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), lists], names=["uid", "doc_id", "n_words", "grams"])

    fields = [source.schema["uid"], source.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))]
    return source.mapInArrow(run, T.StructType(fields))


def license_places(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(uid, doc_id, n_words, template, first_word, last_start, coverage): one row for each place where a
    template stands, and one with template -1 for each document.

    Every rolling k-gram hash of every text meets the template grams in a broadcast join (the templates
    are an argument, not data). Hits vote for the diagonal document place - template place; full votes of a
    base phrase's diagonal mean that its words stand there one after the other. For other templates
    neighbouring diagonals are merged, and the merged span is verified: it holds at least ``ENOUGH`` of the
    template's grams, in the template's order, and is not longer than the template by more than a half.
    Only hits and one row a document are shuffled. Null and empty texts have no words.
    """
    spark = docs.sparkSession
    wanted = spark.createDataFrame(template_grams(templates), "gram long, template int, place int, grams int")
    rows = _rolling(docs).select("uid", "doc_id", "n_words", F.posexplode("grams").alias("at", "gram"))
    hits = rows.join(F.broadcast(wanted), "gram").repartition("uid")
    hits = hits.withColumn("word", F.col("at") - 1).withColumn("diagonal", F.col("word") - F.col("place"))
    base = F.array_contains(F.array(*[F.lit(n) for n, t in enumerate(templates) if t.base] or [F.lit(-2)]), F.col("template"))
    votes = hits.groupBy("uid", "doc_id", "n_words", "template", "grams", "diagonal").agg(
        F.count("*").alias("votes"), F.min("word").alias("low"), F.max("word").alias("high"), F.min("place").alias("from"), F.max("place").alias("to")
    )
    one = Window.partitionBy("uid", "template").orderBy("diagonal", "low")
    # A diagonal joins the one before if it is near, and its votes lie near those.
    apart = (F.col("diagonal") - F.lag("diagonal").over(one) > NEAR) | (F.col("low") - F.lag("high").over(one) > F.col("grams"))
    votes = votes.withColumn("run", F.sum(F.when(base, 1).otherwise(F.coalesce(apart, F.lit(True)).cast("int"))).over(one))
    # Words left out put the later part on the smaller diagonal, so the order of a run is that of its places.
    ordered = F.coalesce(F.col("from") > F.lag("to").over(Window.partitionBy("uid", "template", "run").orderBy("low", "from")), F.lit(True))
    votes = votes.withColumn("fits", ordered)
    merged = votes.groupBy("uid", "doc_id", "n_words", "template", "grams", "run").agg(
        F.sum(F.when(F.col("fits"), F.col("votes")).otherwise(0)).alias("votes"), F.min("low").alias("first_word"), F.max("high").alias("last_start")
    )
    coverage = F.when(F.col("template") < 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("votes") / F.col("grams")))
    length = F.col("last_start") - F.col("first_word") + 1
    stands = F.when(base, F.col("votes") == F.col("grams")).otherwise((F.col("votes") >= ENOUGH * F.col("grams")) & (length <= 1.5 * F.col("grams") + NEAR))
    return merged.withColumn("coverage", coverage).where((F.col("template") < 0) | stands)


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row for each document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the best coverage of any template. Labels are distinct, sorted and comma-joined.
    """
    places = license_places(docs, templates)
    label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("template") + 1)
    base = F.element_at(F.array(*[F.lit(t.base) for t in templates]), F.col("template") + 1)
    found = F.col("template") >= 0
    places = places.withColumn("label", F.when(found, label)).withColumn("base", F.when(found, base).otherwise(False))

    def joined(of: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(of)), ",")

    return places.groupBy("uid", "doc_id", "n_words").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first_word"))).cast("long").alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("coverage").alias("score"),
    ).drop("uid")


SQL = rf"""WITH t(template, label, base, words) AS (VALUES {", ".join(f"({n}, '{t.label}', {t.base}, '{t.words}')" for n, t in enumerate(TEMPLATES))}),
s AS (SELECT *, string_split(words, ' ') AS w FROM t),
g AS (SELECT template, label, base, len(w) - 2 AS grams, unnest(range(0, len(w) - 2)) AS place, w FROM s),
tg AS (SELECT template, label, base, grams, place, w[place + 1] || ' ' || w[place + 2] || ' ' || w[place + 3] AS gram FROM g),
d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT uid, unnest(range(0, len(w) - 2)) AS word, w FROM d),
h AS (SELECT uid, template, label, base, grams, word, place, word - place AS diagonal FROM i JOIN tg ON gram = w[word + 1] || ' ' || w[word + 2] || ' ' || w[word + 3]),
v AS (SELECT uid, template, label, base, grams, diagonal, count(*) AS votes, min(word) AS low, max(word) AS high, min(place) AS since, max(place) AS upto FROM h GROUP BY ALL),
a AS (SELECT *, CASE WHEN base THEN 1 WHEN coalesce(diagonal - lag(diagonal) OVER o > {NEAR} OR low - lag(high) OVER o > grams, true) THEN 1 ELSE 0 END AS apart FROM v
  WINDOW o AS (PARTITION BY uid, template ORDER BY diagonal, low)),
r AS (SELECT *, sum(apart) OVER (PARTITION BY uid, template ORDER BY diagonal, low) AS run FROM a),
y AS (SELECT *, coalesce(since > lag(upto) OVER (PARTITION BY uid, template, run ORDER BY low, since), true) AS fits FROM r),
m AS (SELECT uid, template, label, base, grams, run, sum(CASE WHEN fits THEN votes ELSE 0 END) AS votes, min(low) AS first_word, max(high) AS last_start FROM y GROUP BY ALL),
k AS (SELECT *, least(1.0, CAST(votes AS DOUBLE) / grams) AS coverage FROM m WHERE CASE WHEN base THEN votes = grams
  ELSE votes >= {ENOUGH} * grams AND last_start - first_word + 1 <= 1.5 * grams + {NEAR} END)
SELECT any_value(d.doc_id) AS doc_id, CAST(any_value(len(d.w)) AS BIGINT) AS n_words, count(*) FILTER (WHERE base) AS n_base,
  min(first_word) FILTER (WHERE base) AS first_word, max(first_word) FILTER (WHERE base) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE label IS NOT NULL)), ','), '') AS labels,
  coalesce(max(coverage), 0.0) AS score FROM d LEFT JOIN k USING (uid) GROUP BY uid"""


@query("op9_diagonal_licenses", SQL)
def op9_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License places of every document; an empty table gives no rows."""
    return scan_licenses(table(spark, sf_dir, "documents"))
