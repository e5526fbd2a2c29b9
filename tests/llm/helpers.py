"""Small tables with what may go wrong in them, and plain versions of rules to compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns with names the operators might use themselves.
CLASHING = ("score", "fp", "key", "bucket", "base", "n", "size", "uid", "rank", "taken", "target", "label", "words", "difference", "node")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)

LONG = "lorem ipsum dolor sit amet " * 40_000


def docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``rows`` of (doc_id, text, source) as documents with clashing extra columns."""
    full = [(i, t, "en", s, None if t is None else len(t), *[f"own {c}" for c in CLASHING]) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    return [
        (1, "one two three four five six", "a"),
        (1, "one two three four five six", "a"),
        (2, "one two three four five six", "b"),
        (3, "", "a"),
        (4, None, "b"),
        (None, "one two three four five six", None),
        (None, None, None),
        (5, LONG, "a"),
        (6, "  \t\n ", None),
        (7, "Ünïcode wörds — and 日本語 \U0001f600 text", "c"),
        (8, "short", "c"),
    ]


def write(df: DataFrame, folder, name: str, parts: int = 2) -> None:
    df.repartition(parts).write.parquet(f"{folder}/{name}.parquet")
