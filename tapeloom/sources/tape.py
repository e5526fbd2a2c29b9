"""Tape scans and sinks: Parquet and JSON Lines, pushed-down filters, segment pruning, metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.slices import Slices, ordered_scan, prev
from .schemas import TAPE, schema_problems

# Which stored event types make up a channel.
CHANNEL_EVENTS = {
    "standard": ("quote", "full"),
    "depth20": ("depth20",),
    "depth200": ("depth200",),
    "historical": ("historical",),
}


def channel_of(event_type: Column) -> Column:
    """Channel name of a stored event type."""
    return F.when(event_type.isin(*CHANNEL_EVENTS["standard"]), "standard").otherwise(event_type)


def tape_filter(
    df: DataFrame,
    *,
    start: str | None = None,
    end: str | None = None,
    channels: Sequence[str] | None = None,
    instrument_ids: Sequence[str] | None = None,
    ts: str = "receive_ts",
    event_type: str = "event_type",
    instrument: str = "instrument_id",
) -> DataFrame:
    """Inclusive time bounds, channel set and instrument list as plain pushable predicates."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast(df.schema[ts].dataType))
    if channels is not None:
        wanted = [e for c in channels for e in CHANNEL_EVENTS.get(c, (c,))]
        df = df.where(F.col(event_type).isin(*wanted))
    if instrument_ids is not None:
        df = df.where(F.col(instrument).isin(*instrument_ids))
    return df


def read_tape(spark: SparkSession, paths: str | Sequence[str], **bounds) -> DataFrame:
    """Parquet tape scan. Layouts partitioned by trading date and channel prune on those too."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    problems = schema_problems(df, TAPE)
    if problems:
        raise ValueError("; ".join(problems))
    return tape_filter(df, **bounds)


def read_tape_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = TAPE) -> DataFrame:
    """JSON Lines tape scan (plain or gzip); unparsable lines land in ``_corrupt``."""
    relaxed = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    return spark.read.schema(relaxed.add("_corrupt", T.StringType())).json(
        paths if isinstance(paths, str) else list(paths),
        mode="PERMISSIVE",
        columnNameOfCorruptRecord="_corrupt",
    )


def live_segments(
    segments: DataFrame,
    *,
    start: str | None = None,
    end: str | None = None,
    channels: Sequence[str] | None = None,
    instrument_ids: Sequence[str] | None = None,
) -> DataFrame:
    """Segments whose coverage, channels and instruments overlap a request."""
    if start is not None:
        segments = segments.where(F.col("coverage_end") >= F.lit(start).cast("timestamp"))
    if end is not None:
        segments = segments.where(F.col("coverage_start") <= F.lit(end).cast("timestamp"))
    if channels is not None:
        segments = segments.where(F.arrays_overlap("channels", F.array(*map(F.lit, channels))))
    if instrument_ids is not None:
        segments = segments.where(
            F.arrays_overlap("instrument_ids", F.array(*map(F.lit, instrument_ids)))
        )
    return segments


def read_segments(spark: SparkSession, segments: DataFrame, **bounds) -> DataFrame:
    """Scan only the surviving segment files of a dataset.

    The path list is catalogue metadata (one entry per file), which any Spark scan holds on the
    driver anyway.
    """
    paths = [row["path"] for row in live_segments(segments, **bounds).select("path").collect()]
    if not paths:
        return spark.createDataFrame([], TAPE)
    return read_tape(spark, paths, **bounds)


def write_tape(
    df: DataFrame,
    path: str,
    *,
    files: int,
    rows_per_file: int = 50_000,
    partition_by: Sequence[str] = ("trading_date", "event_type"),
    mode: str = "errorifexists",
) -> None:
    """Segmented Parquet sink: range-partitioned by sequence, ordered inside a file, zstd."""
    if "trading_date" in partition_by and "trading_date" not in df.columns:
        df = df.withColumn(
            "trading_date", F.to_date(F.from_utc_timestamp("receive_ts", "Asia/Kolkata"))
        )
    (
        df.repartitionByRange(files, *partition_by, "receive_sequence")
        .sortWithinPartitions(*partition_by, "receive_sequence")
        .write.mode(mode)
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*partition_by)
        .parquet(path)
    )


def describe_groups(df: DataFrame, by: Sequence[Column], *, ts: str, seq: str, channel: str, instrument: str) -> DataFrame:
    """Per-segment metadata: rows, sequence and time bounds, channel and instrument sets."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(seq).alias("first_sequence"),
        F.max(seq).alias("last_sequence"),
        F.min(ts).alias("coverage_start"),
        F.max(ts).alias("coverage_end"),
        F.array_sort(F.collect_set(channel)).alias("channels"),
        F.count_distinct(instrument).alias("instruments"),
    )


def describe_files(df: DataFrame) -> DataFrame:
    """``describe_groups`` per written file of a tape."""
    return describe_groups(
        df.withColumn("path", F.input_file_name()),
        [F.col("path")],
        ts="receive_ts",
        seq="receive_sequence",
        channel="event_type",
        instrument="instrument_id",
    )


def sequence_breaks(df: DataFrame, keys: Sequence[str], seq: str, slices: Slices) -> DataFrame:
    """Rows whose sequence is not the previous one plus one, with the kind of break."""
    step = F.col(seq) - F.col("previous_sequence")
    return (
        ordered_scan(df, keys, [seq], slices, {"previous_sequence": prev(seq)})
        .where(F.col("previous_sequence").isNotNull() & (step != 1))
        .withColumn("missing", step - 1)
    )


def source_sequence_flag(current: Column, previous: Column) -> Column:
    """Gap, duplicate or regression of a feed's own sequence; null when it is in order."""
    return (
        F.when(current.isNull(), "source_sequence_unavailable")
        .when(previous.isNull() | (current == previous + 1), F.lit(None).cast("string"))
        .when(current == previous, "duplicate_sequence")
        .when(current < previous, "sequence_regression")
        .otherwise("sequence_gap")
    )


def contract_violations(c=F.col) -> Column:
    """Names of the row invariants a tape row breaks, as a sorted array (empty when clean)."""
    quote = [
        "trade_quote_bid",
        "trade_quote_ask",
        "trade_quote_bid_receive_ts",
        "trade_quote_ask_receive_ts",
        "trade_quote_receive_ts",
        "trade_quote_age_ms",
        "trade_quote_channel",
    ]
    present = sum((c(q).isNotNull().cast("int") for q in quote), F.lit(0))
    rules = {
        "run_id_required": F.coalesce(F.length(c("run_id")), F.lit(0)) == 0,
        "sequence_and_epoch_positive": (c("receive_sequence") < 1) | (c("connection_epoch") < 1),
        "instrument_identity_required": (F.coalesce(F.length(c("instrument_id")), F.lit(0)) == 0)
        | (F.coalesce(F.length(c("broker_security_id")), F.lit(0)) == 0),
        "message_size_non_negative": c("raw_message_size_bytes") < 0,
        "connection_id_required": F.coalesce(F.length(F.trim(c("connection_id"))), F.lit(0)) == 0,
        "source_sequence_non_negative": c("source_sequence") < 0,
        "update_side_domain": c("update_side").isNotNull()
        & ~c("update_side").isin("bid", "ask", "both"),
        "volume_increment_positive": c("cumulative_volume_increment") <= 0,
        "quote_age_non_negative": c("trade_quote_age_ms") < 0,
        "freshness_bound_positive": c("trade_quote_freshness_bound_ms") <= 0,
        "quote_channel_domain": c("trade_quote_channel").isNotNull()
        & ~c("trade_quote_channel").isin("depth20", "depth200"),
        "classification_complete": c("trade_side").isNotNull()
        & (
            c("cumulative_volume_increment").isNull()
            | c("trade_quote_freshness_bound_ms").isNull()
            | c("trade_classifier_version").isNull()
            | c("trade_alignment_version").isNull()
            | c("trade_classification_degraded").isNull()
            | c("trade_classification_reason").isNull()
            | c("trade_coalesced").isNull()
        ),
        "classification_on_prints_only": c("trade_side").isNotNull()
        & ~c("event_type").isin("quote", "full"),
        "quote_fields_all_or_none": (present > 0) & (present < len(quote)),
        "quote_not_after_print": c("trade_quote_receive_ts") > c("receive_ts"),
    }
    return F.array_compact(
        F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    )


def row_digest(columns: Sequence[str]) -> Column:
    """sha256 of the canonical JSON of the named columns, in name order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def dataset_digest(df: DataFrame, digest: Column) -> DataFrame:
    """Order-independent fold of row digests: count, and xor of the leading 60 bits."""
    lead = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(lead).alias("digest"))


def migrate_jsonl(spark: SparkSession, source: str, target: str, *, files: int, dry_run: bool = False) -> DataFrame:
    """Convert a JSON Lines tape to Parquet and compare row digests on both sides."""
    rows = read_tape_jsonl(spark, source).where(F.col("_corrupt").isNull()).drop("_corrupt")
    columns = TAPE.fieldNames()
    before = dataset_digest(rows, row_digest(columns)).withColumn("side", F.lit("source"))
    if dry_run:
        return before
    write_tape(rows, target, files=files)
    stored = spark.read.parquet(target).select(*columns)
    after = dataset_digest(stored, row_digest(columns)).withColumn("side", F.lit("target"))
    return before.unionByName(after)


def export_rows(df: DataFrame, path: str, *, limit: int, order: str = "receive_sequence", fmt: str = "json") -> None:
    """First ``limit`` rows in replay order as CSV or JSON Lines (nested fields as JSON in CSV)."""
    rows = df.orderBy(order).limit(limit)
    if fmt == "csv":
        nested = {f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
        rows = rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])
        rows.write.option("header", True).csv(path)
    else:
        rows.write.json(path)


def archive_tape(df: DataFrame, path: str) -> None:
    """Cold gzip JSON Lines copy."""
    df.write.option("compression", "gzip").json(path)


def write_panel(df: DataFrame, path: str) -> None:
    """Research panel as gzip CSV with a header."""
    df.write.option("header", True).option("compression", "gzip").csv(path)


def read_panel(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Research panel back from (gzip) CSV under an explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(path)
