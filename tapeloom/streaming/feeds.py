"""Streaming sources, windows, joins and sinks.

Policy: event time is ``receive_ts`` under a watermark. The tape contract has no late rows, so rows
older than the watermark go to a quarantine table instead of failing the query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def follow_parquet(
    spark: SparkSession, path: str, schema: T.StructType, *, files_per_trigger: int = 64, bytes_per_trigger: str | None = None
) -> DataFrame:
    """Follow published Parquet segments, bounded per trigger."""
    reader = spark.readStream.schema(schema)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    else:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def tail_jsonl(spark: SparkSession, path: str, schema: T.StructType, *, files_per_trigger: int = 64) -> DataFrame:
    """Follow JSON Lines drops: parsed row, raw line and whether the line is malformed."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    parsed = F.from_json("value", schema.add("_corrupt", T.StringType()), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select("value", parsed.alias("row")).withColumn("malformed", F.col("row").isNull() | F.col("row._corrupt").isNotNull())


def split_late(batch: DataFrame, ts: str, floor: str) -> tuple[DataFrame, DataFrame]:
    """Rows at or after a floor instant, and the quarantined rest."""
    late = F.col(ts) < F.lit(floor).cast("timestamp")
    return batch.where(~late), batch.where(late)


def latest_value(rows: DataFrame, key: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Latest row per key with how many earlier rows it replaced (update mode)."""
    return rows.groupBy(*key).agg(
        F.max_by(F.struct(*fields), F.struct(*order)).alias("latest"), (F.count(F.lit(1)) - 1).alias("coalesced")
    )


def window_counts(rows: DataFrame, ts: str, watermark: str, width: str, slide: str | None, keys: Sequence[str], value: str) -> DataFrame:
    """Tumbling or sliding window counts and sums per key."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.withWatermark(ts, watermark).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"))


def session_episodes(rows: DataFrame, ts: str, watermark: str, gap: str, keys: Sequence[str]) -> DataFrame:
    """Gap-separated episodes as session windows."""
    return rows.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows"))


def drop_repeats(rows: DataFrame, ts: str, watermark: str, ids: Sequence[str]) -> DataFrame:
    """First copy of each update id inside the watermark."""
    return rows.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(ids))


def feed_health(latest: DataFrame, now: Column, ts: str, slow: int, dead: int) -> DataFrame:
    """Age of the latest row per key and its live / slow / dead label, in microseconds."""
    age = now - F.col(ts)
    label = F.when(age > dead, "dead").when(age > slow, "slow").otherwise("live")
    return latest.withColumn("age_us", age).withColumn("state", label)


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Process everything available now; each micro-batch becomes one folder of ``target``.

    The batch id is part of the path and a replayed batch overwrites its own folder, so a retry
    after a failure leaves each batch exactly once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    # A stream without rows leaves an empty table, not a missing one.
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{target}/batch=-1")
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def last_update(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    """Final value per key from the update batches of ``run_available``."""
    rows = spark.read.parquet(target)
    fields = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("__v")).select(*keys, "__v.*")
