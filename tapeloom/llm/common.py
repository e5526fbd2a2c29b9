"""Small helpers the text operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.session import prepare, scratch_folder

#: Rows of text an Arrow batch carries to Python. Batches stay small because one text may be very long.
TEXT_BATCH = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH) -> None:
    """Bound what one Arrow batch holds, for sessions somebody else made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    It cuts the lineage: what a lost executor computed is read, not computed again, and every reader sees
    the same rows. The schema is kept, so an empty table reads back as an empty table.
    """
    path = scratch_folder(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once everything read from them is stored itself."""
    for df in tables:
        spark = df.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            if re.search(r"/[a-z]+(-[a-z]+)*-[0-9a-f]{32}$", folder):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_crc(column: str) -> Column:
    """CRC32 of an id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def ranked(df: DataFrame, order: list[Column], kind: str, name: str = "rank") -> DataFrame:
    """``df`` with its 0-based position in a total order, for tables too long for one sorted task.

    Rows are range-partitioned and sorted, frozen in the shared folder, and each partition's rows are
    numbered after those of the partitions before it. One row for each partition is summed in one task.
    """
    low = (1 << 33) - 1
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stored(parts.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), kind)
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("__before", F.coalesce(before, F.lit(0)))
    at = F.col("__at").bitwiseAND(F.lit(low)) - F.col("__first").bitwiseAND(F.lit(low))
    return parts.join(sizes, "__part").withColumn(name, F.col("__before") + at).drop("__part", "__at", "__n", "__first", "__before")


def running_base(counts: DataFrame, key: str, value: str, name: str, block: int = 1024) -> DataFrame:
    """``counts(key, value)`` over keys 0, 1, 2, ... with the sum of the values of all smaller keys.

    Keys fall into blocks of ``block``; only one row for each block is summed in one task.
    """
    earlier = (Window.unboundedPreceding, -1)
    counts = counts.withColumn("__block", F.floor(F.col(key) / block).cast("long"))
    totals = counts.groupBy("__block").agg(F.sum(value).alias("__total"))
    totals = totals.select("__block", F.coalesce(F.sum("__total").over(Window.orderBy("__block").rowsBetween(*earlier)), F.lit(0)).alias("__earlier"))
    inside = F.sum(value).over(Window.partitionBy("__block").orderBy(key).rowsBetween(*earlier))
    out = counts.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(totals, "__block")
    return out.withColumn(name, F.col("__earlier") + F.col("__inside")).drop("__block", "__earlier", "__inside")
