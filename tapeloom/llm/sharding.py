"""A uniform shuffle of a table of any size in two passes, and its cut into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.session import scratch_folder

from .common import discard, running_base, stored, table
from .registry import query

SEED = 20_240_607
#: Aim for a bucket: so many rows and bytes at most, on average.
BUCKET_ROWS, BUCKET_BYTES = 1024, 16 << 20


def external_shuffle(rows: DataFrame, size: str, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """``rows`` with ``__ordinal``, their place in a uniformly random order of all rows, and the row count.

    First pass: every row gets a seeded hash of its values and its place in the input, and the table is
    written to the shared folder, so that both passes, and any repeated task, see the same hashes. The
    hash scatters rows uniformly into buckets whose number follows the input's rows and bytes; repeated
    rows and null keys scatter like others. Second pass: a bucket's rows are put in hash order and moved
    by a seeded Fisher-Yates permutation; a bucket starts where the buckets before it end. Rows cross the
    network once and are never collected into an array; a bucket's permutation is a list of small integers.
    """
    spark = rows.sparkSession
    own = F.xxhash64(F.lit(seed), *[F.col(c) for c in rows.columns if c == "doc_id" or c == size], F.monotonically_increasing_id())
    rows = stored(rows.withColumn("__h", own), "shuffle-scattered")
    n, total = rows.agg(F.count("*"), F.sum(size)).first()
    buckets = max(1, -(-n // bucket_rows), -(-(total or 0) // bucket_bytes))
    rows = rows.withColumn("__bucket", F.pmod("__h", F.lit(buckets)))
    counts = stored(rows.groupBy("__bucket").agg(F.count("*").alias("__n")), "shuffle-buckets")
    most = counts.agg(F.max("__n")).first()[0] or 1
    # The permutation of a bucket is that of the longest bucket without the places it doesn't have, which
    # is as uniform. Fixed partitions keep the seeded draws the same in every run.
    drawn = spark.range(0, buckets, 1, -(-buckets // 256)).select(
        F.col("id").alias("__bucket"), F.shuffle(F.sequence(F.lit(1), F.lit(most).cast("int")), seed).alias("__moves")
    )
    placed = drawn.join(running_base(counts, "__bucket", "__n", "__base"), "__bucket")
    placed = placed.select("__bucket", "__base", F.filter("__moves", lambda m: m <= F.col("__n")).alias("__moves"))
    turn = F.row_number().over(Window.partitionBy("__bucket").orderBy("__h", *[c for c in ("doc_id", size) if c in rows.columns]))
    moved = rows.withColumn("__turn", turn).join(placed, "__bucket")
    ordinal = F.col("__base") + F.element_at("__moves", F.col("__turn")) - 1
    return moved.withColumn("__ordinal", ordinal).drop("__h", "__turn", "__base", "__moves", "__bucket"), n


def into_shards(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """``__ordinal`` cut into ``shards`` runs whose lengths differ by one at most: ``shard`` and ``slot`` in it."""
    small, longer = divmod(n, shards)
    cut = longer * (small + 1)
    o = F.col("__ordinal")
    after = o - cut
    shard = F.when(o < cut, F.floor(o / (small + 1))).otherwise(longer + F.floor(after / max(1, small))).cast("int")
    slot = F.when(o < cut, o % (small + 1)).otherwise(after % max(1, small))
    return rows.withColumns({"shard": shard, "slot": slot.cast("long")}).drop("__ordinal")


def shuffled_shards(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: a uniform shuffle of whole rows dealt to shards of equal counts.

    Null texts count as empty. An empty table gives no rows. Columns named ``shard`` or ``slot`` are replaced.
    """
    docs = docs.drop("shard", "slot").withColumn("__size", _bytes())
    moved, n = external_shuffle(docs, "__size", seed)
    return into_shards(moved.drop("__size"), n, shards)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard. The tasks that permuted the buckets write them, without another shuffle: a
    file holds whole buckets in slot order, and ``slot`` says where each row stands."""
    # A table without rows still is one: its reader names the columns, the folder must exist.
    sharded.sortWithinPartitions("shard", "slot").write.mode("append").option("compression", "zstd").partitionBy("shard").parquet(path)


def _bytes():
    return F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1


@query("op5_external_shuffle")
def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law ``rows``: shard counts differ by one at most.

    Whole documents are scattered, shuffled and written as shards in the shared folder; size, checksum and
    place are those of the rows read back from there.
    """
    docs = table(spark, sf_dir, "documents")
    path = scratch_folder(spark, "shuffle-shards")
    moved = shuffled_shards(docs)
    write_shards(moved, path)
    discard(moved)
    schema = T.StructType([*docs.schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    back = spark.read.schema(schema).parquet(path)
    return back.select(
        "doc_id", _bytes().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
