"""Two-pass external shuffle of a corpus into training shards, with DataFrame functions only.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash. Pass two
orders each bucket by that hash, which makes its input independent of how rows arrived, and
applies Spark's ``shuffle`` (a seeded Fisher-Yates permutation) to it. The buckets laid end
to end are a random order of the corpus; dealing that order round robin gives shards whose
row counts differ by one at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Stash, broadcast_if_small, load

SHARDS = 40
SEED = 20_240_917
#: Bytes of records that a bucket holds on average; one task shuffles one bucket in memory.
BUCKET_BYTES = 16 << 20
#: Rows that a bucket holds at most on average, whatever their size.
BUCKET_ROWS = 8_000
#: Buckets of a task on average, and tasks at most; a task shuffles its buckets one after the other.
BUCKETS_A_TASK, MOST_TASKS = 4, 10_000
#: Buckets whose rows are added up in one window.
OFFSETS = 4096
#: Bytes that a record takes besides its text.
RECORD_OVERHEAD = 16


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_OVERHEAD).cast("long")


def shuffle_into_shards(
    records: DataFrame, size: Column, stash: Stash, shards: int = SHARDS, seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, key: Sequence[str] = ("doc_id", "text"),
) -> DataFrame:
    """Adds ``shard`` (int, 0 to shards - 1) and ``slot`` (long, gapless from 0 in each shard).

    ``records`` may hold any columns that can be grouped; ``size`` is a record's bytes. Row
    counts of shards differ by one at most. The order depends only on the records and the
    parameters (of which the number of tasks follows), not on the input's files or partitions. A record's draw takes the columns of ``key`` that
    are there (all, if none is) and its number among rows that are equal in them, so other
    columns only order those rows.

    Nulls are values like others. Rows with equal keys are numbered, so that any number of
    copies of one row scatters over all buckets. An empty table gives an empty result. Input
    columns named shard or slot are replaced.
    """
    records = records.drop("shard", "slot")
    names = records.columns
    one = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    own = [c for c in key if c in names] or names
    keyed = records.select(F.xxhash64(*(F.col(f"`{c}`") for c in own)).alias("own"), one.alias("rec"), size.alias("bytes"))
    keys = stash.put("keys", keyed.groupBy("own").agg(F.count(F.lit(1)).alias("copies"), F.sum("bytes").alias("bytes")))
    total = keys.agg(F.sum("copies").alias("rows"), F.sum("bytes").alias("bytes")).first()
    buckets = max(1, -(-(total["bytes"] or 0) // bucket_bytes), -(-(total["rows"] or 0) // bucket_rows))

    draw = F.xxhash64(F.lit(seed), F.col("own"), F.col("copy"))
    bucket = F.pmod(F.shiftrightunsigned("draw", 16), F.lit(buckets)).cast("int")
    numbers = lambda before: F.explode(F.sequence(before + 1, before + F.col("copies"))).alias("copy")
    # Keys alone tell how many rows each bucket gets. One row for each bucket: bounded by corpus bytes over bucket_bytes.
    held = keys.select("own", numbers(F.lit(0).cast("long"))).select(draw.alias("draw")).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    offsets = broadcast_if_small(stash.put("offsets", _offsets(stash.put("held", held))))

    repeated = stash.put("repeated", keys.where("copies > 1").select("own"))
    rows = keyed.select("own", "rec", F.lit(1).cast("long").alias("copy"))
    if not repeated.isEmpty():
        repeated = broadcast_if_small(repeated)
        among = Window.partitionBy("own").orderBy("rec").rowsBetween(Window.unboundedPreceding, -1)
        equal = keyed.join(repeated, "own", "left_semi").groupBy("own", "rec").agg(F.count(F.lit(1)).alias("copies"))
        equal = equal.withColumn("before", F.coalesce(F.sum("copies").over(among), F.lit(0)))
        rows = rows.join(repeated, "own", "left_anti").union(equal.select("own", "rec", numbers(F.col("before"))))
    permuted = (
        rows.withColumn("draw", draw).withColumn("bucket", bucket)
        .repartition(min(MOST_TASKS, -(-buckets // BUCKETS_A_TASK)), "bucket")
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list(F.struct("draw", "copy", "rec"))).alias("held"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle("held", F.lit(seed)).alias("held"))
    )
    place = F.col("offset") + F.col("at")
    return (
        permuted.join(offsets, "bucket")
        .select("offset", F.posexplode("held").alias("at", "one"))
        .select(
            *(F.col(f"one.rec.c{i}").alias(c) for i, c in enumerate(names)),
            F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
            F.floor(place / shards).cast("long").alias("slot"),
        )
    )


def _offsets(held: DataFrame) -> DataFrame:
    """Rows in all buckets before each one: within groups of OFFSETS buckets, then over the groups, so that no window holds all buckets."""
    grouped = held.withColumn("group", F.floor(F.col("bucket") / OFFSETS))
    before = lambda w, of: F.coalesce(F.sum(of).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = grouped.groupBy("group").agg(F.sum("rows").alias("rows")).select("group", before(Window.orderBy("group"), "rows").alias("first"))
    inside = grouped.select("group", "bucket", before(Window.partitionBy("group").orderBy("bucket"), "rows").alias("own"))
    return inside.join(broadcast_if_small(groups), "group").select("bucket", (F.col("first") + F.col("own")).alias("offset"))


def write_shards(documents: DataFrame, path: str, spark: SparkSession, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Writes whole records as one folder ``shard=N`` for each shard, and returns what was written.

    Each task appends one file in slot order to every shard, so texts are moved once.
    """
    stash = Stash(spark, "shards")
    dealt = shuffle_into_shards(documents, record_size(F.col("text")), stash, shards, seed)
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def op5_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: every document's shard and slot, with its size and checksum, from the shards as written."""
    written = write_shards(load(spark, sf_dir, "documents"), f"{Stash(spark, 'op5').root}/shards", spark)
    return written.select(
        "doc_id", record_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
