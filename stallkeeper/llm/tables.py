"""Reading input tables and cutting lineage through tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ready


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset, one process that runs everything (local mode, as in tests) takes a
    folder of its own; a cluster is refused, as its machines don't see each other's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


#: Folders of this process that are still there, with the sessions that made them.
_open: dict[str, SparkSession] = {}


class Stash:
    """Tables written once to the shared folder and read back.

    A written table survives the loss of any executor and is computed once however often it
    is read. ``drop`` removes one that no later plan reads, ``close`` all of them, once the
    results made from them are written. What is open when the process ends is removed then.
    """

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{owner}-{uuid.uuid4().hex[:12]}"
        self.schemas: dict = {}
        _open[self.root] = spark

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        self.schemas[name] = df.schema
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        _delete(self.spark, self.root)
        _open.pop(self.root, None)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _sweep() -> None:
    """Runs before Spark's own hook, which was registered earlier, ends the JVM; a session that was stopped already leaves its folders."""
    for root, spark in list(_open.items()):
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            with contextlib.suppress(Exception):  # the JVM may be gone by now
                _delete(spark, root)
    _open.clear()


#: Rows up to which a table may be broadcast; counted before the hint is given.
BROADCAST_ROWS = 20_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast only for a table whose rows were counted and are few; otherwise the join shuffles.

    ``df`` must be cheap to count (a stashed table).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bits of the table of wanted keys that is broadcast, and bits in one of its rows: 4 MB at most, whatever the number of keys.
KEY_BITS, ROW_BITS = 1 << 25, 1 << 15


def likely_among(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """The rows whose key is among the wanted ones, and few others: what an exact join that follows needn't move.

    A bit table of bounded size is broadcast. With so many keys that it fills up it lets more
    through, and the join still decides.
    """
    place = F.pmod(F.xxhash64(*key), F.lit(KEY_BITS))
    row, bit = F.floor(place / ROW_BITS).cast("int"), F.pmod(place, F.lit(ROW_BITS))
    table = wanted.select(row.alias("_row"), bit.alias("_bit")).groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.floor(byte / F.pow(F.lit(2), F.pmod("_bit", F.lit(8)))) % 2 == 1
    return rows.withColumns({"_row": row, "_bit": bit}).join(F.broadcast(table), "_row").where(is_set).select(*rows.columns)


def python_ready(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows and bytes of an Arrow batch, so that long texts don't fill a worker, and lets workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    # Memory that a batch took goes back to the system once it is done, as workers live on.
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "2")):
        spark.sparkContext.environment.setdefault(name, value)
    ready(spark)
