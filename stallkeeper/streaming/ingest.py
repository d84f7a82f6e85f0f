"""The staging path as a stream: listings arrive as files and land in a deduplicated stage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_listings(spark: SparkSession, path: str, schema: StructType, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


class StreamStage:
    """A deduplicated stage that micro-batches add to, as a base and the batches since.

    A batch is merged within itself and published as a folder that carries its number, so a
    replay after a failure is recognised by name. Reading merges the base with the batches
    after it; every ``every`` batches they become the next base, so what a batch writes
    doesn't grow with the stage. ``merge`` leaves one row for each key of any union.
    """

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], every: int = 20):
        self.spark, self.path, self.merge, self.every = spark, path, merge, every
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self, kind: str) -> list[int]:
        """Numbers of the published folders of a kind: base or batch."""
        if not self._fs.exists(self._at(self.path)):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._at(self.path)))
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))

    def _publish(self, rows: DataFrame, name: str) -> None:
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        # A rename onto a folder that is there would move into it.
        if self._fs.exists(self._at(f"{self.path}/{name}")) or not self._fs.rename(self._at(staged), self._at(f"{self.path}/{name}")):
            self._fs.delete(self._at(staged), True)
            raise OSError(f"{name} could not be published")

    def read(self) -> DataFrame:
        bases = self.numbers("base")
        last = bases[-1] if bases else -1
        names = [*(f"base={n}" for n in bases[-1:]), *(f"batch={n}" for n in self.numbers("batch") if n > last)]
        return self.merge(self.spark.read.parquet(*(f"{self.path}/{n}" for n in names)))

    def add(self, rows: DataFrame, number: int) -> None:
        """Publishes a batch, but one that was published before."""
        if number in self.numbers("batch") or number <= (self.numbers("base") or [-1])[-1]:
            return
        self._publish(self.merge(rows), f"batch={number}")
        if number - (self.numbers("base") or [-1])[-1] >= self.every:
            self._publish(self.read(), f"base={number}")
            self._sweep()

    def _sweep(self) -> None:
        """Removes what the base before the last held; a reader of the last two bases still has all that they need.

        The newest batch stays in any case, as the mark that it was added.
        """
        bases = self.numbers("base")
        if len(bases) > 1:
            gone = [f"base={n}" for n in bases[:-2]] + [f"batch={n}" for n in self.numbers("batch")[:-1] if n <= bases[-2]]
            for name in gone:
                self._fs.delete(self._at(f"{self.path}/{name}"), True)


def stage_stream(listings: DataFrame, stage: StreamStage, checkpoint: str) -> StreamingQuery:
    """Adds each micro-batch to the stage once, whatever fails on the way."""
    return listings.writeStream.foreachBatch(stage.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_by(key: str, *order) -> Callable[[DataFrame], DataFrame]:
    """Keeps the last row of each key."""

    def merge(rows: DataFrame) -> DataFrame:
        last = Window.partitionBy(key).orderBy(*order)
        return rows.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")

    return merge


def first_pages(pages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Pages whose category and signature were not seen within the delay."""
    return pages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["category", "signature"])


def fresh_counts(events: DataFrame, delay: str = "9 days", window: str = "1 day") -> DataFrame:
    """Offers seen by provider and day; what comes later than the horizon is left out."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("day"), "provider_id").agg(F.count(F.lit(1)).alias("offers"))
