"""The streams leave what batches would."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stallkeeper.operators.staging import last_write_wins
from stallkeeper.streaming import ingest


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 7).alias("key"), F.col("id").alias("seq"), (F.col("id") * 3).alias("price"))
    rows.repartition(6).write.parquet(f"{tmp_path}/in")
    stage = ingest.StreamStage(spark, f"{tmp_path}/stage", ingest.latest_by("key", F.desc("seq")), every=2)
    for _ in range(2):  # the second run finds nothing new
        listings = ingest.read_listings(spark, f"{tmp_path}/in", rows.schema, files=2)
        ingest.stage_stream(listings, stage, f"{tmp_path}/checkpoint").awaitTermination()
    want = {tuple(r) for r in last_write_wins(rows, "key", F.col("seq")).collect()}
    found = lambda: {(r["key"], r["seq"], r["price"]) for r in stage.read().collect()}
    assert found() == want and stage.numbers("batch") == [0, 1, 2] and stage.numbers("base") == [1]
    stage.add(rows.withColumn("seq", F.col("seq") + 99), 2)  # a replay
    assert found() == want


def test_old_bases_are_swept(spark, tmp_path):
    stage = ingest.StreamStage(spark, f"{tmp_path}/stage", ingest.latest_by("key", F.desc("seq")), every=2)
    for n in range(8):
        stage.add(spark.createDataFrame([(n % 3, n)], "key int, seq int"), n)
    assert {tuple(r) for r in stage.read().collect()} == {(0, 6), (1, 7), (2, 5)}
    # The last two bases are there, with what came after the first of them.
    assert stage.numbers("base") == [5, 7] and stage.numbers("batch") == [6, 7]
    stage.add(spark.createDataFrame([(0, 99)], "key int, seq int"), 3)  # a replay of a swept batch
    assert {tuple(r) for r in stage.read().collect()} == {(0, 6), (1, 7), (2, 5)}


def run(rows, name):
    """All rows of an append-only stream."""
    query = rows.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.table(name).collect()


def test_pages_and_counts_of_a_stream(spark, tmp_path):
    day = datetime(2026, 1, 1)
    schema = "category string, signature string, provider_id long, ts timestamp"
    batches = [
        [("gpu", "a", 1, day), ("gpu", "a", 1, day + timedelta(minutes=5)), ("gpu", "b", 2, day)],
        [("gpu", "a", 1, day + timedelta(minutes=20)), ("cpu", "a", 1, day + timedelta(days=20))],
        [("cpu", "c", 2, day + timedelta(days=60))],
        [("cpu", "a", 1, day + timedelta(days=1))],
    ]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for f in (tmp_path / "in").glob("part-*.parquet"):
            f.rename(tmp_path / "in" / f"{i}-{f.name.replace('part', 'p')}")
        time.sleep(1.1)  # files come in order of their times
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    first = run(ingest.first_pages(read(), "1 hour"), "first_pages")
    assert sorted((r["category"], r["signature"]) for r in first) == [("cpu", "a"), ("cpu", "c"), ("gpu", "a"), ("gpu", "b")]
    counts = run(ingest.fresh_counts(read()), "fresh_counts")
    # The row of the second day comes when the horizon has passed it; the last day is still open.
    assert sorted((r["day"]["start"], r["provider_id"], r["offers"]) for r in counts) == [(day, 1, 3), (day, 2, 1), (day + timedelta(days=20), 1, 1)]
