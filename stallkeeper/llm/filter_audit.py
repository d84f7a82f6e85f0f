"""What each order of a set of filters keeps, removes and loses, from one pass over the documents.

A document's failures are the bits of one number, whatever the order of the filters. So each
part of the corpus has a histogram of 32 failure masks, and two more of its good and of its
toxic documents. Stacked as rows they are multiplied by integer matrices of 32 by 600, with a
row for each mask and a column for each step of each of the 120 orders, which hold what one
document of that mask adds to an outcome.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import load, python_ready

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: A step's filter, for all columns of the matrices: order by order, step by step.
STEPS = [(order, step, FILTERS.index(letter)) for order in ORDERS for step, letter in enumerate(order, 1)]
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")


def outcome_matrices() -> dict[str, np.ndarray]:
    """For each outcome the 32 by 600 matrix of what a document with a mask adds at a step."""
    mask = np.arange(MASKS)[:, None]
    own = np.array([1 << f for _, _, f in STEPS])
    before = np.array([sum(1 << FILTERS.index(x) for x in order[: step - 1]) for order, step, _ in STEPS])
    fails, gone = (mask & own) != 0, (mask & before) != 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": fails & (mask == own)}
    return {k: v.astype(np.int64) for k, v in found.items()}


def text_failures(text: Column) -> Column:
    """The bits of the filters that look at one text alone: A to D."""
    # Edge separators leave an empty word at either end.
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    tests = [n < 50, 100 * distinct < 65 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text), text.rlike("[#$%&*|]")]
    bits = [F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def failure_histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of documents, good and toxic ones for each (part, mask).

    Only keys of a few bytes are shuffled: texts count as identical if two independent
    64-bit hashes are. Copies are folded before they move, so no task holds a group of them.
    """
    text = F.coalesce("text", F.lit(""))
    # Rows without an id have no label; their text's hash deals them out.
    row = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    row = row.select(
        "doc_id", "part", text_failures(F.col("text")).alias("mask"), F.xxhash64(F.lit(1), "text").alias("k1"), F.xxhash64(F.lit(2), "text").alias("k2")
    ).withColumn("salt", F.when(F.col("doc_id").isNull(), F.col("k1")).otherwise(0))
    alike = row.groupBy("doc_id", "salt", "k1", "k2", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(x) for c, x in (("quality", "good"), ("toxic", "toxic"))))
    marked = alike.join(said.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").fillna(False, ["good", "toxic"])
    kind = ["k1", "k2", "mask", "part", "good", "toxic"]
    groups = marked.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
    )
    # The least id of a text over all parts, of which each has four rows at most.
    first = F.min("least").over(Window.partitionBy("k1", "k2"))
    firsts = F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    told = groups.withColumn("first", first).withColumn("fresh", firsts + F.col("n_null"))
    count = lambda n: F.struct(*(F.when(c, n).otherwise(0).alias(x) for c, x in ((F.lit(True), "n"), (F.col("good"), "good"), (F.col("toxic"), "toxic"))))
    last = 1 << FILTERS.index("E")
    both = F.array(F.struct("mask", count(F.col("fresh")).alias("c")), F.struct((F.col("mask") + last).alias("mask"), count(F.col("n") - F.col("fresh")).alias("c")))
    cells = told.select("part", F.explode(both).alias("x"))
    return cells.groupBy("part", F.col("x.mask").alias("mask")).agg(*(F.sum(f"x.c.{c}").alias(c) for c in ("n", "good", "toxic")))


OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (part, 32 counts of all, of good and of toxic documents) to 600 rows each."""
    matrices = outcome_matrices()
    filters = np.array([f for _, _, f in STEPS])
    orders, steps = pa.array([o for o, _, _ in STEPS]), pa.array([s for _, s, _ in STEPS], pa.int32())
    for batch in batches:
        rows = np.stack([batch.column(i).flatten().to_numpy().reshape(-1, MASKS) for i in (1, 2, 3)], axis=1)  # part, kind, mask
        for i in range(0, len(rows), 16):
            stacked = rows[i : i + 16]
            found = {k: stacked[:, 0] @ m for k, m in matrices.items()}
            lost = stacked[:, 1:] @ matrices["removed"]
            over_orders = np.stack([found["removed"][:, filters == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
            n = len(stacked)
            numbers = [*(found[k] for k in OUTCOMES), lost[:, 0], lost[:, 1], over_orders[:, filters]]
            part = batch.column(0).slice(i, n).take(pa.array(np.repeat(np.arange(n), len(STEPS))))
            repeated = [pa.concat_arrays([x] * n) for x in (orders, steps)]
            yield pa.RecordBatch.from_arrays([part, *repeated, *(pa.array(x.reshape(-1)) for x in numbers)], [c.split()[0] for c in OUT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic; other columns
    are not read. A null text is empty, a null source the part named by an empty string. Rows
    count one by one, repeated ones too: filter E spares those with the least id of a text and
    those without an id. A document with several labels is good (toxic) if one of them is 1.
    Empty tables give no rows; a part gives 600, zeros included.
    """
    python_ready(docs.sparkSession)
    counts = lambda c: F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.coalesce(F.element_at("at", m)[c], F.lit(0)))
    # A part has 32 masks at most.
    at = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    return failure_histograms(docs, labels).groupBy("part").agg(at.alias("at")).select("part", *(counts(c).alias(c) for c in ("n", "good", "toxic"))).mapInArrow(_products, OUT)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of all orders of the five filters, for each source."""
    return audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


_ORDER_ROWS = ", ".join(f"('{o}')" for o in ORDERS)

OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents
), w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (
  SELECT rid, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS bad
  FROM w LEFT JOIN l USING (doc_id)
), o AS (SELECT filter_order FROM (VALUES {_ORDER_ROWS}) t(filter_order)),
s AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o),
t AS (SELECT filter_order, step, instr('ABCDE', filter_order[step]) AS own, list_transform(range(1, step), lambda i: instr('ABCDE', filter_order[i])) AS before FROM s),
told AS (
  SELECT part, filter_order, step, own, good, toxic, bad[own] AS fails, len(list_filter(before, lambda i: bad[i])) > 0 AS gone, len(list_filter(bad, lambda x: x)) = 1 AS alone FROM f, t
), sums AS (
  SELECT part, filter_order, step, own, count(*) FILTER (NOT fails AND NOT gone) AS kept, count(*) FILTER (fails AND NOT gone) AS removed, count(*) FILTER (fails AND gone) AS redundant,
    count(*) FILTER (fails AND alone) AS unique_fails, count(*) FILTER (fails AND NOT gone AND good) AS good_lost, count(*) FILTER (fails AND NOT gone AND toxic) AS toxic_lost
  FROM told GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM sums
"""
