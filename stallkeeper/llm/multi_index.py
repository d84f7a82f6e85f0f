"""Largest inner products by an inverted multi-index: two codebooks, one for each half of a vector.

Each half gets one more component that brings all halves to one length, with 0 in a query, so
that a small distance is a large inner product. A cell is a pair of centroids. A query walks
the cells by the summed distance of its halves to the two centroids, with a heap over the two
sorted lists, until the cells hold enough entries; those are scored exactly. How many are
enough is measured: for a few sample queries the true neighbours are found by brute force,
and the walk must reach the cells that hold the wanted share of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Stash, load, python_ready

NEAREST = 20
#: Vectors that the codebooks are fitted on at most, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 10
#: Entries of a cell on average; the codebooks grow with the root of the corpus up to a limit that the sample can fit.
CELL_ENTRIES, MOST_CENTROIDS = 12, 1024
#: Sample queries, and the share of their true neighbours that the walk must reach.
TRIALS, RECALL = 200, 0.96
#: Entries that a task holds at once; a cell with more is dealt to several parts.
PART_ENTRIES = 4096
#: Parts whose lists are merged first.
MERGED_PARTS = 64
SEED = 9


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a finite, non-zero vector, as they are in floats or doubles."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    return vectors.where(F.col("vec_id").isNotNull() & fine & F.exists(v, lambda x: x != 0)).select(F.col("vec_id").cast("long"), v.cast(f"array<{kind}>").alias("vector"))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)


def _halves(m: np.ndarray, lengths: tuple[float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The halves of vectors, each with what it lacks of the largest squared length; of queries (no lengths), with 0."""
    half = m.shape[1] // 2
    out = []
    for i, part in enumerate((m[:, :half], m[:, half:])):
        more = np.zeros(len(m)) if lengths is None else np.sqrt(np.maximum(lengths[i] - (part**2).sum(1), 0))
        out.append(np.column_stack([part, more]))
    return tuple(out)


def inner_products(query: np.ndarray, m: np.ndarray) -> np.ndarray:
    """In double precision, added from the first component to the last, so that equal vectors score alike everywhere."""
    total = np.zeros(len(m))
    for j in range(len(query)):
        total += query[j] * m[:, j]
    return total + 0.0


def fit(points: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's rounds from seeded distinct points."""
    draw = np.random.Generator(np.random.PCG64(SEED))
    distinct = np.unique(points, axis=0)
    found = distinct[draw.permutation(len(distinct))[:count]].copy()
    for _ in range(rounds):
        own = nearest(points, found)
        sums = np.zeros_like(found)
        np.add.at(sums, own, points)
        sizes = np.bincount(own, minlength=len(found))
        found[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return found


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * points @ centroids.T, axis=1)


def distances(query: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of a query's halves to the centroids."""
    return tuple(((book - part) ** 2).sum(1) for book, part in zip(books, _halves(query[None, :]), strict=True))


def walk(query: np.ndarray, books: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, enough: int) -> list[int]:
    """Cells by rising summed distance until they hold ``enough`` entries; cells without entries are left out."""
    one, two = distances(query, books)
    first, second = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
    a, b = one[first].tolist(), two[second].tolist()
    width, held, out = len(second), 0, []
    size = sizes.tolist()
    # A row's next cell is offered once the row's last one was taken; a row opens once the row above it began.
    heap = [(a[0] + b[0], 0, 0)]
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        if j + 1 < width:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        cell = first[i] * width + second[j]
        if size[cell]:
            out.append(cell)
            held += size[cell]
    return out


def _enough(distinct: DataFrame, books: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, dimension: int, k: int, recall: float) -> int:
    """Entries that the walk must reach, from sample queries whose true neighbours are found by brute force."""
    trials = distinct.orderBy(F.xxhash64(F.lit(SEED), "entry")).limit(TRIALS).select("entry", "vector").toPandas()
    asked, own = np.array(trials["vector"].tolist(), np.float64).reshape(-1, dimension), trials["entry"].to_numpy()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            scores = asked @ _matrix(batch.column(1), dimension).T
            scores[own[:, None] == entry[None, :]] = -np.inf
            keep = min(k, len(entry))
            top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
            trial = np.repeat(np.arange(len(asked)), keep)
            yield pa.RecordBatch.from_arrays([pa.array(trial), pa.array(scores[trial, top.ravel()]), pa.array(cell[top.ravel()])], ["trial", "score", "cell"])

    order = Window.partitionBy("trial").orderBy(F.desc("score"))
    found = (
        distinct.select("entry", "vector", "cell").mapInArrow(best, "trial long, score double, cell int").where("score > double('-inf')")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("trial", "cell").toPandas()
    )
    needed = []
    for i, cells in found.groupby("trial")["cell"]:
        one, two = distances(asked[i], books)
        by_distance = np.argsort((one[:, None] + two[None, :]).ravel(), kind="stable")
        before = np.empty(len(sizes), np.int64)
        before[by_distance] = np.cumsum(sizes[by_distance]) - sizes[by_distance]
        needed += (before[cells.to_numpy()] + 1).tolist()
    return max(k + 1, int(np.quantile(needed, recall, method="higher"))) if needed else k + 1


def search(vectors: DataFrame, is_query: Column, stash: Stash, k: int = NEAREST, dimension: int | None = None, recall: float = RECALL) -> DataFrame:
    """For each query row its k nearest other rows by inner product: query_id, rank, vec_id, score.

    Null, zero or non-finite vectors and rows without an id take no part. Vectors have
    ``dimension`` components, by default as many as most usable ones (of equally many
    dimensions the larger); others take no part, as they have no inner product with these.
    Equal vectors are one entry that keeps the k + 1 least ids, which is all that any query
    can return of them, so copies cost nothing. Of entries with one score that of the
    smaller least id comes first, and k + 1 entries are enough for k rows. Ties go to the
    smaller vec_id. Repeated ids stay apart unless they repeat the query's own. With fewer
    candidates all are returned; without usable rows the result is empty.

    The codebooks are fitted on SAMPLE vectors at most (drawn by hash) and have at most
    MOST_CENTROIDS centroids, so they and the table of cell sizes are bounded.
    """
    spark = vectors.sparkSession
    python_ready(spark, 2000)
    rows = stash.put("rows", usable(vectors))
    result = "query_id long, rank int, vec_id long, score double"
    if dimension is None:
        common = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
        dimension = common["size"] if common else 0
    rows = rows.where(F.size("vector") == dimension)
    kind = rows.schema["vector"].dataType.simpleString()
    least = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1)
    entries = stash.put("entries", few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("entry"), "vector", "ids"))
    sample = entries.orderBy(F.xxhash64(F.lit(SEED), "vector")).limit(SAMPLE).select("vector").toPandas()
    if not len(sample):
        return spark.createDataFrame([], result)
    half = dimension // 2
    length = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    lengths = tuple(entries.agg(F.max(length(F.slice("vector", 1, half))), F.max(length(F.slice("vector", half + 1, dimension)))).first())
    points = _halves(np.array(sample["vector"].tolist(), np.float64), lengths)
    count = min(MOST_CENTROIDS, int(np.sqrt(entries.count() / CELL_ENTRIES)) + 1, max(1, len(sample) // 8))
    books = fit(points[0], count), fit(points[1], count)
    width = len(books[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = _halves(_matrix(batch.column(1), dimension), lengths)
            cell = nearest(one, books[0]) * width + nearest(two, books[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["entry", "vector", "ids", "cell"])

    placed = stash.put("placed", entries.mapInArrow(place, f"entry long, vector {kind}, ids array<long>, cell int"))
    held = placed.groupBy("cell").count().toPandas()  # one row for each cell: the codebooks bound them
    sizes = np.zeros(len(books[0]) * width, np.int64)
    sizes[held["cell"].to_numpy()] = held["count"].to_numpy()
    enough = _enough(placed, books, sizes, dimension, k, recall)

    # Parts of about equal size, in the order of cells; a large cell gets parts of its own.
    shares = np.maximum(1, -(-sizes // PART_ENTRIES))
    begins = np.cumsum(sizes) - sizes
    part = begins // PART_ENTRIES
    part = part + np.cumsum(shares - 1) - (shares - 1)
    parts = int((part + shares).max())
    value = pa.float32() if kind == "array<float>" else pa.float64()
    names = ["part", "kind", "id", "least", "cell", "vector", "cells"]
    schema = f"part int, kind int, id long, least long, cell int, vector {kind}, cells array<int>"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries to their part, first of all rows there."""
        for batch in batches:
            cell, entry = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            to = part[cell] + entry % shares[cell]
            none = pa.nulls(len(batch), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(np.zeros(len(batch), np.int32)), *batch.columns, none], names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query to every part that holds a cell of its walk."""
        for batch in batches:
            ids, to, lists, index = batch.column(0).to_numpy(), [], [], []
            for i, query in enumerate(_matrix(batch.column(1), dimension)):
                by_part: dict[int, list[int]] = {}
                for cell in walk(query, books, sizes, enough):
                    for s in range(int(shares[cell])):
                        by_part.setdefault(int(part[cell]) + s, []).append(cell)
                to += by_part
                lists += by_part.values()
                index += [i] * len(by_part)
            n = len(to)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), pa.array(np.ones(n, np.int32)), pa.array(ids[index], pa.int64()), none, none.cast(pa.int32()), batch.column(1).take(pa.array(index, pa.int64())).cast(pa.list_(value)), pa.array(lists, pa.list_(pa.int32()))], names
            )

    query_rows = stash.put("queries", rows.where(is_query).join(placed.select("vector", "entry"), "vector").select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query")))
    asked = placed.join(query_rows.select(F.col("query").alias("entry")).distinct(), "entry", "left_semi")
    dealt = placed.select("entry", F.col("ids")[0].alias("least"), "cell", "vector")
    rows_in = dealt.mapInArrow(deal, schema).union(asked.select("entry", "vector").mapInArrow(ask, schema))
    keep = k + 1

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Holds one part's entries and streams its queries past them."""
        now, held, final = None, [], False
        for batch in batches:
            of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]))).tolist() + [len(batch)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                run = batch.slice(a, b - a)
                if of[a] != now:
                    now, held, final = of[a], [], False
                if kind[a] == 0:
                    held.append([*(run.column(i).to_numpy() for i in (2, 3, 4)), _matrix(run.column(5), dimension)])
                    continue
                if not final:
                    held, final = [np.concatenate(x) for x in zip(*held, strict=True)], True
                ids, least, cells, matrix = held
                for at in range(0, len(run), 256):
                    some = run.slice(at, 256)
                    queries = _matrix(some.column(5), dimension)
                    scores = queries @ matrix.T
                    found = []
                    for i, wanted in enumerate(some.column(6)):
                        mark = np.zeros(len(sizes), bool)
                        mark[wanted.values.to_numpy()] = True
                        inside = np.flatnonzero(mark[cells])
                        own = scores[i, inside]
                        if len(own) > keep:
                            # All that rounding may put among the best; they are scored again in a fixed order.
                            limit = np.partition(own, len(own) - keep)[len(own) - keep]
                            inside = inside[own >= limit - 1e-9 * (1 + np.abs(own).max())]
                        exact = inner_products(queries[i], matrix[inside])
                        order = np.lexsort((least[inside], -exact))[:keep]
                        found.append((-exact[order], least[inside][order], ids[inside][order]))
                    ends = np.concatenate([[0], np.cumsum([len(x[0]) for x in found])])
                    best = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["far", "least", "entry"])
                    yield pa.RecordBatch.from_arrays([some.column(2), pa.array(np.full(len(some), of[a] // MERGED_PARTS, np.int32)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), best)], ["query", "parts", "best"])

    near = rows_in.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(rerank, "query long, parts int, best array<struct<far:double,least:long,entry:long>>")
    # A query's lists are merged in two steps, so that each gathers few.
    for keys in (("query", "parts"), ("query",)):
        near = near.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, keep).alias("best"))
    top = stash.put("top", near.select("query", F.explode("best").alias("one")).select("query", "one.entry", (-F.col("one.far")).alias("score")))
    scored = top.join(placed.select("entry", "ids"), "entry").select("query", "score", "ids")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        query_rows.join(scored, "query").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth id."""
    return search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, Stash(spark, "op8"))
