"""Near-duplicate documents by circulant MinHash, confirmed by exact Jaccard similarity.

Two permutations serve all coordinates of a signature. The first spreads a document's
shingles over a circle; coordinate k is the least value that the second permutation, turned
by k places, has on them. As turned copies lie side by side, all coordinates of a shingle
are one slice of one array. Signatures are banded; documents that share a band are
candidates, and every link is confirmed on the full shingle sets.

Within a band's bucket, candidates are compared with three pivots first, never all with all:
what is in one component needs no further link. Where components still differ, those outside
the bucket's largest one are compared with the rest, in the least bucket that a pair shares.
Bit tables of the sets come before the sets themselves: every bit that only one of two tables
has stands for a shingle at least that only one set has, so pairs that differ in too many
bits are surely not similar enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Stash, likely_among, load, python_ready
from .textkit import LOWER, Rolling, buffer_of, mix, shingles, word_bounds

WORDS = 5
#: Percent of the union that the intersection must reach.
PERCENT = 75
#: Bands and coordinates in a band: two documents at the threshold share no band three times in a million.
#: Long bands keep apart documents that only share a passage, which shorter ones would bring together in large buckets.
BANDS, ROWS = 64, 6
#: Bits of a set's bit table, as 64-bit words.
TABLE_BITS = 2048
TABLE = [f"s{i}" for i in range(TABLE_BITS // 64)]
#: Pivots that every member meets first: the least by number, so that members of a group meet the same ones.
FIRST_PIVOTS = 4
#: Places on the circle, and the seed of both permutations.
CIRCLE, SEED = 1 << 20, 77
#: Bytes of text that are hashed together.
BLOCK = 1 << 20
#: Links up to which a graph's tables of nodes are broadcast: two numbers a node.
SMALL_GRAPH = 200_000
_held: dict = {}


def _tools() -> tuple[Rolling, np.ndarray]:
    """The word hash (whose mixing with the circle's size is the first permutation) and the second permutation, extended by the most turns."""
    if not _held:
        second = np.random.Generator(np.random.PCG64(SEED)).permutation(CIRCLE).astype(np.int32)
        _held["tools"] = Rolling(SEED), np.concatenate([second, second[: BANDS * ROWS]])
    return _held["tools"]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    rolling, _ = _tools()
    raw, bounds = buffer_of(texts)
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + BLOCK, side="right")) - 1)
        data = LOWER[raw[bounds[first] : bounds[last]]]
        starts, ends, of_text = word_bounds(data, bounds[first : last + 1] - bounds[first])
        words = mix(rolling.between(rolling.sums(data), starts, ends)) if len(starts) else np.zeros(0, np.uint64)
        for a, b in zip(of_text[:-1].tolist(), of_text[1:].tolist(), strict=True):
            own = words[a:b]
            # With fewer words the whole sequence is the one shingle.
            yield np.unique(shingles(own, WORDS) if b - a >= WORDS else shingles(own, b - a) + np.uint64(b - a) if b > a else own)
        first = last


def coordinates(own: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` coordinates of a non-empty set's signature."""
    turned = np.lib.stride_tricks.sliding_window_view(_tools()[1], count)
    places = (mix(own + np.uint64(SEED)) & np.uint64(CIRCLE - 1)).astype(np.int64)
    least = np.full(count, CIRCLE, np.int32)
    step = max(1, 800_000 // count)
    for at in range(0, len(places), step):
        least = np.minimum(least, turned[places[at : at + step]].min(axis=0))
    return least


def signature_bands(own: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a non-empty set."""
    values = coordinates(own, BANDS * ROWS).astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, r])
    return key.view(np.int64)


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two digests of each set that don't depend on order."""
    one = [int(np.bitwise_xor.reduce(mix(x + np.uint64(1)))) if len(x) else 0 for x in sets]
    two = [int(np.sum(mix(x + np.uint64(2)), dtype=np.uint64)) if len(x) else 0 for x in sets]
    return [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in values])]), pa.int32()), pa.array(flat.view(np.int64)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(shingle_sets(batch.column(2)))
        bands = [signature_bands(x) if len(x) else np.zeros(0, np.int64) for x in found]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(x) for x in found], pa.int64()), *_digests(found), _lists(bands)], ["doc_id", "text_hash", "n_shingles", "d1", "d2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [x for x in shingle_sets(batch.column(0)) if len(x)]
        bits = np.zeros((len(found), TABLE_BITS), bool)
        for row, x in zip(bits, found, strict=True):
            row[(x >> np.uint64(32)).astype(np.int64) % TABLE_BITS] = True
        tables = np.packbits(bits, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([*_digests(found), _lists(found), *(pa.array(tables[:, i].copy()) for i in range(len(TABLE)))], ["d1", "d2", "shingles", *TABLE])


def components(links: DataFrame, stash: Stash, name: str, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """(node, label): the least node that each linked node reaches. Alternates large and small stars until nothing changes.

    Nodes without a link have no row. Each step is a written table; only two totals come to
    the driver. What a star's nodes need to know of it is a row for each node: broadcast while
    the links are few, else written, so that the join with it is a plain one whose hot keys
    (centres of large stars) Spark can split.
    """
    edges = stash.put(f"{name}-0", links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    count, state, step = edges.count(), None, 0

    def beside(rows: DataFrame, what: str) -> DataFrame:
        return F.broadcast(rows) if count <= small_graph else stash.put(f"{name}-{what}-{step}", rows)

    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = beside(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large if count <= small_graph else stash.put(f"{name}-large-{step}", large)
        own = beside(large.groupBy("u").agg(F.min("v").alias("m")), "own")
        small = large.join(own, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own.select("u", F.col("m").alias("v"))).distinct()
        edges = stash.put(f"{name}-{step + 1}", small)
        stash.drop(*(f"{name}-{what}{step}" for what in ("", "least-", "large-", "own-")))
        step += 1
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        count = now[0]
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = now


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (u, v) whose sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(left, "u").join(right, "v").where(100 * both >= PERCENT * (F.size("a") + F.size("b") - both)).select("u", "v")


def _open(a: str, b: str) -> Column:
    """Whether sizes and bit tables leave it open that two sides (columns behind the prefixes) are similar enough.

    Sets of n and m with d elements in one of them only have a similarity of (n + m - d) / (n + m + d), and d is no less
    than the bits in one table only.
    """
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    bits = reduce(Column.__add__, (F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in TABLE))
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & ((100 + PERCENT) * bits <= (100 - PERCENT) * (n + m))


def _side(rows: DataFrame, prefix: str, *more: str | Column) -> DataFrame:
    return rows.select(*more, *(F.col(c).alias(f"{prefix}{c}") for c in ("node", "n", *TABLE)))


def _open_pairs(pairs: DataFrame, tables: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of nodes and pivots that may be similar enough."""
    ends = pairs.select(F.least("node", "pivot").alias("a_node"), F.greatest("node", "pivot").alias("b_node")).distinct()
    both = ends.join(_side(tables, "a_"), "a_node").join(_side(tables, "b_"), "b_node").where(_open("a_", "b_"))
    return both.select(F.col("a_node").alias("u"), F.col("b_node").alias("v"))


def _mixed(members: DataFrame, labels: DataFrame, stash: Stash, step: str) -> DataFrame:
    """Members of buckets with several components, and whether they are outside their bucket's largest one."""
    named = stash.put(f"named-{step}", members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    shares = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("share"))
    major = F.max(F.struct("share", "label"))["label"].alias("major")
    mixed = shares.groupBy("key").agg(major, F.count(F.lit(1)).alias("labels")).where("labels > 1").select("key", "major")
    return stash.put(f"mixed-{step}", named.join(mixed, "key").select("key", "node", "label", (F.col("label") != F.col("major")).alias("outside")))


def _open_within(mixed: DataFrame, tables: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of different components that share a bucket and may be similar enough.

    A pair is looked at in the least bucket that it shares, where one of the two at least is
    outside the largest component.
    """
    each = mixed.groupBy("node", "label").agg(F.collect_list("key").alias("keys")).join(tables, "node")
    rows = mixed.select("key", "node", "outside").join(each, "node")
    left = _side(rows.where("outside"), "a_", "key", F.col("label").alias("a_label"), F.col("keys").alias("a_keys"))
    right = _side(rows, "b_", "key", F.col("label").alias("b_label"), F.col("keys").alias("b_keys"), "outside")
    once = (F.col("a_label") != F.col("b_label")) & (~F.col("outside") | (F.col("a_node") < F.col("b_node")))
    least = F.col("key") == F.array_min(F.array_intersect("a_keys", "b_keys"))
    pairs = left.join(right, "key").where(once & _open("a_", "b_") & least)
    return pairs.select(F.least("a_node", "b_node").alias("u"), F.greatest("a_node", "b_node").alias("v")).distinct()


def find_groups(docs: DataFrame, stash: Stash) -> DataFrame:
    """One row for each document: doc_id, text_hash, n_shingles, component_id and kept.

    Documents without words (null or empty text) have no shingles and are linked with
    nothing. Rows with a null doc_id are linked with nothing either and kept, with a null
    component_id. Rows that repeat a doc_id are judged each by its own text; equal texts link
    them. An empty table gives no rows. Other columns are not read.
    """
    python_ready(docs.sparkSession, 500)
    texts = docs.select(F.col("doc_id").cast("long"), _text_hash().alias("text_hash"), F.col("text").cast("string"))
    marks = stash.put("marks", texts.mapInArrow(_signatures, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, bands array<long>"))
    usable = marks.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets are one node, so no number of exact copies makes a bucket large.
    nodes = stash.put(
        "nodes",
        usable.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
        .select(F.monotonically_increasing_id().alias("node"), "d1", "d2", F.col("n_shingles").alias("n"), "least", "bands"),
    )
    banded = nodes.select(F.explode("bands").alias("key"), "node")
    # Most buckets hold one node: only counts are made for them.
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    members = stash.put("members", banded.join(shared, "key"))
    # Three pivots for each bucket, by orders that hold in all buckets: members of a group meet the same few pivots.
    drawn = F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"]
    pivots = members.groupBy("key").agg(F.array(F.min("node"), F.max("node"), drawn).alias("pivots"))
    touched = members.select("node").distinct()
    wanted = stash.put("wanted", nodes.join(touched, "node").select("node", "d1", "d2", "least"))
    # Sets are made again from the texts of candidates alone: to keep all of them would take more room than the texts.
    ids = wanted.select(F.col("least").alias("doc_id")).distinct()
    # A semi join would be moved below the bit table and shuffle all texts again.
    again = likely_among(texts.select("doc_id", "text"), ids, "doc_id").join(ids, "doc_id").select("text")
    made = again.mapInArrow(_sets, "d1 long, d2 long, shingles array<long>, " + ", ".join(f"{c} long" for c in TABLE))
    each = [F.first(c).alias(c) for c in ("shingles", *TABLE)]
    sets = stash.put("sets", made.join(wanted.select("node", "d1", "d2"), ["d1", "d2"]).groupBy("node").agg(*each))
    tables = sets.select("node", F.size("shingles").alias("n"), *TABLE)

    met = stash.put("met", members.join(pivots, "key").select("node", F.explode("pivots").alias("pivot")).where("node <> pivot").distinct())
    few = Window.partitionBy("node").orderBy("pivot")
    first = met.withColumn("rank", F.row_number().over(few)).where(F.col("rank") <= FIRST_PIVOTS)
    links = stash.put("links-1", _confirm(_open_pairs(first, tables), sets))
    labels = components(links, stash, "labels-1")
    # Those still outside meet all their pivots, and if that doesn't take them in, all members that their tables leave open.
    outside = _mixed(members, labels, stash, "1").where("outside").select("node").distinct()
    links = stash.put("links-2", links.union(_confirm(_open_pairs(met.join(outside, "node", "left_semi"), tables), sets)))
    labels = components(links, stash, "labels-2")
    pairs = stash.put("pairs", _open_within(_mixed(members, labels, stash, "2"), tables))
    more = stash.put("links-3", _confirm(pairs, sets))
    if not more.isEmpty():
        labels = components(links.union(more), stash, "labels-3")
    stash.drop("met", "pairs", *(f"{name}-{i}" for i in (1, 2) for name in ("named", "mixed")))
    stash.drop("sets")

    placed = nodes.join(labels, "node", "left").select("node", "d1", "d2", "n", "least", F.coalesce("label", "node").alias("label"))
    named = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    by_set = placed.join(named, "label").select("d1", "d2", F.col("n").alias("n_shingles"), "component_id")
    linked = usable.select("doc_id", "text_hash", "n_shingles", "d1", "d2").join(by_set, ["d1", "d2", "n_shingles"]).select("doc_id", "text_hash", "n_shingles", "component_id")
    alone = marks.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def keep_first(docs: DataFrame, stash: Stash) -> DataFrame:
    """One document of each group, with all its columns.

    It is the one with the least doc_id; of several texts under that id the one with the
    least hash; of rows that are equal in id and text any one. Rows that are linked with
    nothing because they have no words or no doc_id all stay. A row goes by its own text, so
    a text that is found nowhere else stays, whatever other rows share its id.
    """
    linked = stash.put("linked", find_groups(docs, stash).where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("component_id", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows")))
    stash.drop("marks", "nodes", "members", "wanted")
    # Written, so that the join with a large group is a plain one that Spark can split.
    first = stash.put("first", linked.where("doc_id = component_id").groupBy("component_id").agg(F.min("text_hash").alias("least")))
    # A few ids, one row each: those of equal texts under one id and those that lead a group.
    judged = stash.put("judged", linked.join(first, "component_id").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), ((F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("least"))).alias("_first"), (F.col("rows") > 1).alias("_again")))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("_id"), _text_hash().alias("_hash"))
    gone = judged.where("NOT _first OR _again").select("_id", "_hash")
    kept = whole.join(gone, ["_id", "_hash"], "left_anti").select("row.*")
    again = judged.where("_first AND _again").select("_id", "_hash")
    if again.isEmpty():
        return kept
    one = whole.join(again, ["_id", "_hash"]).groupBy("_id", "_hash").agg(F.first("row").alias("row"))
    return kept.union(one.select("row.*"))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set size, component and whether it is the one to keep."""
    return find_groups(load(spark, sf_dir, "documents"), Stash(spark, "op9")).drop("text_hash")
