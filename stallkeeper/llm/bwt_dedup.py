"""Removal of long repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Such a
string always has its winnowing anchor (the least hash among its k-grams) in the same place,
so suffixes are dealt to tasks by anchor and no repeat is split. Runs of windows with one
anchor are contexts; equal contexts are one entry that weighs as much as it has copies, so
copies cost nothing. Every context whose anchor occurs again enters the transforms; anchors
with very many contexts are cut finer by the bytes beside the anchor first.

A task cuts its entries into shards, builds the transform of each, and merges the transforms
two by two: starting from the first symbols it refines the interleave, doubling the compared
prefix each time by composing the transforms' own successor maps. Within a shard the order
is already right, so a refinement only merges two sorted runs and never sorts suffixes
again. The depths at which neighbours part are their common prefixes (rounded down to the
depths of the refinement), and where they reach ``length`` lies a repeated interval, whose
members repeat each other if together they weigh more than one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Stash, broadcast_if_small, likely_among, load, python_ready
from .textkit import Rolling, buffer_of, mix

LENGTH = 200
#: Bytes of an anchor.
GRAM = 24
#: Contexts that a task merges on average, and bytes of the shards it begins with.
BUCKET_CONTEXTS, SHARD_BYTES = 1000, 200_000
#: Anchors with more distinct contexts than this are cut finer, so that none fills a task.
HOT_CONTEXTS = 4000
#: Contexts that may each be more than one in so many of all; they are known to every task, so that no key of a join is hot.
FREQUENT = 20_000
#: Bytes of text that are hashed together (longer texts by overlapping parts), and bits that tell its places apart.
BLOCK, PLACE_BITS = 1 << 20, np.uint64(22)
#: Symbols in a first comparison: nine bits each.
SYMBOLS = 7
_held: dict = {}


def _rollings() -> tuple[Rolling, Rolling]:
    if not _held:
        _held["two"] = Rolling(41), Rolling(43)
    return _held["two"]


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    padded = np.concatenate([keys, np.full(-len(keys) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(keys) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts_of(raw: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Maximal runs of windows that have the same anchor, for texts of a block of at most BLOCK + length bytes.

    For each run: the text's index, the start of its first window in the block, how many
    windows, where in the first one the anchor lies, the anchor's hash and two digests of the
    bytes that the windows cover. Of equal anchors in a window the leftmost counts.
    """
    empty = dict.fromkeys(("text", "at", "windows", "inset"), np.zeros(0, np.int64)) | dict.fromkeys(("key", "d1", "d2"), np.zeros(0, np.uint64))
    if len(raw) < length:
        return empty
    one, two = _rollings()
    sums, other = one.sums(raw), two.sums(raw)
    at = np.arange(len(raw) - gram + 1)
    grams = mix(one.between(sums, at, at + gram))
    least = _sliding_least((grams >> PLACE_BITS << PLACE_BITS) | at.astype(np.uint64), length - gram + 1)
    anchor = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    # Windows that end in the text in which they start.
    stays = np.zeros(len(raw) + 1, np.int32)
    ok = np.diff(bounds) >= length
    np.add.at(stays, bounds[:-1][ok], 1)
    np.add.at(stays, bounds[1:][ok] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(stays[:-1]) > 0)
    if not len(starts):
        return empty
    anchor = anchor[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    begin, count, anchor = starts[first], np.diff(np.append(first, len(starts))), anchor[first]
    end = begin + count - 1 + length
    return {
        "text": np.searchsorted(bounds, begin, side="right") - 1, "at": begin, "windows": count, "inset": anchor - begin,
        "key": grams[anchor], "d1": mix(one.between(sums, begin, end)), "d2": mix(two.between(other, begin, end)),
    }


def _blocks(bounds: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, text after the last, first byte, byte after the last): whole texts together, or overlapping parts of a long one."""
    first = 0
    while first < len(bounds) - 1:
        last = int(np.searchsorted(bounds, bounds[first] + BLOCK, side="right")) - 1
        if last > first:
            yield first, last, int(bounds[first]), int(bounds[last])
        else:
            last = first + 1
            for begin in range(int(bounds[first]), int(bounds[last]) - length + 1, BLOCK):
                yield first, last, begin, min(begin + BLOCK + length - 1, int(bounds[last]))
        first = last


#: What is known of a run of windows: where it is, the part of the anchor's surroundings that its key stands for (bytes before
#: and after the anchor's start) and two digests.
RUN = "t1 long, t2 long, at int, windows int, inset int, before int, after int, key long, d1 long, d2 long"
RUN_NAMES = [x.split()[0] for x in RUN.split(", ")]


def _run_batch(t1: pa.Array, t2: pa.Array, small: list[np.ndarray], large: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([t1, t2, *(pa.array(x.astype(np.int32)) for x in small), *(pa.array(x.view(np.int64)) for x in large)], RUN_NAMES)


def _context_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = buffer_of(batch.column(2))
        for first, last, begin, end in _blocks(bounds, length):
            own = np.clip(bounds[first : last + 1], begin, end) - begin
            x = contexts_of(raw[begin:end], own, length)
            rows = pa.array(x["text"] + first)
            at = x["at"] + begin - bounds[x["text"] + first]
            known = [np.zeros(len(at), np.int32), np.full(len(at), GRAM, np.int32)]
            yield _run_batch(batch.column(0).take(rows), batch.column(1).take(rows), [at, x["windows"], x["inset"], *known], [x["key"], x["d1"], x["d2"]])


def _finer_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs cut in two where more of the anchor's surroundings lies inside every window: half of the rest before it or half of it after."""
    one, two = _rollings()
    for batch in batches:
        raw, bounds = buffer_of(batch.column(2))
        rows, inside = _lists_of(batch.column(3))
        sums, other = one.sums(raw), two.sums(raw)
        at, windows, inset, before, after = (inside.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "windows", "inset", "before", "after"))
        more = (length - before - after + 1) // 2
        left = np.clip(inset - before - more + 1, 0, windows)
        for count, skip, b, a in ((left, np.zeros_like(left), before + more, after), (windows - left, left, before, after + more)):
            some = np.flatnonzero(count)
            row, place, n, i, b, a = rows[some], (at + skip)[some], count[some], (inset - skip)[some], b[some], a[some]
            begin = bounds[row] + place
            end, anchor = begin + n - 1 + length, begin + i
            key = mix(one.between(sums, anchor - b, anchor + a) + b.astype(np.uint64))
            take = pa.array(row)
            yield _run_batch(batch.column(0).take(take), batch.column(1).take(take), [place, n, i, b, a], [key, mix(one.between(sums, begin, end)), mix(two.between(other, begin, end))])


def _lists_of(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """The elements of a list column end to end, and the row of each."""
    return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False)), column.flatten()


class Order:
    """Rows in order of a key that is refined step by step; only rows of blocks that are still equal are looked at again."""

    def __init__(self, key: np.ndarray, stable: bool = True):
        self.rows, self.rank, self.open = np.zeros(len(key), np.int32), np.zeros(len(key), np.int32), np.arange(len(key))
        self._place(np.arange(len(key)), key, stable)

    def _place(self, rows: np.ndarray, key: np.ndarray, stable: bool) -> None:
        """Sorts the open rows by key; a row's rank is the place where its block begins. ``alike`` are places whose row equals the one before."""
        order = np.argsort(key, kind="stable" if stable else None)
        key, rows = key[order], rows[order]
        fresh = np.ones(len(key) + 1, bool)
        fresh[1:-1] = key[1:] != key[:-1]
        self.rows[self.open] = rows
        begins = np.flatnonzero(fresh[:-1])
        self.rank[rows] = np.repeat(self.open[begins], np.diff(np.append(begins, len(key))))
        self.alike = self.open[~fresh[:-1]]
        self.open = self.open[~(fresh[:-1] & fresh[1:])]

    def refine(self, more: np.ndarray, stable: bool = True) -> None:
        """Splits the blocks of the open rows by one more number for each of them, below their count plus two."""
        rows = self.rows[self.open]
        self._place(rows, self.rank[rows].astype(np.int64) * (len(self.rank) + 2) + more, stable)

    def settle(self) -> None:
        """Brings rows that stayed equal in order of their numbers."""
        self.refine(self.rows[self.open])


class Transform:
    """The Burrows-Wheeler transform of a set of strings, with the text position and the first SYMBOLS symbols of every suffix.

    Symbols are bytes plus one; 0 ends a string. Strings end apart, so suffixes that are
    equal to their ends keep the order of their strings.
    """

    def __init__(self, symbols: np.ndarray, places: np.ndarray, heads: np.ndarray):
        self.symbols, self.places, self.heads = symbols, places, heads

    @classmethod
    def build(cls, strings: list[np.ndarray], offset: int) -> Transform:
        """Sorts one shard's suffixes by prefix doubling. ``offset`` is the place of the first symbol."""
        text = np.zeros(sum(map(len, strings)) + len(strings), np.uint16)
        at = 0
        for s in strings:
            text[at : at + len(s)] = s
            text[at : at + len(s)] += 1
            at += len(s) + 1
        n = len(text)
        ends = np.flatnonzero(text == 0)
        room = np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(n)
        key = np.zeros(n, np.uint64)
        for k in range(SYMBOLS):
            key <<= np.uint64(9)
            key[: max(n - k, 0)] |= np.where(room[: max(n - k, 0)] > k, text[k:], 0).astype(np.uint64)
        order, depth = Order(key, stable=False), SYMBOLS
        while len(order.open) and depth <= room.max():
            rows = order.rows[order.open]
            order.refine(np.where(room[rows] >= depth, order.rank[np.minimum(rows + depth, n - 1)] + 1, 0), stable=False)
            depth *= 2
        order.settle()
        before = text[np.maximum(order.rows, 1) - 1]
        before[order.rows == 0] = 0
        return cls(before, order.rows + offset, key[order.rows])

    def follow(self) -> np.ndarray:
        """The row of the suffix one symbol on, for every row; an ended string stays where it is."""
        after = np.argsort(self.symbols, kind="stable")
        ended = int((self.symbols == 0).sum())
        after[:ended] = np.arange(ended)
        return after


def merge(left: Transform, right: Transform, length: int) -> tuple[Transform, np.ndarray]:
    """The transform of both sets, and for each of its rows the common prefix with the row before.

    Common prefixes are rounded down to the depths of the refinement, of which the last is
    ``length``; rows that are equal to their ends count as sharing ``length`` symbols.
    """
    n, m, depth = len(left.symbols), len(right.symbols), min(SYMBOLS, length)
    after = np.concatenate([left.follow(), right.follow() + n]).astype(np.int32)
    heads, shared = np.concatenate([left.heads, right.heads]), np.zeros(n + m, np.int16)
    key = heads >> np.uint64(9 * (SYMBOLS - depth))
    step = _power(after, depth)
    order = Order(key)  # of two sorted runs: one merge
    shared[order.alike] = depth
    steps = [(depth, step)]
    while depth < length and len(order.open):
        # The last refinement overlaps the one before, so that it ends at ``length``.
        ahead = min(depth, length - depth)
        order.refine(order.rank[_ahead(order.rows[order.open], ahead, steps, after)])
        depth += ahead
        shared[order.alike] = depth
        if depth < length:
            step = step[step]
            steps.append((depth, step))
    symbols, places = np.concatenate([left.symbols, right.symbols]), np.concatenate([left.places, right.places])
    return Transform(symbols[order.rows], places[order.rows], heads[order.rows]), shared


def _power(after: np.ndarray, count: int) -> np.ndarray:
    """The rows ``count`` symbols on, for all rows."""
    out = None
    while count:
        if count & 1:
            out = after if out is None else after[out]
        count >>= 1
        after = after[after] if count else after
    return out


def _ahead(rows: np.ndarray, count: int, steps: list[tuple[int, np.ndarray]], after: np.ndarray) -> np.ndarray:
    """The rows ``count`` symbols on, by the longest steps that are known."""
    for size, step in reversed(steps):
        if size <= count:
            rows, count = step[rows], count - size
    for _ in range(count):
        rows = after[rows]
    return rows


NOTHING = Transform(np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def repeated_starts(strings: list[np.ndarray], length: int = LENGTH, shard_bytes: int = SHARD_BYTES, weights: np.ndarray | None = None) -> np.ndarray:
    """Whether the suffix at each place (strings end to end, each with one more place for its end) lies in an interval that shares ``length`` bytes and weighs more than one."""
    shards, own, size, offset = [], [], 0, 0
    for s in strings:
        own.append(s)
        size += len(s) + 1
        if size >= shard_bytes:
            shards.append(Transform.build(own, offset))
            offset, own, size = offset + size, [], 0
    if own:
        shards.append(Transform.build(own, offset))
        offset += size
    if not shards:
        return np.zeros(0, bool)
    shared = None
    while len(shards) > 1 or shared is None:
        pairs = [shards[i : i + 2] for i in range(0, len(shards), 2)]
        shards = []
        for pair in pairs:
            if len(pair) == 1 and len(pairs) > 1:
                shards += pair
            else:
                joined, shared = merge(pair[0], pair[1] if len(pair) > 1 else NOTHING, length)
                shards.append(joined)
    begins = np.flatnonzero(shared < length)
    heavy = np.ones(offset, np.int64) if weights is None else np.repeat(weights, [len(s) + 1 for s in strings])
    weighs = np.add.reduceat(heavy[shards[0].places], begins)
    many = np.zeros(offset, bool)
    many[shards[0].places] = np.repeat(weighs > 1, np.diff(np.append(begins, offset)))
    return many


ENTRY = "t1 long, t2 long, at int, windows int, key long, copies long, d1 long, d2 long"
ENTRY_NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def _bodies(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Cuts the wanted contexts out of each text; of equal texts in a task once."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        fresh = []
        for i, name in enumerate(names):
            if name not in seen:
                seen.add(name)
                fresh.append(i)
        batch = batch.take(pa.array(fresh, pa.int64())) if len(fresh) < len(batch) else batch
        raw, bounds = buffer_of(batch.column(2))
        rows, inside = _lists_of(batch.column(3))
        at, windows = (inside.field(k).to_numpy(zero_copy_only=False) for k in ("at", "windows"))
        begin = bounds[rows] + at
        end = begin + windows - 1 + length
        data = raw.tobytes()
        body = pa.array([data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(inside.field(k) for k in ENTRY_NAMES[2:]), body], [*ENTRY_NAMES, "body"])


def _merge_bucket(table: pa.Table, length: int) -> pa.Table:
    """Ranges of one bucket's contexts that lie in repeated intervals."""
    table = table.combine_chunks()
    once = np.unique(np.stack([table[k].to_numpy() for k in ("d1", "d2")]), axis=1, return_index=True)[1]
    table = table.take(pa.array(once))
    strings = [np.frombuffer(x, np.uint8) for x in table["body"].to_pylist()]
    many = repeated_starts(strings, length, weights=table["copies"].to_numpy())
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    places = np.cumsum(sizes) - sizes
    # Only places where a whole window begins count; the last ones of each string have none.
    inner = np.arange(len(many)) - np.repeat(places, sizes)
    flags = np.zeros(len(many) + 2, np.int8)
    flags[1:-1] = many & (inner < np.repeat(sizes - length, sizes))
    change = np.flatnonzero(flags[1:] != flags[:-1])
    begin, end = change[::2], change[1::2]
    owner = np.searchsorted(places, begin, side="right") - 1
    at = table["at"].to_numpy()[owner] + begin - places[owner]
    rows = pa.array(owner)
    known = {k: table[k].take(rows) for k in ("t1", "t2", "copies", "d1", "d2")}
    return pa.table(known | {"start": pa.array(at.astype(np.int32)), "end": pa.array((at + end - begin - 1 + length).astype(np.int32))})


def _frequent_ranges(batches: Iterator[pa.RecordBatch], first: np.ndarray, second: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """Ranges of runs that are among the frequent ones (digests in order of the first), those that touch in one text together."""
    for batch in batches:
        d1, d2 = batch.column(4).to_numpy(), batch.column(5).to_numpy()
        place = np.minimum(np.searchsorted(first, d1), len(first) - 1)
        some = np.flatnonzero((first[place] == d1) & (second[place] == d2))
        if not len(some):
            continue
        t1, t2, at, windows = (batch.column(i).to_numpy()[some] for i in range(4))
        end = at + windows - 1 + length
        fresh = np.ones(len(some), bool)
        fresh[1:] = (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1]) | (at[1:] > end[:-1]) | (at[1:] <= at[:-1])
        begins = np.flatnonzero(fresh)
        ends = np.append(begins[1:], len(some)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t1[begins], t2[begins], at[begins], end[ends].astype(np.int32))], ["t1", "t2", "start", "end"])


RANGES = "t1 long, t2 long, start int, end int"


def _with_lists(texts: DataFrame, runs: DataFrame, stash: Stash, name: str, *fields: str) -> DataFrame:
    """Texts that own some of the runs, with the list of them; a text's length bounds its list.

    The lists are written, so that the join is a plain one and Spark can split the copies of
    a very common text.
    """
    lists = stash.put(name, runs.groupBy("t1", "t2").agg(F.collect_list(F.struct(*fields)).alias("wanted")))
    return likely_among(texts, lists, "t1").join(lists, ["t1", "t2"]).select("t1", "t2", "text", "wanted")


def _runs(texts: DataFrame, stash: Stash, length: int) -> tuple[DataFrame, DataFrame]:
    """Runs of windows, and distinct ones with copies and one of their places. No key has more than HOT_CONTEXTS distinct runs.

    Those of a key with more are cut finer by half of the window's bytes that it doesn't stand
    for yet, until it stands for all of them; so a few rounds are enough whatever the texts.
    What was cut stays among the runs but not among the distinct ones, so nothing is said of it.
    """
    now, runs, kept = stash.put("runs-0", texts.mapInArrow(lambda b: _context_rows(b, length), RUN)), [], []
    while True:
        level = len(runs)
        runs.append(now)
        one = F.min(F.struct("t1", "t2", "at")).alias("one")
        distinct = stash.put(f"distinct-{level}", now.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("key"), F.min("windows").alias("windows"), one))
        hot = stash.put(f"hot-{level}", distinct.groupBy("key").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") > HOT_CONTEXTS).select("key"))
        if hot.isEmpty():
            return reduce(DataFrame.union, runs), reduce(DataFrame.union, [*kept, distinct])
        hot = broadcast_if_small(hot)
        kept.append(distinct.join(hot, "key", "left_anti").select(*distinct.columns))
        coarse = now.join(hot, "key", "left_semi").distinct()
        finer = _with_lists(texts, coarse, stash, f"coarse-{level}", "at", "windows", "inset", "before", "after").mapInArrow(lambda b: _finer_rows(b, length), RUN)
        now = stash.put(f"runs-{level + 1}", finer)


def repeated_ranges(texts: DataFrame, stash: Stash, length: int = LENGTH) -> DataFrame:
    """Distinct byte ranges that repeated strings cover, by the two hashes t1 and t2 of a text; ranges may overlap."""
    spark = texts.sparkSession
    runs, distinct = _runs(texts, stash, length)
    again = distinct.groupBy("key").agg(F.sum("copies").alias("seen")).where("seen > 1").select("key")
    open_ = stash.put("open", distinct.join(again, "key").select("one.*", *ENTRY_NAMES[3:]))
    stash.drop(*(f"{name}-{i}" for name in ("distinct", "hot", "coarse") for i in range(10)))
    bodies = _with_lists(texts, open_, stash, "wanted", *ENTRY_NAMES[2:]).mapInArrow(lambda b: _bodies(b, length), f"{ENTRY}, body binary")
    buckets = max(1, -(-open_.count() // BUCKET_CONTEXTS))
    merged = stash.put("merged", (
        bodies.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
        .groupBy("bucket").applyInArrow(lambda t: _merge_bucket(t, length), f"{RANGES}, copies long, d1 long, d2 long")
    ))
    stash.drop("open", "wanted")
    # What holds for an entry holds for all its copies. Those that are more than one run in FREQUENT are fewer than that.
    ranges = [merged.where("copies = 1").select("t1", "t2", "start", "end")]
    copied = stash.put("copied", merged.where("copies > 1").select("d1", "d2", "copies").distinct())
    often = copied.where(F.col("copies") > runs.count() / FREQUENT).select("d1", "d2").toPandas().sort_values("d1")
    rest = runs.select("t1", "t2", "at", "windows", "d1", "d2")
    if len(often):
        first, second = often["d1"].to_numpy(), often["d2"].to_numpy()
        python_ready(spark, 20_000)
        ranges.append(stash.put("frequent", rest.mapInArrow(lambda b: _frequent_ranges(b, first, second, length), RANGES)))
        python_ready(spark, 500)
        known = F.broadcast(spark.createDataFrame(often, "d1 long, d2 long"))
        rest, copied = (x.join(known, ["d1", "d2"], "left_anti") for x in (rest, copied))
    found = rest.join(copied.select("d1", "d2"), ["d1", "d2"]).select("t1", "t2", F.col("at").alias("start"), (F.col("at") + F.col("windows") - 1 + length).alias("end"))
    ranges.append(stash.put("rest", found))
    stash.drop("copied", *(f"runs-{i}" for i in range(10)))
    return reduce(DataFrame.union, ranges)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the ranges out of every text."""
    for batch in batches:
        raw, bounds = buffer_of(batch.column(1))
        ranges = batch.column(2)
        sizes = np.nan_to_num(ranges.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        inside = ranges.flatten()
        start, end = (inside.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end"))
        n_removed, n_spans, sha, texts, at = [], [], [], [], 0
        for i, n in enumerate(sizes.tolist()):
            text = raw[bounds[i] : bounds[i + 1]]
            spans = 0
            if n:
                depth = np.zeros(len(text) + 1, np.int32)
                np.add.at(depth, start[at : at + n], 1)
                np.add.at(depth, end[at : at + n], -1)
                gone = np.cumsum(depth[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                left = text[~gone]
            else:
                left = text
            at += n
            data = left.tobytes()
            n_removed.append(len(text) - len(left))
            n_spans.append(spans)
            sha.append(hashlib.sha256(data).hexdigest())
            texts.append(data.decode("utf-8", "ignore") if spans else None)
        new = [np.diff(bounds), np.array(n_removed, np.int64), np.array(n_spans, np.int64)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *map(pa.array, new), pa.array(sha, pa.string()), pa.array(texts, pa.string())],
            ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "left"],
        )


def remove_repeats(docs: DataFrame, keep: list[str], stash: Stash, length: int = LENGTH) -> DataFrame:
    """One row for each document: ``row`` (a struct of the kept columns), n_bytes, n_removed, n_spans, kept_sha256 and ``left``.

    ``left`` is the new text where something was removed (bytes of a cut character go too),
    else null. A null text counts as empty. Repeated rows repeat each other's strings, so
    both lose them; equal texts are one entry on the way. Ids are not looked at, so null or
    repeated ones are kept. Texts shorter than ``length`` bytes and empty tables lose
    nothing. Kept columns may have any names.
    """
    python_ready(docs.sparkSession, 500)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashes = F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")
    ranges = repeated_ranges(docs.select(*hashes, text.alias("text")).where(F.octet_length("text") >= length), stash, length)
    # Equal texts have equal ranges: a set of them, folded before it is shuffled, is bounded by the text.
    lists = stash.put("lists", ranges.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias("ranges")))
    stash.drop("merged", "frequent", "rest")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), text.alias("whole"), *hashes)
    joined = whole.join(lists, ["t1", "t2"], "left").select("row", "whole", "ranges")
    kinds = T.StructType([joined.schema["row"]])
    for name in ("n_bytes", "n_removed", "n_spans"):
        kinds.add(name, "long")
    return joined.mapInArrow(_cut, kinds.add("kept_sha256", "string").add("left", "string"))


def without_repeats(docs: DataFrame, stash: Stash, length: int = LENGTH) -> DataFrame:
    """The documents with repeated strings removed from text and n_chars set anew; all rows and columns stay."""
    cut = remove_repeats(docs, docs.columns, stash, length)
    changed = {"text": F.coalesce("left", "row.text"), "n_chars": F.when(F.col("left").isNotNull(), F.length("left").cast("long")).otherwise(F.col("row.n_chars"))}
    return cut.select(*(changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op2_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses when bytes under repeated strings of 200 bytes go."""
    cut = remove_repeats(load(spark, sf_dir, "documents"), ["doc_id"], Stash(spark, "op2"))
    return cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
