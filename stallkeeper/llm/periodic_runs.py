"""Runs of words that repeat with a period, found exactly and collapsed to their first period.

A run overlaps its own copy one period on. So each of its words lies in a k-gram that occurs
again in the same document, where k is the least overlap that any run has. Words outside such
k-grams can't be in a run: they cut the document into segments, and Main and Lorentz's
divide and conquer looks at those that are left. At the middle of each block every period is
tried at once, by one comparison of two hashes on either side, as a run of four periods has a
square that begins or ends there. What passes is extended to its full length and confirmed
word by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import load, python_ready
from .textkit import Rolling, mix, shingles

#: A run's least length in words, and in periods.
LEAST_LENGTH, LEAST_PERIODS = 6, 4
SEED = 13
#: Words whose segments are searched together; a longer document is searched alone.
TOGETHER = 1 << 17
_held: dict = {}


def least_overlap(length: int = LEAST_LENGTH, periods: int = LEAST_PERIODS) -> int:
    """Words that any run shares at least with its copy one period on; longer periods share more than the first few."""
    return min(max(length, periods * q) - q for q in range(1, length + 1))


def segments(ids: np.ndarray) -> np.ndarray:
    """Starts and ends of the stretches all whose words lie in repeated k-grams, if a run fits in."""
    k = least_overlap()
    if len(ids) < LEAST_LENGTH:
        return np.zeros((0, 2), np.int64)
    grams = shingles(mix(ids), k)  # grams that hash alike only lengthen segments
    order = np.argsort(grams)
    again = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
    if not len(again):
        return np.zeros((0, 2), np.int64)
    at = np.unique(np.concatenate([order[again], order[again + 1]]))
    edges = np.zeros(len(ids) + 2, np.int64)
    edges[at + 1] += 1
    edges[at + k + 1] -= 1
    bounds = np.flatnonzero(np.diff(np.cumsum(edges) > 0)).reshape(-1, 2)
    return bounds[bounds[:, 1] - bounds[:, 0] >= LEAST_LENGTH]


class _Extend:
    """How far words of two places agree, by hashes of all their stretches."""

    def __init__(self, ids: np.ndarray):
        self.rolling = _held.setdefault("rolling", Rolling(SEED))
        self.rolling.grow(len(ids) + 1)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix(ids + SEED) * self.rolling.powers[: len(ids)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.rolling.between(self.sums, starts, starts + sizes)

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The greatest size, up to ``most``, of equal stretches that begin (or, ``back``, end) at x and y."""
        low, high = np.zeros_like(most), most.copy()
        while (todo := np.flatnonzero(low < high)).size:
            size = (low[todo] + high[todo] + 1) // 2
            shift = size if back else 0
            same = self.hashes(x[todo] - shift, size) == self.hashes(y[todo] - shift, size)
            low[todo] = np.where(same, size, low[todo])
            high[todo] = np.where(same, high[todo], size - 1)
        return low


def _candidates(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (start, end, period, begin of segment, end of segment) of all runs, some under multiples of their period too."""
    extend, found = _Extend(ids), []
    blocks = np.column_stack([bounds, bounds])  # start and end of the block, then of its segment
    while len(blocks):
        start, end = blocks[:, 0], blocks[:, 1]
        middle = (start + end) // 2
        for right in (True, False):
            # The run lies in the block, four periods long, two of them on one side of the middle.
            most = np.minimum((end - start) // LEAST_PERIODS, (end - middle if right else middle - start) // 2)
            own = np.repeat(np.arange(len(blocks)), most)
            period = np.arange(len(own)) - np.repeat(np.cumsum(most) - most, most) + 1
            first = middle[own] if right else middle[own] - 2 * period
            square = extend.hashes(first, period) == extend.hashes(first + period, period)
            own, period, x = own[square], period[square], first[square]
            if len(own):
                before = extend.common(x, x + period, x - blocks[own, 2], back=True)
                after = extend.common(x, x + period, blocks[own, 3] - x - period, back=False)
                begin, close = x - before, x + period + after
                long = close - begin >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * period)
                found.append(np.column_stack([begin, close, period, blocks[own, 2], blocks[own, 3]])[long])
        halves = np.concatenate([np.column_stack([start, middle, blocks[:, 2:]]), np.column_stack([middle, end, blocks[:, 2:]])])
        blocks = halves[halves[:, 1] - halves[:, 0] >= LEAST_LENGTH]
    return np.concatenate(found) if found else np.zeros((0, 5), np.int64)


def _confirmed(ids: np.ndarray, row: list[int]) -> tuple[int, int, int] | None:
    """The run around a candidate, by its words: as found unless two hashes were equal by chance."""
    start, end, period, first, last = row
    same = ids[first : last - period] == ids[first + period : last]
    if not same[start - first : end - period - first].all() or (start > first and same[start - first - 1]) or (end < last and same[end - period - first]):
        x = (start + end - period) // 2 - first
        if not same[x]:
            return None
        wrong = np.flatnonzero(~same)
        at = int(np.searchsorted(wrong, x))
        start = first + (int(wrong[at - 1]) + 1 if at else 0)
        end = first + period + (int(wrong[at]) if at < len(wrong) else len(same))
    return (start, end, period) if end - start >= max(LEAST_LENGTH, LEAST_PERIODS * period) else None


def find_runs(ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) inside the segments, by start and then period; words are equal if their ids are."""
    rows = np.unique(_candidates(ids, bounds), axis=0)
    if not len(rows):
        return []
    # Of one stretch the least period counts; its multiples are periods too, as the stretch is long enough for both.
    head = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
    least = np.repeat(rows[head, 2], np.diff(np.append(head, len(rows))))
    keep = rows[:, 2] % least != 0
    keep[head] = True
    found: dict[tuple[int, int], int] = {}
    for row in rows[keep].tolist():
        if run := _confirmed(ids, row):
            found[run[:2]] = min(run[2], found.get(run[:2], run[2]))
    return sorted(((s, e, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods, exactly; of equal ones the first, then that of the shorter period."""
    best = None
    for s, e, p in runs:
        if best is None or (e - s) * best[2] > (best[1] - best[0]) * p:
            best = s, e, p
    return best


RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
Order = Callable[[int | None, int], "np.ndarray | None"]


def _collapse(batches: Iterator[pa.RecordBatch], order: Order | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        group: list[tuple] = []
        size, first = 0, 0
        for i, doc_id in enumerate(ids):
            words = (batch.column(1)[i].as_py() or b"").split()  # exactly the six white bytes
            n = len(words)
            last = dict(zip(words, range(n), strict=True))
            codes = np.fromiter(map(last.__getitem__, words), np.int64, n)
            if order and (places := order(doc_id, n)) is not None:
                words, codes = [words[j] for j in places.tolist()], codes[places]
            group.append((words, codes, segments(codes)))
            size += n
            if size > TOGETHER or i == len(ids) - 1:
                yield _rows(batch.column(0).slice(first, len(group)), group)
                group, size, first = [], 0, i + 1


def _rows(doc_ids: pa.Array, group: list[tuple]) -> pa.RecordBatch:
    at = np.cumsum([0, *(len(g[0]) for g in group)])
    bounds = np.concatenate([g[2] + b for g, b in zip(group, at, strict=False)])
    found = iter(find_runs(np.concatenate([g[1] for g in group]), bounds) if len(bounds) else [])
    lists, tops, texts = [], [], []
    run = next(found, None)
    struct = lambda r, b: {"start": r[0] - b, "length": r[1] - r[0], "period": r[2]}
    for (words, _, _), b in zip(group, at.tolist(), strict=False):
        runs = []
        while run is not None and run[0] < b + len(words):
            runs.append(run)
            run = next(found, None)
        if runs:
            keep = np.ones(len(words), bool)
            for s, e, p in runs:
                keep[s + p - b : e - b] = False
            words = [words[j] for j in np.flatnonzero(keep).tolist()]
        top = strongest(runs)
        lists.append([struct(r, b) for r in runs])
        tops.append(struct(top, b) if top else None)
        texts.append(b" ".join(words))
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(lists, pa.list_(RUN)), pa.array(tops, RUN), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "top", "collapsed"])


def collapse_runs(docs: DataFrame, order: Order | None = None) -> DataFrame:
    """Every document's doc_id, runs, top and collapsed text.

    ``runs`` are all maximal runs (start, length, period; words are numbered from 0) by start
    and period, ``top`` the one with the most periods or null, ``collapsed`` the words but
    those that a run repeats, with one space between them. ``order`` gives the numbers of a
    document's words in the order in which they are read, or None to leave them, from doc_id
    and the number of words. A null text has no words. Rows are told apart by nothing, so
    repeated and null doc_ids keep a row each; columns other than doc_id and text aren't read.
    Nothing is shuffled. Time is n log n in the words of a surviving segment.
    """
    spark = docs.sparkSession
    python_ready(spark)
    schema = "doc_id long, runs array<struct<start:long,length:long,period:long>>, top struct<start:long,length:long,period:long>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(lambda batches: _collapse(batches, order), schema)


def folded_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """One document in ten, by the checksum of its id, has its tail made periodic; one without an id hasn't."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % period
    return places


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of runs of every document, its strongest one, and digests of all runs and of the collapsed text."""
    found = collapse_runs(load(spark, sf_dir, "documents"), folded_tail)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
