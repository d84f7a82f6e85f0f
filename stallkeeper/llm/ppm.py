"""Prediction by partial matching: log probabilities of texts under a trie of byte contexts.

The trie's nodes are contexts of up to five bytes with the counts of what follows them. A
byte (or the end of the text) is looked up under its longest context; where it doesn't follow
there, an escape leads to the context that is one byte shorter, without the bytes that the
longer one has already ruled out. Escapes are estimated by method D: half a count of each
distinct symbol goes to the escape.

The trie grows with the corpus, so no task holds it. Texts are dealt to chunks; a chunk has
each of its six-byte windows and words once, as keys. Keys are dealt to parts by hash, where
their counts over all chunks meet; the windows that end in the same two bytes of context then
have all their contexts in one place and get their probabilities there; and parts answer the
chunks that asked. Between chunks and parts keys go in compressed lists, sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Stash, load, python_ready
from .textkit import LOWER, Rolling, buffer_of, mix, word_bounds

#: Bytes of the longest context.
ORDER = 5
#: A text's end, and what stands before its beginning, as symbols after the bytes.
END, BEFORE = 256, 257
SYMBOLS, BITS = 257, 9
#: Bytes of text that make a chunk, that are looked at together, and that send their keys to one part; windows whose probabilities are made together.
CHUNK, BLOCK, PART_BYTES, TOGETHER = 32 << 20, 1 << 20, 64 << 20, 400_000
#: Kinds of rows: stored texts, keys with their counts, and counts of symbols after single symbols.
TEXT, KEYS, PAIR = 0, 1, 2
#: Words' keys lie above those of windows; a text's end is a word of its own, and the number of tokens a pair of its own.
WORDS, END_WORD, TOKENS, SEED = 1 << 61, 1 << 62, -1, 11
_held: dict = {}


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last text, lower-cased bytes and bounds of some texts at a time."""
    raw, bounds = buffer_of(texts)
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + BLOCK, side="right")) - 1)
        yield first, last, LOWER[raw[bounds[first] : bounds[last]]], bounds[first : last + 1] - bounds[first]
        first = last


def windows(data: np.ndarray, bounds: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte and each end of the texts the symbols before it and itself, nine bits each."""
    sizes, n = np.diff(bounds), len(bounds) - 1
    stream = np.full(len(data) + n * (order + 1), BEFORE, np.int64)
    stream[np.arange(len(data)) + np.repeat(np.arange(n) * (order + 1) + order, sizes)] = data
    stream[bounds[1:] + np.arange(1, n + 1) * (order + 1) - 1] = END
    keys = np.zeros(max(len(stream) - order, 0), np.int64)
    for j in range(order + 1):
        keys = (keys << BITS) | stream[j : len(stream) - order + j]
    return keys[stream[order:] != BEFORE]


def word_keys(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes with each text's end after its own, and where each text's tokens begin."""
    rolling = _held.setdefault("rolling", Rolling(SEED))
    starts, ends, of_text = word_bounds(data, bounds)
    words = mix(rolling.between(rolling.sums(data), starts, ends)) if len(starts) else np.zeros(0, np.uint64)
    keys = (words & np.uint64(WORDS - 1) | np.uint64(WORDS)).view(np.int64)
    return np.insert(keys, of_text[1:], END_WORD), of_text + np.arange(len(of_text))


def folded(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    keys = keys[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts[order], head) if len(head) else counts


def packed(values: np.ndarray) -> bytes:
    """Eight-byte numbers, compressed byte by byte of the number, as sorted keys hardly differ in their first ones."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).reshape(-1).view(kind)


def keys_of(data: bytes, n: int) -> np.ndarray:
    """Sorted keys from their packed differences."""
    return np.cumsum(unpacked(data, n, np.int64))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


class _Chunk:
    """Distinct keys of the texts so far, with their counts; those of held-out texts count nothing."""

    def __init__(self):
        self.bytes, self.tokens, self.loose = 0, 0, 0
        self.keys, self.counts = [], []
        self.pairs = np.zeros((SYMBOLS + 1) << BITS, np.int64)

    def add(self, keys: np.ndarray, weight: int) -> None:
        keys = np.sort(keys)
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys.append(keys[head])
        self.counts.append(np.diff(np.append(head, len(keys))) * weight)
        self.loose += len(head)
        if len(self.keys) > 1 and self.loose > max(1 << 21, 2 * len(self.keys[0])):
            self.keys, self.counts = ([x] for x in folded(self.keys, self.counts))
            self.loose = 0

    def rows(self, chunk: int, parts: int) -> Iterator[pa.RecordBatch]:
        """The chunk's keys for each part, and its share of the counts that all parts need."""
        keys, n = folded(self.keys, self.counts) if self.keys else (np.zeros(0, np.int64),) * 2
        part = part_of(keys, parts)
        order = np.argsort(part, kind="stable")
        sizes = np.bincount(part, minlength=parts)
        ends = np.cumsum(sizes)
        for p in np.flatnonzero(sizes).tolist():
            own = order[ends[p] - sizes[p] : ends[p]]
            yield _batch(KEYS, chunk, part=[p], n=[len(own)], a=[packed(np.diff(keys[own], prepend=0))], b=[packed(n[own])])
        pairs = np.flatnonzero(self.pairs)
        yield _batch(PAIR, chunk, part=np.append(pairs, TOKENS), n=np.append(self.pairs[pairs], self.tokens))


ROWS = [("kind", pa.int8()), ("chunk", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary())]


def _batch(kind: int, chunk: int, **columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    columns |= {"kind": np.full(size, kind, np.int8), "chunk": np.full(size, chunk)}
    return pa.RecordBatch.from_arrays([pa.array(columns[n], t) if n in columns else pa.nulls(size, t) for n, t in ROWS], [n for n, _ in ROWS])


def _stored(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _dealt(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The texts with their chunk, and each chunk's keys with their counts in texts to learn from."""
    number, chunk = TaskContext.get().partitionId() << 24, _Chunk()
    for batch in batches:
        yield _batch(TEXT, number, a=[_stored(batch)])
        held = np.array(batch.column(1).to_numpy(zero_copy_only=False), bool)
        for first, last, data, bounds in blocks(batch.column(2)):
            sizes = np.diff(bounds)
            for out in (False, True):  # texts to learn from, then the others
                mine = np.flatnonzero(held[first:last] == out)
                if not len(mine):
                    continue
                own = data[np.repeat(held[first:last] == out, sizes)] if len(mine) < last - first else data
                at = np.concatenate([[0], np.cumsum(sizes[mine])])
                windows_, words = windows(own, at), word_keys(own, at)[0]
                if not out:
                    chunk.pairs += np.bincount(windows_ & (1 << 2 * BITS) - 1, minlength=len(chunk.pairs))
                    chunk.tokens += len(words)
                for keys in (windows_, words):
                    chunk.add(keys, 0 if out else 1)
            chunk.bytes += len(data)
        if chunk.bytes >= CHUNK:
            yield from chunk.rows(number, parts)
            number, chunk = number + 1, _Chunk()
    yield from chunk.rows(number, parts)


def _counted(asked: pa.Table) -> pa.Table:
    """A part's keys with their counts over all chunks, folded as chunks come."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    loose: tuple[list, list] = ([], [])
    for n, a, b in zip(*(asked[c].to_pylist() for c in "nab"), strict=True):
        loose[0].append(keys_of(a, n))
        loose[1].append(unpacked(b, n, np.int64))
        if sum(map(len, loose[0])) > max(1 << 20, len(keys)):
            keys, counts = folded([keys, *loose[0]], [counts, *loose[1]])
            loose = ([], [])
    keys, counts = folded([keys, *loose[0]], [counts, *loose[1]])
    return pa.table({"part": np.full(len(keys), asked["part"][0].as_py()), "key": keys, "n": counts})


def _answered(asked: pa.Table, values: pa.Table) -> pa.Table:
    """What a part's keys are worth, for each chunk in the order in which it asked."""
    keys, value = values["key"].to_numpy(), values["value"].to_numpy()
    order = np.argsort(keys)
    keys, value = keys[order], value[order]
    found = [packed(value[np.searchsorted(keys, keys_of(a, n))]) for n, a in zip(asked["n"].to_pylist(), asked["a"].to_pylist(), strict=True)]
    return pa.table({"chunk": asked["chunk"], "n": asked["n"], "a": asked["a"], "b": pa.array(found, pa.binary())})


def log_probabilities(keys: np.ndarray, n: np.ndarray, low: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The log10 probability of each window's last symbol after the others.

    ``keys`` are distinct windows, all that there are for the last two symbols of their
    contexts; ``n`` how often each occurs in the texts to learn from, which may be never.
    ``low`` has the counts of symbols (columns) after single ones (rows).
    """
    symbol, last = keys & 511, keys >> BITS & 511
    none = low.sum(axis=0)
    count, total, distinct = {0: none[symbol], 1: low[last, symbol]}, {0: np.full(len(keys), none.sum()), 1: low.sum(axis=1)[last]}, {0: np.full(len(keys), (none > 0).sum()), 1: (low > 0).sum(axis=1)[last]}
    # Of the symbols that follow a context: how often they follow the one that is a symbol shorter.
    above = {1: ((low > 0) * none).sum(axis=1)[last]}
    for k in range(2, order + 1):
        nodes, one, node = np.unique(keys & (1 << BITS * (k + 1)) - 1, return_index=True, return_inverse=True)
        c = np.bincount(node, n, len(nodes))
        context = np.unique(nodes >> BITS, return_inverse=True)[1]
        spread = lambda x: np.bincount(context, x)[context][node]  # noqa: B023, E731
        count[k], total[k], distinct[k] = c[node], spread(c), spread(c > 0)
        above[k] = spread((c > 0) * count[k - 1][one])
    score, still = np.zeros(len(keys)), np.ones(len(keys), bool)
    nothing = np.zeros(len(keys))
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(order, -1, -1):
            left = total[k] - above.get(k + 1, nothing)
            fresh = distinct[k] - distinct.get(k + 1, nothing)
            asked = still & (left > 0)
            hit = asked & (count[k] > 0)
            # Where all symbols have been seen nothing is left to escape to.
            own = np.where(distinct[k] == SYMBOLS, count[k] / left, (2 * count[k] - 1) / (2 * left))
            score += np.where(hit, np.log10(own), np.where(asked, np.log10(fresh / (2 * left)), 0.0))
            still &= ~hit
        return score - np.where(still, np.log10(SYMBOLS - distinct[0]), 0.0)


def _summed(texts: pa.Table, answers: pa.Table, tokens: int, distinct: int) -> pa.Table:
    """A chunk's texts with their sums over tokens and windows."""
    answered = list(zip(*(answers[c].to_pylist() for c in "nab"), strict=True))
    known = pd.Index(np.concatenate([keys_of(a, n) for n, a, _ in answered]))
    value = np.concatenate([unpacked(b, n, np.float64) for n, _, b in answered])
    look = lambda keys: value[known.get_indexer(keys)]
    out = []
    for stored in texts["a"]:
        batch = pa.ipc.open_stream(stored.as_buffer()).read_next_batch()
        parts: list[tuple] = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2]
        for _, _, data, bounds in blocks(batch.column(2)):
            words, at = word_keys(data, bounds)
            c, score = look(words), look(windows(data, bounds))
            ends = bounds[:-1] + np.arange(len(bounds) - 1)  # each text has a window for its end
            base = np.log10((c + 1) / (tokens + distinct + 1))
            parts.append((np.diff(at), np.add.reduceat((c > 0).astype(np.int64), at[:-1]), np.add.reduceat(base, at[:-1]), np.add.reduceat(score, ends)))
        n, seen, base, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        out.append(pa.table({"doc_id": batch.column(0), "held_out": batch.column(1), "n_tokens": n, "n_known": seen, "train_tokens": np.full(len(n), tokens), "base_score": base, "score": score}))
    return pa.concat_tables(out)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out: Column, stash: Stash) -> DataFrame:
    """Every text's log10 probability under a model of the texts that are not held out, and under single words.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. A-Z are
    lower-cased first. ``score`` is the log10 probability of the text's bytes and its end.
    A null text is empty and scored as such; a null of ``held_out`` counts as false. Rows are
    scored one by one, repeated ones alike; other columns than doc_id and text aren't read.
    Where no text is learned from, all symbols are equally likely; an empty table gives no
    rows. Words are told apart by a 61-bit hash.
    """
    spark = stash.spark
    python_ready(spark)
    asked = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = size // PART_BYTES + 1
    rows = stash.put("rows", asked.mapInArrow(lambda batches: _dealt(batches, parts), "kind byte, chunk long, part long, n long, a binary, b binary"))
    texts, keys = (rows.where(F.col("kind") == kind).select("part", F.col("chunk").alias(name), "n", "a", "b") for kind, name in ((TEXT, "chunk"), (KEYS, "asker")))
    # Symbols after single symbols, and the number of tokens: 258 times 257 rows at most, whatever the corpus.
    pairs = {r["part"]: r["n"] for r in rows.where(F.col("kind") == PAIR).groupBy("part").agg(F.sum("n").alias("n")).collect()}
    tokens, low = pairs.pop(TOKENS, 0), np.zeros((SYMBOLS + 1, SYMBOLS), np.int64)
    for pair, n in pairs.items():
        low[pair >> BITS, pair & 511] = n

    counts = stash.put("counts", keys.groupBy("part").applyInArrow(_counted, "part long, key long, n long"))
    word = F.col("key") >= WORDS
    total = counts.agg(F.count_if(word & (F.col("n") > 0)).alias("distinct"), F.count_if(~word).alias("windows")).first()

    def scored(table: pa.Table) -> pa.Table:
        own = table["key"].to_numpy()
        return pa.table({"part": table["part"], "key": own, "value": log_probabilities(own, table["n"].to_numpy(), low)})

    # All windows of one pair lie together; an alphabet bounds them, not the corpus.
    pair = F.shiftright("key", BITS).bitwiseAND((1 << 2 * BITS) - 1)
    place = F.pmod(F.xxhash64(pair), F.lit(total["windows"] // TOGETHER + 1)).alias("place")
    of_windows = counts.where(~word).select("part", "key", "n", place).groupBy("place").applyInArrow(scored, "part long, key long, value double")
    values = stash.put("values", of_windows.union(counts.where(word).select("part", "key", F.col("n").cast("double"))))
    asking = keys.withColumnRenamed("part", "asked")
    answers = asking.groupBy("asked").cogroup(values.groupBy("part")).applyInArrow(lambda a, b: _answered(a.rename_columns(["part", "chunk", *"nab"]), b), "chunk long, n long, a binary, b binary")
    answers = answers.withColumnRenamed("chunk", "asker")
    distinct = total["distinct"]
    return texts.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(lambda a, b: _summed(a, b, tokens, distinct), SCORES)


def adaptive_bits(text: bytes, order: int = ORDER) -> float:
    """The code length of a text, end included, when the trie starts empty and learns each symbol after it is coded."""
    trie: dict[bytes, dict[int, int]] = {}
    bits = 0.0
    for i in range(len(text) + 1):
        symbol, seen = text[i] if i < len(text) else END, set()
        contexts = [text[i - k : i] for k in range(min(order, i), -1, -1)]
        for context in contexts:
            fresh = {s: c for s, c in trie.get(context, {}).items() if s not in seen}
            if not fresh:
                continue
            total = 2 * sum(fresh.values())
            if symbol in fresh:
                bits -= log2((2 * fresh[symbol] - (len(trie[context]) < SYMBOLS)) / total)
                break
            bits -= log2(len(fresh) / total)
            seen |= fresh.keys()
        else:
            bits += log2(SYMBOLS - len(seen))
        for context in contexts:
            node = trie.setdefault(context, {})
            node[symbol] = node.get(symbol, 0) + 1
    return bits


def adaptive(docs: DataFrame) -> DataFrame:
    """doc_id and the bits of each text under a model of itself alone; nulls and letters as in ``score``.

    Texts are coded symbol by symbol in Python, some microseconds a byte, each by itself.
    """
    python_ready(docs.sparkSession)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [adaptive_bits((x.as_py() or b"").lower()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.float64())], ["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(coded, "doc_id long, bits double")


def op11_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those whose id's checksum does not leave 2 when divided by 7."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score(load(spark, sf_dir, "documents"), held_out, Stash(spark, "op11"))
