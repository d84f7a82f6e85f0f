"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document of n tokens is cut at the binary digits of n: as many pieces of the longest
length as fit, then one piece for each set bit of the rest, longest first. Each piece is a
sequence of its own; sequences of equal length share a bucket, so a batch drawn from one
bucket needs no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunkids import REMEMBERED, REMEMBERED_CHARS, ChunkMemory, split_lists
from .tables import load, python_ready

MAX_LENGTH = 2048
END_ID = 1
#: Marks that may follow a word and are no apostrophes.
MARKS = ".,!?;:*#$%&|"
_tokenizers: dict = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def word_memory(path: str) -> ChunkMemory:
    """A fresh memory of what chunks become; tasks don't hand theirs on, so that later stages find the room free.

    This tokenizer drops white space, so the ids of a text are those of its white-space-free chunks in turn.
    """
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    tokenizer, spelled = _tokenizers[path], byte_letters()

    def library(parts: list[str]) -> Iterator[tuple[int, ...]]:
        for part in parts:
            if part.isalpha() and part.islower() and max(part) < "Ā":
                # One run of letters that normalization leaves alone: the model's own part of the work.
                yield tuple([t.id for t in tokenizer.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(spelled))])
            else:
                yield tuple(tokenizer.encode(part, add_special_tokens=False).ids)

    known: dict[str, tuple[int, ...]] = {"": ()}
    chars = 0

    def encode(chunks: list[str]) -> list[tuple[int, ...]]:
        """A plain word with marks after it is cut before the marks, as the tokenizer does, so that few parts are new."""
        nonlocal chars
        if len(known) > REMEMBERED or chars > REMEMBERED_CHARS:
            known.clear()
            known[""], chars = (), 0
        split = []
        for x in chunks:
            core = x.rstrip(MARKS)
            plain = core.isalpha() and (core.isascii() or max(core) < "Ā")
            split.append((core.lower(), x[len(core) :]) if plain else (x, ""))
        if new := [x for x in dict.fromkeys(y for pair in split for y in pair) if x not in known]:
            known.update(zip(new, library(new), strict=True))
            chars += sum(map(len, new))
        return [known[a] + known[b] for a, b in split]

    return ChunkMemory(encode)


def count_of(texts: pa.Array, memory: ChunkMemory) -> np.ndarray:
    """The number of ids of each text, without an end id; none for a null."""
    chunks, bounds = split_lists(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
    return np.diff(np.concatenate([[0], np.cumsum(memory.sizes_of(chunks))])[bounds])


def token_ids(texts: pa.Array, memory: ChunkMemory) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, and each text's number of ids."""
    spaced = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
    chunks, bounds = split_lists(spaced, " ")
    rows = memory.look_up(chunks)
    total = np.concatenate([[0], np.cumsum(memory.sizes[rows])])
    return memory.ids(rows), np.diff(total[bounds])


def cut(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Piece lengths of a document of n tokens, longest first."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n & (1 << b)]


def pack(docs: DataFrame, path: str, longest: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and, if asked, ids.

    ``longest`` is a power of two. ``bucket`` is the binary logarithm of the length.
    ``sequence_id`` numbers the sequences of a task under its partition, so ids are unique.
    A null text is empty and gives one piece that holds the end id alone. Null or repeated
    doc_ids are kept as they are; each row is packed for itself. No rows give no pieces.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, memory = TaskContext.get().partitionId() << 40, word_memory(path)
        for batch in batches:
            ids, counts = token_ids(batch.column(1), memory)
            ends = np.cumsum(counts)
            # The end id follows every document's own.
            ids = np.insert(ids.astype("<u4"), ends, end_id)
            raw = memoryview(ids).cast("B")
            owner, start, length, crc, at = [], [], [], [], 0
            for i, n in enumerate((counts + 1).tolist()):
                first = at
                for size in cut(n, longest):
                    owner.append(i)
                    start.append(at - first)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                    at += size
            size = np.array(length, np.int64)
            columns = [
                batch.column(0).take(pa.array(owner, pa.int64())), start, size, crc, (counts + 1)[owner],
                sequence + np.arange(len(owner)), np.zeros(len(owner), np.int64), np.log2(np.maximum(size, 1)).astype(np.int32),
            ]
            sequence += len(owner)
            columns = [x if isinstance(x, pa.Array) else pa.array(x, pa.int32() if i == 7 else pa.int64()) for i, x in enumerate(columns)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [x.split()[0] for x in schema.split(", ")] + ["ids"] * with_ids
    python_ready(docs.sparkSession, 4000)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, schema + ", ids array<int>" * with_ids)


def write_buckets(docs: DataFrame, path: str, out: str, longest: int = MAX_LENGTH) -> None:
    """Writes the sequences with their ids, one folder for each length."""
    pack(docs, path, longest, with_ids=True).write.partitionBy("bucket").parquet(out)


def op10_pack_powers_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with sequences of at most 2048 tokens."""
    return pack(load(spark, sf_dir, "documents"), tokenizer_path())
