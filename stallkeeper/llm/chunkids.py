"""Encoding whole texts through their distinct chunks, a column batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks, and characters of them, that one task remembers by default; past either the memory starts anew, which changes no result.
REMEMBERED, REMEMBERED_CHARS = 600_000, 16 << 20


class ChunkMemory:
    """Remembers for each distinct chunk a row number and its ids.

    ``encode`` turns a list of new chunks into a list of id sequences, and must give for each
    chunk what it has inside any text.
    """

    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], note: Callable[[str, Sequence[int]], object] | None = None, remember: int = REMEMBERED):
        self.encode, self.note, self.remember = encode, note, remember
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = self.chars = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.notes: list = []

    def _add(self, chunks: list[str]) -> None:
        found = self.encode(chunks)
        self.chars += sum(map(len, chunks))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first, total = len(self.rows), int(sizes.sum())
        self.rows.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        while first + len(chunks) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.sizes[first : first + len(chunks)] = sizes
        self.starts[first : first + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        if self.note:
            self.notes += map(self.note, chunks, found)

    def look_up(self, chunks: pa.Array) -> np.ndarray:
        """The row of every chunk of a flat string array."""
        coded = chunks.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.rows) > self.remember or self.chars > REMEMBERED_CHARS:
            self._clear()
        if new := [x for x in names if x not in self.rows]:
            self._add(new)
        rows = self.rows
        own = np.fromiter((rows[x] for x in names), np.int64, len(names))
        return own[coded.indices.to_numpy(zero_copy_only=False)]

    def sizes_of(self, chunks: pa.Array) -> np.ndarray:
        """The number of ids of every chunk of a flat string array."""
        rows = self.look_up(chunks)  # may put a larger array in place of self.sizes
        return self.sizes[rows]

    def ids(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the chunks in ``rows``, end to end."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[rows] - ends + sizes, sizes)]


def split_lists(texts: pa.Array, separator: str) -> tuple[pa.Array, np.ndarray]:
    """All parts end to end, and where each text's parts begin (one more entry than texts)."""
    lists = pc.split_pattern(texts, separator)
    return lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
