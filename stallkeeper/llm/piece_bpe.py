"""SentencePiece BPE through a prefix table, and the way back from ids to text.

In byte-pair encoding every prefix of a text has one encoding, and the last token of each
prefix determines all of it. The table stores that token for every prefix: an Aho-Corasick
automaton lists the pieces that end at a position, and the one is taken that may follow the
last token of the prefix before it. Two tokens may stand side by side if no merge across
their border comes before a merge inside either. The ids are then read off backwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunkids import ChunkMemory, split_lists
from .tables import load, python_ready

SPACE = "▁"
#: Between chunks; texts that hold it take the plain way.
CUT = "\x01"
NORMAL, BYTE = 1, 6
NEVER = 1 << 60
_models: dict[str, PieceBpe] = {}


class PieceBpe:
    """A model of merge type with byte fallback and no normalization but the dummy prefix and escaped spaces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("a BPE model with byte fallback, a dummy prefix and identity normalization is needed")
        self.pieces = [p.piece for p in proto.pieces]
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.id_byte = {i: bytes([b]) for b, i in self.byte_id.items()}
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == NORMAL]
        order = {s: r for r, s in enumerate(sorted({s for *_, s in normal}, reverse=True))}
        self.ids = {piece: i for i, piece, _ in normal}
        #: When a merge that makes the piece takes place; single characters are there from the start.
        self.when = {piece: order[score] for _, piece, score in normal if len(piece) > 1}
        for _, piece, _ in normal:
            if (SPACE in piece[1:] and piece.strip(SPACE)) or "\n" in piece:
                raise ValueError("a piece crosses the border of a word")
        self.parts: dict[str, tuple[str, str]] = {}
        self.may: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in sorted(self.ids, key=lambda x: (len(x), x)):
            if piece.strip(SPACE) or piece == SPACE:
                if len(piece) > 1:
                    whole = self._merge(list(piece))
                    if whole is None:
                        continue  # no text ever gives this piece
                    self.parts[piece] = whole
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()

    def _merge(self, symbols: list[str]) -> tuple[str, str] | None:
        """The two tokens of the last merge when the symbols become one token, else None. Only used for single pieces."""
        last = None
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: (self.when.get(symbols[i] + symbols[i + 1], NEVER), i))
            if symbols[best] + symbols[best + 1] not in self.when:
                return None
            last = (symbols[best], symbols[best + 1])
            symbols[best : best + 2] = [last[0] + last[1]]
        return last

    def _compatible(self, a: str, b: str) -> bool:
        """Whether the border between a and b outlasts all merges.

        Goes back in time: undoes the later of the two last merges and asks whether what then
        met at the border would have merged first. Of equal merges the left one comes first.
        """
        when, parts = self.when, self.parts
        if a + b in when:
            return False
        while True:
            in_a, in_b = (when[a] if a in parts else -1), (when[b] if b in parts else -1)
            if in_a < 0 and in_b < 0:
                return True
            if in_a > in_b:
                limit, a = in_a - 1, parts[a][1]
            else:
                limit, b = in_b, parts[b][0]
            if when.get(a + b, NEVER) <= limit:
                return False

    def _word(self, word: str) -> list[str]:
        """The tokens of a chunk with one space mark at most, at its start."""
        n = len(word)
        last: list[str | None] = [None] * (n + 1)
        last[0] = ""
        may = self.may
        ends: list[list[str]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(word):
            ends[end].append(piece)
        for end in range(1, n + 1):
            for piece in ends[end - 1]:
                before = last[end - len(piece)]
                if before == "":
                    last[end] = piece
                    break
                if before is None:
                    continue
                key = (before, piece)
                fits = may.get(key)
                if fits is None:
                    if len(may) > 300_000:
                        may.clear()
                    fits = may[key] = self._compatible(before, piece)
                if fits:
                    last[end] = piece
                    break
            else:
                last[end] = word[end - 1]  # not in the vocabulary: it never merges
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(out[-1])
        return out[::-1]

    def _spaces(self, n: int) -> list[str]:
        """A run of space marks: all its merges have one rank, so the leftmost that can go does.

        What lies left of a mark has settled before the mark can take part, so one pass is enough.
        """
        run: list[str] = []
        for _ in range(n):
            run.append(SPACE)
            while len(run) > 1 and run[-2] + run[-1] in self.when:
                run[-2:] = [run[-2] + run[-1]]
        return run

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a run of space marks followed by characters that are none."""
        word = chunk.lstrip(SPACE)
        marks = len(chunk) - len(word)
        tokens = self._word(SPACE * min(marks, 1) + word) if word else []
        if marks > 1 or not word:
            # Merges inside runs come last of all: by then the last mark may have joined the word.
            if word and tokens[0] == SPACE:
                tokens = self._spaces(marks) + tokens[1:]
            else:
                tokens = self._spaces(marks - bool(word)) + tokens
        ids: list[int] = []
        for token in tokens:
            if token in self.ids:
                ids.append(self.ids[token])
            else:
                ids += [self.byte_id[b] for b in token.encode()]
        return ids

    def decode_pieces(self, ids: list[int]) -> str:
        """Text of ids, with the dummy prefix's space if it is among them; runs of bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(self.id_byte[i] if i in self.id_byte else self.pieces[i].encode() for i in ids)
        return raw.decode("utf-8", "replace").replace(SPACE, " ")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def memory_of(path: str, notes: bool = True) -> ChunkMemory:
    """A fresh memory of what chunks become, with the texts of ids and decoding if asked; the model is read once a worker."""
    if path not in _models:
        _models[path] = PieceBpe(path)
    model = _models[path]
    return ChunkMemory(
        lambda chunks: [model.encode_chunk(x) for x in chunks],
        (lambda _, ids: (",".join(map(str, ids)), model.decode_pieces(ids))) if notes else None,
    )


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks that no merge crosses, end to end, and where each text's begin.

    A chunk begins at a run of spaces and at either side of a line feed, as no piece holds a
    space after another character, or a line feed. An empty text has no chunk.
    """
    odd = pc.or_(pc.match_substring_regex(texts, f"^ |  |{SPACE}|{CUT}"), pc.equal(texts, ""))
    marked = pc.replace_substring(pc.replace_substring(texts, " ", CUT + SPACE), "\n", f"{CUT}\n{CUT}")
    flat, bounds = split_lists(pc.binary_join_element_wise(pa.scalar(SPACE), marked, pa.scalar("")), CUT)
    if not pc.any(odd).as_py():
        return flat, bounds
    # Runs of spaces and the marks used here need a closer look.
    sizes, parts, done = np.diff(bounds), [], 0
    for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
        text = texts[i].as_py()
        own = re.findall(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n", SPACE + text.replace(" ", SPACE)) if text else []
        parts += [flat.slice(bounds[done], bounds[i] - bounds[done]), pa.array(own, flat.type)]
        sizes[i], done = len(own), i + 1
    parts.append(flat.slice(bounds[done]))
    return pa.concat_arrays(parts), np.concatenate([[0], np.cumsum(sizes)])


def count_of(texts: pa.Array, memory: ChunkMemory) -> np.ndarray:
    """The number of ids of each text; none for a null."""
    chunks, bounds = chunks_of(pc.fill_null(texts, ""))
    return np.diff(np.concatenate([[0], np.cumsum(memory.sizes_of(chunks))])[bounds])


def encode(docs: DataFrame, path: str, keep: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each document: the key, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids and decoded.

    Null texts are empty: no tokens, and the digests of an empty string. Repeated rows and
    null keys are kept. Texts are encoded whole, whatever their length.
    """
    kind = docs.schema[keep].dataType.simpleString()
    schema = f"`{keep}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = memory_of(path)
        for batch in batches:
            chunks, bounds = chunks_of(pc.fill_null(batch.column(1), ""))
            rows = memory.look_up(chunks)
            totals = np.concatenate([[0], np.cumsum(memory.sizes[rows])])
            notes = np.empty(len(memory.notes), object)
            notes[:] = memory.notes
            count, ids_sha, text_sha, texts = [], [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = notes[rows[a:b]].tolist()
                decoded = "".join([x[1] for x in own]).removeprefix(" ")
                count.append(int(totals[b] - totals[a]))
                ids_sha.append(hashlib.sha256(",".join([x[0] for x in own if x[0]]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                texts.append(decoded)
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                flat = pa.array(memory.ids(rows).astype(np.int32))
                columns += [pa.ListArray.from_arrays(pa.array(totals[bounds], pa.int32()), flat), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [keep, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    python_ready(docs.sparkSession, 4000)
    return docs.select(keep, F.col("text").cast("string")).mapInArrow(run, schema)


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and their decoding as digests."""
    return encode(load(spark, sf_dir, "documents"), model_path())
