"""Encoders against their libraries, packing against its law."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stallkeeper.llm import packing, piece_bpe

TEXTS = [
    "", " ", "  ", "\n", " \n  a", "a b  c            d", "▁▁a ▁", "\x01 a\x01b", "<s> <unk> </s> <0x0A>", "日本語 テキスト 😀👍🏽", "naïve İstanbul ΣΑΣ ς é é ́a", "\t tab\r\n x",
    " " * 40 + "x" + " " * 17, " " * 10_000, "a" + " " * 30_001 + "b", "\x00a", "<|endoftext|> a<|startoftext|>b", "I'll don't they'RE 12345 ½ Ⅷ", "a　x y", "a" * 90, "=" * 30 + "-" * 20 + "word,.!? word'. word\".", "Straße ÀÉÎõü ÿ ª µ",
]


def random_texts(n, seed):
    draw = random.Random(seed)
    letters = list("abcdefghijklmnopqrstuvwxyz    ee tt  \n.,;:!?-_'\"0123456789ABCéèüñß日😀\t\x01▁=/\\{}()")
    return ["".join(draw.choice(letters) for _ in range(draw.randint(1, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return TEXTS + random_texts(1500, 4)


def test_pieces_equal_the_library(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_path())
    memory = piece_bpe.memory_of(piece_bpe.model_path())
    chunks, bounds = piece_bpe.chunks_of(pa.array(texts))
    rows = memory.look_up(chunks)
    ends = np.concatenate([[0], np.cumsum(memory.sizes[rows])])
    ids = memory.ids(rows)
    for i, text in enumerate(texts):
        own = ids[ends[bounds[i]] : ends[bounds[i + 1]]].tolist()
        assert own == library.encode(text), text
        assert "".join(memory.notes[r][1] for r in rows[bounds[i] : bounds[i + 1]]).removeprefix(" ") == library.decode(own)


def test_encode_rows(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_path())
    rows = [(1, "hello world"), (None, None), (1, "hello world"), (3, "")]
    got = piece_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), piece_bpe.model_path(), with_ids=True).collect()
    assert len(got) == 4
    for r in got:
        assert r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
        assert r["ids"] == library.encode(r["decoded"])
    assert piece_bpe.encode(spark.createDataFrame([], "doc_id long, text string"), piece_bpe.model_path()).count() == 0


def test_word_ids_equal_the_library(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path())
    ids, counts = packing.token_ids(pa.array([*texts, None]), packing.word_memory(packing.tokenizer_path()))
    at = 0
    for text, n in zip([*texts, ""], counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == library.encode(text, add_special_tokens=False).ids, text
        at += n


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 10_000])
def test_cut_is_binary(n):
    pieces = packing.cut(n)
    assert sum(pieces) == n and all(p & (p - 1) == 0 and p <= 2048 for p in pieces) and pieces == sorted(pieces, reverse=True)
    assert len(set(pieces) - {2048}) == len([p for p in pieces if p != 2048])


def test_pieces_hold_every_id_once(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path())
    texts = [None, "", "one", "some words, here. " * 900, "one", "Ünïcode 😀"]
    docs = spark.createDataFrame([(i if i != 4 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = packing.pack(docs, packing.tokenizer_path(), with_ids=True).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 for r in got)
    for i, text in enumerate(texts):
        own = sorted((r for r in got if r["doc_id"] == (i if i != 4 else None)), key=lambda r: r["start"])
        want = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert [x for r in own for x in r["ids"]] == want
        for r in own:
            part = want[r["start"] : r["start"] + r["length"]]
            assert r["ids"] == part and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r["doc_tokens"] == len(want) and 1 << r["bucket"] == r["length"]
    assert packing.pack(docs.limit(0), packing.tokenizer_path()).count() == 0


def test_buckets_are_folders_of_one_length(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words, here. " * 900), (2, "one"), (3, None)], "doc_id long, text string")
    packing.write_buckets(docs, packing.tokenizer_path(), f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {p.name for p in (tmp_path / "out").glob("bucket=*")} == {f"bucket={r['bucket']}" for r in rows}
    assert all(len(r["ids"]) == r["length"] == 1 << r["bucket"] for r in rows) and {r["doc_id"] for r in rows} == {1, 2, 3}


def test_memory_is_bounded_by_characters(monkeypatch):
    from stallkeeper.llm import chunkids

    monkeypatch.setattr(chunkids, "REMEMBERED_CHARS", 100)
    memory = chunkids.ChunkMemory(lambda chunks: [[len(x)] for x in chunks])
    for i in range(50):
        chunks = [f"{i}-{j}-{'x' * 30}" for j in range(5)]
        assert memory.ids(memory.look_up(pa.array(chunks))).tolist() == [len(x) for x in chunks]
        assert len(memory.rows) <= 10


def test_very_long_texts(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    draw = random.Random(9)
    text = " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(250_000)) + " " * 5000 + "end"
    docs = spark.createDataFrame([(1, text), (2, text[:50])], "doc_id long, text string")
    n = {r["doc_id"]: r["n_tokens"] for r in piece_bpe.encode(docs, piece_bpe.model_path()).collect()}
    assert n[1] == len(sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_path()).encode(text))
    own = Tokenizer.from_file(packing.tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert sum(r["length"] for r in packing.pack(docs, packing.tokenizer_path()).where("doc_id = 1").collect()) == len(own) + 1


def test_sizes_of_more_chunks_than_a_memory_begins_with():
    from stallkeeper.llm import chunkids

    memory = chunkids.ChunkMemory(lambda chunks: [[1] * (len(x) % 5) for x in chunks])
    chunks = [str(i) for i in range(40_000)]
    assert memory.sizes_of(pa.array(chunks)).tolist() == [len(x) % 5 for x in chunks]
