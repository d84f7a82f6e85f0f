"""Repeated strings and near-duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stallkeeper.llm import bwt_dedup, near_dup
from stallkeeper.llm.tables import Stash


@pytest.mark.parametrize("shard_bytes", [1, 60, 300, 10**6])
def test_merged_transforms_find_all_repeats(shard_bytes):
    draw = random.Random(shard_bytes)
    for length in (3, 7, 8, 14, 20, 33):
        texts = []
        for _ in range(25):
            x = bytes(draw.choice(b"ab\x00\xff") for _ in range(draw.randint(0, 60)))
            if texts and draw.random() < 0.5:
                y = draw.choice(texts)
                at = draw.randint(0, len(y))
                x = x[: draw.randint(0, 20)] + y[at : at + 40]
            texts.append(x)
        got = bwt_dedup.repeated_starts([np.frombuffer(t, np.uint8) for t in texts], length, shard_bytes)
        often = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        place = 0
        for t in texts:
            for i in range(len(t) - length + 1):
                assert got[place + i] == (often[t[i : i + length]] > 1)
            place += len(t) + 1


def test_merging_gives_the_transform_of_both():
    texts = [np.frombuffer(t, np.uint8) for t in (b"banana", b"bandana", b"", b"ananas")]
    a, b = bwt_dedup.Transform.build(texts[:2], 0), bwt_dedup.Transform.build(texts[2:], 15)
    both = bwt_dedup.Transform.build(texts, 0)
    merged, shared = bwt_dedup.merge(a, b, 64)
    suffixes = sorted(t[i:].tobytes() + b"\0" for t in texts for i in range(len(t) + 1))
    common = [0] + [next((k for k in range(70) if x[k : k + 1] != y[k : k + 1] or x[k] == 0), 0) for x, y in zip(suffixes, suffixes[1:], strict=False)]
    for x, y, length, got in zip(suffixes[1:], suffixes[:-1], common[1:], shared.tolist()[1:], strict=True):
        assert got == (64 if x == y else length // 7 * 7)
    assert merged.symbols.tolist() == both.symbols.tolist() and merged.places.tolist() == both.places.tolist()


def removed(texts, length):
    often = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if often[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        yield len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeéß日") for _ in range(draw.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(70), prose(3)
    texts = [prose(draw.randint(0, 120)) for _ in range(30)]
    texts += [prose(20) + passage + prose(20) for _ in range(12)] + [passage, passage + passage, "", None, line * 60, "x" * 900]
    edited = texts[3] + prose(60)
    texts += [edited, edited, edited[:200] + "!" + edited[200:], None, texts[0]]
    return texts


@pytest.mark.parametrize("hot", [4000, 1])
def test_repeats_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(bwt_dedup, "HOT_CONTEXTS", hot)
    texts = corpus(3)
    rows = [(i if i % 9 else None, t, "en", "s", None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = bwt_dedup.remove_repeats(docs, ["doc_id", "text"], Stash(spark, "t")).collect()
    want = Counter((t, *w) for t, w in zip(texts, removed([(t or "").encode() for t in texts], 200), strict=True))
    assert Counter((r["row"]["text"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    cleaned = bwt_dedup.without_repeats(docs, Stash(spark, "t"))
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    assert bwt_dedup.remove_repeats(docs.limit(0), ["doc_id"], Stash(spark, "t")).count() == 0


@pytest.mark.parametrize("frequent", [20_000, 2])
def test_repeated_rows_and_clashing_names(spark, monkeypatch, frequent):
    monkeypatch.setattr(bwt_dedup, "FREQUENT", frequent)
    draw = random.Random(8)
    prose = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(n))
    twin, other = prose(150), prose(300)
    texts = [twin] * 1000 + [other, prose(20) + other[300:800] + twin[100:400], prose(90)]
    names = ["left", "ranges", "whole", "row", "n_bytes", "kept_sha256", "t1", "t2", "wanted", "d1", "at", "copies", "odd name.x"]
    rows = [(None, t, *["z"] * len(names)) for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    stash = Stash(spark, "t")
    got = bwt_dedup.remove_repeats(docs, docs.columns, stash).collect()
    want = Counter((t, *w) for t, w in zip(texts, removed([t.encode() for t in texts], 200), strict=True))
    assert Counter((r["row"]["text"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    lists = bwt_dedup.repeated_ranges(docs.selectExpr("1L AS t1", "xxhash64(text) AS t2", "text"), Stash(spark, "t")).distinct().groupBy("t2").count().collect()
    assert max(r["count"] for r in lists) <= 40  # bounded by the text, not by its copies
    cleaned = bwt_dedup.without_repeats(docs, Stash(spark, "t"))
    assert cleaned.columns == docs.columns and cleaned.where("`odd name.x` = 'z' AND left = 'z'").count() == len(rows)


def test_a_text_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "BLOCK", 1000)
    monkeypatch.setattr(bwt_dedup, "HOT_CONTEXTS", 6)
    draw = random.Random(5)
    unit = bytes(draw.choice(b"abcdefghij ") for _ in range(700)).decode()
    phrase = "a phrase that many passages share "
    texts = [unit + "".join(draw.choice("abcdefghij ") for _ in range(7000)) + unit[:450], "ab" * 4000]
    texts += ["".join(draw.choice("klmnop ") for _ in range(150)) + phrase + "".join(draw.choice("klmnop ") for _ in range(150)) for _ in range(60)]
    texts += [t[20:270] for t in texts[5:30]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["row"]["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in bwt_dedup.remove_repeats(docs, ["doc_id"], Stash(spark, "t")).collect()}
    assert got == dict(enumerate(removed([t.encode() for t in texts], 200)))


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def groups(rows):
    sets, parent = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_corpus(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(draw.randint(3, 90))]
        texts.append(" ".join(base))
        for _ in range(draw.randint(0, 6)):
            copy = list(base)
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if draw.random() < 0.3 else "\n".join(copy))
    texts += [" ".join(passage + [word() for _ in range(draw.randint(5, 40))]) for _ in range(25)]
    texts += ["", " ", None, "one", "ONE", "one two", "a b c d", "A b c d"]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, seed):
    rows = near_corpus(seed)
    got = {r["doc_id"]: r for r in near_dup.find_groups(spark.createDataFrame(rows, "doc_id long, text string"), Stash(spark, "t")).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == groups(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_duplicate_edge_cases(spark):
    text = "the same five words and more"
    rows = [(None, text), (7, text), (7, text), (3, text), (4, None), (7, "another text altogether, not alike")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n_shingles", "'y' AS kept")
    got = near_dup.find_groups(docs, Stash(spark, "t")).collect()
    assert len(got) == 6
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert {r["component_id"] for r in got if r["doc_id"] == 3} == {3}
    kept = near_dup.keep_first(docs, Stash(spark, "t"))
    # The text that only shares an id with a copy stays.
    assert kept.columns == docs.columns and sorted(kept.select("doc_id", "text").collect(), key=str) == sorted([(None, text), (3, text), (4, None), rows[5]], key=str)
    assert near_dup.find_groups(docs.limit(0), Stash(spark, "t")).count() == 0


def test_one_of_equal_rows_stays(spark):
    text, other = "these are seven words of a text", "a text of its own with other words in it"
    rows = [(5, text, "x"), (5, text, "x"), (5, text, "x"), (5, other, "x"), (9, text, "x"), (2, other + " too", "x"), (8, None, "x"), (8, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash string").selectExpr("*", "1 AS row", "2 AS _first")
    kept = near_dup.keep_first(docs, Stash(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(5, text), (2, other + " too"), (8, None), (8, None)], key=str)


def test_bit_tables_never_rule_out_a_similar_pair(spark):
    draw = random.Random(6)
    texts = []
    for n in (3, 8, 40, 400, 3000):
        base = [f"w{draw.randrange(10**6)}" for _ in range(n)]
        for changes in (0, 1, n // 60, n // 30, n // 10):
            copy = list(base)
            for at in draw.sample(range(n), changes if n > 1 else 0):
                copy[at] = f"v{draw.randrange(10**6)}"
            texts.append(" ".join(copy))
    table = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    rows = next(near_dup._sets(iter([table]))).to_pylist()
    sides = [(i, len(r["shingles"]), *(r[c] for c in near_dup.TABLE)) for i, r in enumerate(rows)]
    made = spark.createDataFrame(sides, "node long, n long, " + ", ".join(f"{c} long" for c in near_dup.TABLE))
    open_ = {(r[0], r[1]) for r in near_dup._side(made, "a_").crossJoin(near_dup._side(made, "b_")).where(near_dup._open("a_", "b_")).select("a_node", "b_node").collect()}
    sets = [set(r["shingles"]) for r in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if 100 * len(a & b) >= 75 * len(a | b):
                assert (i, j) in open_
    assert len(open_) < len(sets) ** 2 / 2


@pytest.mark.parametrize("small_graph", [200_000, 0])
def test_components_of_a_long_chain(spark, small_graph):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)] + [(200, 200 + i) for i in range(1, 40)], "u long, v long")
    got = {r["node"]: r["label"] for r in near_dup.components(links, Stash(spark, "t"), "c", small_graph).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100} | {200 + i: 200 for i in range(1, 40)}


def test_near_duplicates_among_very_long_texts(spark, monkeypatch):
    draw = random.Random(4)
    words = [f"w{draw.randrange(10**5)}" for _ in range(60_000)]
    copy = list(words)
    for at in draw.sample(range(len(copy)), 1500):
        copy[at] = "changed"
    monkeypatch.setattr(near_dup, "BLOCK", 100_000)  # each text is longer than a block
    docs = spark.createDataFrame([(7, " ".join(words)), (3, " ".join(copy)), (1, " ".join(words[:20_000]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.find_groups(docs, Stash(spark, "t")).collect()}
    assert got == {i: (len(shingle_set(" ".join(x))), c) for i, x, c in ((7, words, 3), (3, copy, 3), (1, words[:20_000], 1))}
