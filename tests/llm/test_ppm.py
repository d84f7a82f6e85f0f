"""Prediction by partial matching against a trie in plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from stallkeeper.llm import ppm
from stallkeeper.llm.tables import Stash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def symbols(text):
    return [ppm.BEFORE] * ppm.ORDER + list((text or "").encode().translate(LOWER)) + [ppm.END]


def learn(texts):
    trie = defaultdict(Counter)
    for text in texts:
        s = symbols(text)
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                trie[tuple(s[i - k : i])][s[i]] += 1
    return trie


def chance(trie, context, symbol):
    """The probability of a symbol, with the symbols of longer contexts left out of shorter ones."""
    seen, p = set(), 1.0
    for k in range(len(context), -1, -1):
        node = trie.get(tuple(context[len(context) - k :]), {})
        fresh = {s: c for s, c in node.items() if s not in seen}
        if not fresh:
            continue
        total = sum(fresh.values())
        if symbol in fresh:
            return p * (fresh[symbol] / total if len(node) == ppm.SYMBOLS else (2 * fresh[symbol] - 1) / (2 * total))
        p *= len(fresh) / (2 * total)
        seen |= fresh.keys()
    return p / (ppm.SYMBOLS - len(seen))


def brute(rows):
    """Rows (doc_id, held out, text) scored."""
    train = [t for _, out, t in rows if not out]
    trie, tokens = learn(train), [[*(t or "").encode().translate(LOWER).split(), None] for t in train]
    counts = Counter(w for ws in tokens for w in ws)
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc_id, held, text in rows:
        s = symbols(text)
        own = [*(text or "").encode().translate(LOWER).split(), None]
        score = sum(math.log10(chance(trie, s[i - ppm.ORDER : i], s[i])) for i in range(ppm.ORDER, len(s)))
        out.append((doc_id, bool(held), len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), score))
    return out


def same(got, want):
    order = lambda r: (repr(r[0]), r[2], r[6])
    got, want = sorted((tuple(r) for r in got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, out boolean, text string, key int, kind string")


def random_text(draw):
    return "".join(draw.choice(["the ", "cat ", "Sat", "on", " ", "a", "bb", "É", "\n", "日", "x" * 9]) for _ in range(draw.randint(0, 60)))


ROWS = [(i, i % 4 == 0, random_text(random.Random(i))) for i in range(60)]
ROWS += [(70, None, None), (71, True, None), (72, True, "never seen ZZZ ~~~"), (72, True, "never seen ZZZ ~~~"), (None, False, "no id"), (73, False, ""), (74, False, "  \x0b "), (75, True, "\x00\x01")]


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ppm, "TOGETHER", 50)
    monkeypatch.setattr(ppm, "PART_BYTES", 1000)
    docs = frame(spark, ROWS).repartition(3)
    same(ppm.score(docs, F.col("out"), Stash(spark, "t")).collect(), brute(ROWS))


def test_chunks_end_and_begin_anew(monkeypatch):
    """What the chunks of a task ask for adds up to the whole, each asks for what is in its own texts, and parts answer in order."""
    monkeypatch.setattr(ppm, "CHUNK", 200)
    monkeypatch.setattr(ppm, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)}))}))
    texts, held = [t or "" for _, _, t in ROWS], [bool(h) for _, h, _ in ROWS]
    table = pa.table({"doc_id": pa.array([d for d, _, _ in ROWS], pa.int64()), "held_out": held, "text": texts})
    rows = pa.Table.from_batches(list(ppm._dealt(iter(table.to_batches(max_chunksize=4)), 3)))
    asked = [r for r in rows.to_pylist() if r["kind"] == ppm.KEYS]
    stored = [(r["chunk"], t) for r in rows.to_pylist() if r["kind"] == ppm.TEXT for t in pa.ipc.open_stream(r["a"]).read_all()["text"].to_pylist()]
    assert [t for _, t in stored] == texts and len({c for c, _ in stored}) > 5 and {r["part"] for r in asked} == {0, 1, 2}
    keys = lambda t: [*ppm.windows(*one(t)).tolist(), *ppm.word_keys(*one(t))[0].tolist()]
    for chunk in {c for c, _ in stored}:
        own = [ppm.keys_of(r["a"], r["n"]).tolist() for r in asked if r["chunk"] == chunk]
        assert sorted(sum(own, [])) == sorted({k for c, t in stored if c == chunk for k in keys(t)}) and all(x == sorted(x) for x in own)
    want = Counter(k for t, h in zip(texts, held, strict=True) if not h for k in keys(t))
    for part in range(3):
        mine = rows.filter((pa.compute.field("kind") == ppm.KEYS) & (pa.compute.field("part") == part))
        counted = ppm._counted(mine)
        got = dict(zip(counted["key"].to_pylist(), counted["n"].to_pylist(), strict=True))
        assert all(want[k] == n for k, n in got.items())
        answers = ppm._answered(mine, pa.table({"key": counted["key"], "value": counted["n"].cast(pa.float64())})).to_pylist()
        assert all(ppm.unpacked(r["b"], r["n"], np.float64).tolist() == [got[k] for k in ppm.keys_of(r["a"], r["n"]).tolist()] for r in answers)
    tokens = sum(r["n"] for r in rows.to_pylist() if r["kind"] == ppm.PAIR and r["part"] == ppm.TOKENS)
    assert tokens == sum(len((t or "").split()) + 1 for _, h, t in ROWS if not h)


def one(text):
    (_, _, data, bounds), = ppm.blocks(pa.array([text]))
    return data, bounds


def test_no_text_to_learn_from(spark):
    rows = [(1, True, "abc"), (2, True, "")]
    got = ppm.score(frame(spark, rows), F.col("out"), Stash(spark, "t")).collect()
    same(got, brute(rows))
    assert [round(r["score"], 9) for r in sorted(got)] == [round(-k * math.log10(257), 9) for k in (4, 1)]
    assert ppm.score(frame(spark, rows).limit(0), F.col("out"), Stash(spark, "t")).count() == 0


@pytest.mark.parametrize("letters", [3, 257])
def test_probabilities_add_up(letters):
    """Over all symbols after any context; also where all symbols have been seen."""
    draw = random.Random(letters)
    texts = np.array([draw.randrange(letters) for _ in range(4000)], np.int64)
    train, counts = np.unique(sum(texts[j : len(texts) - ppm.ORDER + j] << ppm.BITS * (ppm.ORDER - j) for j in range(ppm.ORDER + 1)), return_counts=True)
    low = np.zeros((258, 257), np.int64)
    np.add.at(low, (train >> 9 & 511, train & 511), counts)
    for context in (train[0] >> 9, (7 << 36) | (train[5] >> 9 & (1 << 36) - 1), (7 << 36) | (9 << 27) | (train[9] >> 9 & (1 << 27) - 1)):
        asked = (np.int64(context) << 9) | np.arange(257)
        # All windows of one pair belong together.
        pair = train[(train >> 9 & (1 << 18) - 1) == (context & (1 << 18) - 1)]
        keys = np.union1d(asked, pair)
        n = np.where(np.isin(keys, train), counts[np.searchsorted(train, keys).clip(max=len(train) - 1)], 0)
        assert math.isclose((10 ** ppm.log_probabilities(keys, n, low)[np.isin(keys, asked)]).sum(), 1, rel_tol=1e-9)


def test_adaptive(spark):
    """What a text costs under a trie of what came before it, by the same rule; repeats cost little."""
    text = b"abracadabra abracadabra"
    trie, bits = defaultdict(Counter), 0.0
    for i, s in enumerate([*text, ppm.END]):
        contexts = [tuple(text[i - k : i]) for k in range(min(i, ppm.ORDER) + 1)]
        bits -= math.log2(chance(trie, contexts[-1], s))
        for c in contexts:
            trie[c][s] += 1
    assert math.isclose(ppm.adaptive_bits(text), bits)
    rows = {r["doc_id"]: r["bits"] for r in ppm.adaptive(spark.createDataFrame([(1, "Ab" * 200), (2, None), (3, "abcd" * 100)], "doc_id long, text string")).collect()}
    assert rows[2] == math.log2(257) and rows[1] < 100 and rows[1] < rows[3]


def test_held_out_texts_beat_their_letters_backwards(spark):
    """Held-out accuracy on the small table: the same letters from the end are less likely."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    both = docs.withColumn("out", held).union(docs.where(held).select(F.col("doc_id") + 1_000_000, F.reverse("text"), F.lit(True)))
    got = {r["doc_id"]: r for r in ppm.score(both, F.col("out"), Stash(spark, "t")).where("held_out AND n_tokens > 50").collect()}
    assert len(got) > 40 and all(r["score"] < 0 and r["n_known"] <= r["n_tokens"] for r in got.values())
    pairs = [(got[d]["score"], got[d + 1_000_000]["score"]) for d in got if d < 1_000_000]
    assert sum(a > b for a, b in pairs) > 0.95 * len(pairs)


def test_windows():
    data, bounds = np.frombuffer(b"abc", np.uint8), np.array([0, 2, 2, 3])
    want = []
    for t in ("ab", "", "c"):
        s = symbols(t)
        want += [sum(x << 9 * (ppm.ORDER - j) for j, x in enumerate(s[i - ppm.ORDER : i + 1])) for i in range(ppm.ORDER, len(s))]
    assert ppm.windows(data, bounds).tolist() == want
