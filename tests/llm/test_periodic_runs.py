"""Runs of words against a search of all stretches and periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from stallkeeper.llm import periodic_runs as pr


def brute_runs(words):
    """Each period's maximal stretches, kept where no smaller period holds."""
    n, found = len(words), {}
    for q in range(1, n // pr.LEAST_PERIODS + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text):
    words = planted(doc_id, (text or "").encode().split()) if doc_id is not None else (text or "").encode().split()
    runs = brute_runs(words)
    dropped = {i for s, e, q in runs for i in range(s + q, e)}
    top = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    shown = (None,) * 4 if top is None else (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2])
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return doc_id, len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_least_overlap():
    assert pr.least_overlap() == 5 and pr.least_overlap(2, 2) == 1 and pr.least_overlap(10, 2) == 5


def random_words(draw):
    kind, letters = draw.random(), "ab" if draw.random() < 0.5 else "abcdefgh"
    if kind < 0.3:
        return [draw.choice(letters) for _ in range(draw.randint(0, 90))]
    out = []
    for _ in range(draw.randint(1, 6)):
        root = [draw.choice(letters) for _ in range(draw.randint(1, 9))]
        out += root * draw.randint(1, 9) + root[: draw.randint(0, len(root))] + [draw.choice("xyz") for _ in range(draw.randint(0, 3))]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    draw = random.Random(seed)
    for _ in range(150):
        words = random_words(draw)
        code = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.array([code[w] for w in words], np.int64)
        assert pr.find_runs(ids, pr.segments(ids)) == brute_runs(words), words


def test_hashes_that_agree_by_chance_change_nothing(monkeypatch):
    """With weak hashes all candidates pass the first test; words decide."""
    monkeypatch.setattr(pr._Extend, "hashes", lambda self, starts, sizes: np.zeros(len(starts), np.uint64))
    ids = np.array([0, 1] * 8 + [2, 3, 4, 5, 6, 7, 8], np.int64)
    assert all(r in brute_runs(ids.tolist()) for r in pr.find_runs(ids, np.array([[0, len(ids)]])))


def test_thue_morse_words_have_no_runs():
    ids = np.array([bin(i).count("1") & 1 for i in range(1 << 14)], np.int64)
    assert pr.find_runs(ids, pr.segments(ids)) == []


def test_rows_equal_brute_force(spark):
    draw = random.Random(5)
    texts = [" ".join(random_words(draw)) for _ in range(120)]
    texts += [None, "", "  \n ", "a a a a a a", "a a a a a", "x\ty\nx y x y x\x0by z", "é é é é é é é", "           ", "A a A a A a A a A a"]
    rows = [(i, t, "junk", None) for i, t in enumerate(texts)] + [(3, texts[3], None, 1), (None, "b b b b b b b b", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, top int")
    got = pr.collapse_runs(docs, pr.folded_tail)
    assert got.count() == len(rows)
    pr_query = sorted((tuple(r) for r in digests(got)), key=repr)
    assert pr_query == sorted((brute_row(r[0], r[1]) for r in rows), key=repr)
    assert pr.collapse_runs(docs.limit(0)).count() == 0


def digests(found):
    for r in found.collect():
        lines = "".join(f"{x['start']},{x['length']},{x['period']}\n" for x in r["runs"])
        top = r["top"]
        shown = (None,) * 4 if top is None else (top["start"], top["length"], top["period"], 1000 * top["length"] // top["period"])
        yield r["doc_id"], len(r["runs"]), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(r["collapsed"].encode()).hexdigest()


def test_query_equals_brute_force(spark):
    """The whole small table, but documents beyond 1,500 words, whose brute force is slow."""
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r) for r in pr.op13_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        if len((d["text"] or "").split()) <= 1500:
            assert got[d["doc_id"]] == brute_row(d["doc_id"], d["text"])


def test_a_very_long_text_is_quick():
    ids = np.zeros(1 << 19, np.int64)
    ids[1 << 18] = 1
    assert pr.find_runs(ids, pr.segments(ids)) == [(0, 1 << 18, 1), ((1 << 18) + 1, 1 << 19, 1)]
    ids = np.arange(1 << 20, dtype=np.int64) % 30_011
    assert pr.find_runs(ids, pr.segments(ids)) == [(0, 1 << 20, 30_011)]
