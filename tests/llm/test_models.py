"""Resampling, neighbours, rollups and the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from stallkeeper.llm import multi_index, resampling, token_rollup
from stallkeeper.llm.tables import Stash, load


def test_walk_takes_cells_by_summed_distance():
    draw = np.random.default_rng(1)
    books = draw.normal(size=(5, 5)), draw.normal(size=(6, 5))
    sizes, query = draw.integers(0, 4, 30), draw.normal(size=8)
    one, two = multi_index.distances(query, books)
    order = np.argsort((one[:, None] + two[None, :]).ravel(), kind="stable")
    order = [c for c in order.tolist() if sizes[c]]
    for enough in (1, 10, 10_000):
        got = multi_index.walk(query, books, sizes, enough)
        assert got == order[: len(got)]
        assert sizes[got].sum() >= enough or len(got) == len(order)


def vectors(spark, n, seed=2, copies=0):
    draw = np.random.default_rng(seed)
    rows = [(i, draw.normal(size=8).round(3).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(copies)]
    rows += [(9000, None), (9001, [0.0] * 8), (9002, [float("nan")] + [1.0] * 7), (9003, [None] + [1.0] * 7), (9004, [1.0]), (None, [1.0] * 8), (9005, [float("inf")] + [1.0] * 7)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows


@pytest.mark.parametrize(("n", "copies"), [(600, 60), (5, 0), (2, 0)])
def test_search_reaches_its_recall(spark, n, copies):
    table, rows = vectors(spark, n, copies=copies)
    got = multi_index.search(table, F.col("vec_id") % 4 == 0, Stash(spark, "t"), k=5, dimension=8).collect()
    live = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows if i is not None and i < 9000}
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        assert r["score"] == pytest.approx(float(live[r["query_id"]] @ live[r["vec_id"]]), abs=1e-12)
        found.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    hits = total = 0
    for q in (i for i in live if i % 4 == 0):
        best = sorted(((-round(float(live[q] @ v), 9), i) for i, v in live.items() if i != q))[:5]
        own = found.get(q, [])
        assert own == sorted(own) and len(own) == len(best)
        hits, total = hits + len({i for _, i in own} & {i for _, i in best}), total + len(best)
    assert hits >= 0.9 * total


@pytest.mark.parametrize("kind", ["float", "double"])
def test_ties_among_distinct_vectors_go_to_the_smaller_id(spark, kind, monkeypatch):
    monkeypatch.setattr(multi_index, "_enough", lambda *_: 1 << 60)  # all cells
    draw = random.Random(3)
    # All have the same inner product with the query, as only its first component isn't 0.
    rows = [(0, [2.0] + [0.0] * 5)] + [(i, [0.1] + [draw.gauss(0, 1) for _ in range(5)]) for i in range(1, 191)]
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = multi_index.search(table, F.col("vec_id") == 0, Stash(spark, "t")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(1, 21))
    assert {r["score"] for r in got} == {2.0 * (0.1 if kind == "double" else float(np.float32(0.1)))}


@pytest.mark.parametrize("dimension", [1, 3, 32])
def test_the_dimension_comes_from_the_data(spark, dimension):
    draw = np.random.default_rng(dimension)
    rows = [(i, draw.normal(size=dimension).tolist()) for i in range(100)] + [(i, [1.0] * (dimension + 1)) for i in range(100, 130)]
    got = multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") < 10, Stash(spark, "t"), k=5, recall=1.0).collect()
    assert len(got) == 50 and all(r["vec_id"] < 100 for r in got)
    for r in got:
        own, other = rows[r["query_id"]][1], rows[r["vec_id"]][1]
        total = 0.0
        for x, y in zip(own, other, strict=True):
            total += x * y
        assert r["score"] == total


def test_search_of_nothing(spark):
    table, _ = vectors(spark, 0)
    assert multi_index.search(table.where("vec_id >= 9000"), F.lit(True), Stash(spark, "t"), dimension=8).count() == 0


def prose(draw, n, words):
    return " ".join(draw.choice(words) for _ in range(n))


def test_resampling_drops_bad_and_keeps_good(spark):
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(2500):
        toxic, junk = i % 10 == 3, i % 10 == 6
        text = prose(draw, draw.randint(20, 80), words)
        if toxic:
            text += " vile scum vile"
        if junk:
            text = " ".join(f"{w}***" for w in text.split())
        rows.append((i, text))
        if i % 2:
            labels.append((i, int(not junk), int(toxic)))
    rows += [(None, None), (None, ""), (1, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS kept")
    marks = spark.createDataFrame(labels + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = resampling.resample(docs, marks, Stash(spark, "t")).collect()
    assert len(got) == len(rows)
    bad = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 10 in (3, 6)]
    good = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 10 not in (3, 6)]
    assert sum(not r["kept"] for r in bad) >= 0.97 * len(bad)
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
    assert all(r["kept"] for r in got if r["doc_id"] is None)
    kept = resampling.keep_good(docs, marks, Stash(spark, "t"))
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert all(r["kept"] for r in resampling.resample(docs, marks.limit(0), Stash(spark, "t")).collect())
    assert resampling.resample(docs.limit(0), marks, Stash(spark, "t")).count() == 0


def by_hand(rows, labels):
    """Ratio, draw and verdict of every row in plain Python."""
    marks = {}
    for i, quality, toxic in labels:
        marks.setdefault(i, []).append((quality, toxic))
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def spark_hash(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64(v, seed=seed).intdigest()
        return signed(seed)

    def grams(text):
        words = [m.group().lower() for m in re.finditer(r"[a-zA-Z0-9]+|[^a-zA-Z0-9\s]+", text or "")]
        found = {("word", w) for w in words}
        for w, n in Counter(words).items():
            found |= {("often", w, k) for k in range(2, 12) if n >= 2**k}
        twice = sum(a == b for a, b in zip(words, words[1:], strict=False))
        return found | {("twice", k) for k in range(12) if twice >= 2**k}

    kinds = {}
    for i, own in marks.items():
        if all(q == 1 for q, _ in own) and not any(t for _, t in own):
            held = spark_hash((resampling.SEED).to_bytes(4, "little"), i.to_bytes(8, "little")) % resampling.HELD_OUT == 0
            kinds[i] = "held" if held else "good"
        else:
            kinds[i] = "bad"
    raw, good, bad, n = Counter(), Counter(), Counter(), Counter()
    for i, text in rows:
        n.update(["raw", kinds.get(i, "raw only")])
        for g in grams(text):
            raw[g] += 1
            good[g] += kinds.get(i) == "good"
            bad[g] += kinds.get(i) == "bad"

    def ratio(seen, target, share):
        odds = 1e-4 * math.exp(min(500, target * math.log(0.1) + (seen - target) * math.log((1 - 0.1 * share) / (1 - share))))
        return odds / (1 + odds) * min(0, math.log((target + 0.5) / (seen * share + 0.5)))

    of = lambda g: min(ratio(raw[g], good[g], n["good"] / n["raw"]), ratio(good[g] + bad[g], good[g], n["good"] / (n["good"] + n["bad"])))
    out = []
    for i, text in rows:
        weight = sum(round(of(g), 6) for g in grams(text))
        text_hash = spark_hash((text or "").encode())
        parts = [resampling.SEED.to_bytes(4, "little"), *([] if i is None else [i.to_bytes(8, "little")]), text_hash.to_bytes(8, "little", signed=True)]
        u = ((spark_hash(*parts) % (1 << 64) >> 11) + 0.5) / 2**53
        out.append([i, text_hash, weight, weight - math.log(-math.log(u)), kinds.get(i)])
    return out


@pytest.mark.parametrize("wanted", [None, 300])
def test_resampling_matches_brute_force(spark, wanted):
    draw = random.Random(12)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
    rows, labels = [], []
    for i in range(900):
        text = prose(draw, draw.randint(0, 40), words) + (" vile scum" if i % 10 == 3 else " ##" * 5 if i % 10 == 6 else " odd" if i % 40 == 8 else "")
        rows.append((i, text))
        if i % 2:
            labels.append((i, int(i % 10 != 6), int(i % 10 == 3)))
    rows += [(None, None), (None, ""), (1, rows[1][1])]
    labels += [(2, 1, 0), (2, 0, 0)]
    want = by_hand(rows, labels)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = resampling.resample(docs, marks, Stash(spark, "t"), wanted).collect()
    got, want = sorted(((r["doc_id"], r["text_hash"], r["log_ratio"], r["draw"], r["kept"]) for r in got), key=lambda x: (x[0] or -1, x[1])), sorted(want, key=lambda x: (x[0] or -1, x[1]))
    size = wanted
    if size is None:
        held = sorted(w[2] for w in want if w[4] == "held")
        reference = min(-2.0, held[max(0, math.ceil(0.005 * len(held)) - 1)])
        size = round(sum(math.exp(min(0, w[2] - reference)) for w in want))
    least = sorted((w[3] for w in want), reverse=True)[size - 1]
    for g, w in zip(got, want, strict=True):
        assert g[:2] == tuple(w[:2]) and g[2] == pytest.approx(w[2], abs=1e-4) and g[3] == pytest.approx(w[3], abs=1e-4)
        assert g[4] == (w[3] >= least) or abs(w[3] - least) < 1e-3
    # The draw decides: the kept ones are not just those with the largest ratios.
    cut = sorted((w[2] for w in want), reverse=True)[size - 1]
    assert wanted is None or any(g[4] and g[2] < cut for g in got)


@pytest.mark.parametrize(("table", "toxic_kept", "good_kept"), [("sf0.01", 0.05, 0.98), ("sf0.1", 0.05, 0.98)])
def test_resampling_drops_unseen_toxic_documents_of_small_inputs(spark, table, toxic_kept, good_kept):
    docs, labels = (load(spark, f"/root/testdata/{table}", name) for name in ("documents", "labels"))
    # One in four toxic documents with a word of abuse gives no label, so what is said of it comes from the others.
    unseen = (F.col("toxic") == 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    kept = resampling.resample(docs, labels.where(~unseen), Stash(spark, "t")).select("doc_id", "kept").join(labels, "doc_id").join(docs, "doc_id")
    abuse = F.col("text").rlike(r"(?i)\b(trash|idiot|scum|clown|moron|stupid|worthless|pathetic|disgusting|loser)\b")
    share = lambda rows: rows.agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert share(kept.where(unseen & abuse)) <= toxic_kept
    assert share(kept.where("quality = 1 AND toxic = 0")) >= good_kept


def weights_by_hand(rows, good):
    """Log importance weights in plain Python: multinomial models over words and pairs of neighbouring words, the target mixed with the raw one."""

    def grams(text):
        words = [m.group().lower() for m in re.finditer(r"[a-zA-Z0-9]+|[^a-zA-Z0-9\s]+", text or "")]
        return Counter([(w,) for w in words] + list(zip(words, words[1:], strict=False)))

    raw, target = Counter(), Counter()
    for i, text in rows:
        raw += grams(text)
        target += grams(text) if i in good else Counter()
    of = lambda g: math.log(0.1 * target[g] / target.total() + 0.9 * raw[g] / raw.total()) - math.log(raw[g] / raw.total())
    return [(i, grams(text).total(), sum(n * of(g) for g, n in grams(text).items())) for i, text in rows]


@pytest.mark.parametrize("wanted", [None, 60])
def test_importance_weights_match_brute_force(spark, wanted):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(9)]
    rows = [(i, prose(draw, draw.randint(0, 40), words) + (" ## %" if i % 5 == 3 else "")) for i in range(300)]
    labels = [(i, int(i % 5 != 3), 0) for i, _ in rows if i % 2] + [(1, 1, None), (5, 0, 0), (7, 1, 1), (None, 1, 0), (9000, 1, 0)]
    rows += [(None, None), (None, ""), (1, rows[1][1])]
    good = {i for i, quality, _ in labels if i is not None and quality} - {5, 7}
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = resampling.importance(docs, marks, Stash(spark, "t"), wanted).collect()
    order = lambda x: (x[0] or -1, x[1], x[2])
    found = sorted(((r["doc_id"], r["n_features"], r["log_ratio"]) for r in got), key=order)
    for g, w in zip(found, sorted(weights_by_hand(rows, good), key=order), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-4)
    assert min(g[2] for g in found) < 0 < max(g[2] for g in found)
    # 151 labelled ids, of which 119 are good.
    size = round(len(rows) * 119 / 151) if wanted is None else wanted
    least = sorted((r["draw"] for r in got), reverse=True)[size - 1]
    assert all(r["kept"] == (r["draw"] >= least) for r in got)
    cut = sorted((r["log_ratio"] for r in got), reverse=True)[size - 1]
    assert any(r["kept"] and r["log_ratio"] < cut for r in got)
    nothing = resampling.importance(docs, marks.limit(0), Stash(spark, "t"), wanted).collect()
    assert len(nothing) == len(rows) and all(r["kept"] and r["log_ratio"] == 0 for r in nothing)
    assert all(r["kept"] for r in resampling.importance(docs, marks, Stash(spark, "t"), 1000).collect())
    assert resampling.importance(docs.limit(0), marks, Stash(spark, "t"), wanted).count() == 0


def test_op3_weighs_pairs_of_neighbouring_words(spark, tmp_path):
    # Every text has the same words as often, so only their order tells good ones from others.
    good, other = "red cat sat on blue mat", "mat blue on sat cat red"
    rows = [(i, good if i % 2 else other) for i in range(40)] + [(40, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in resampling.op3_importance_resampling(spark, str(tmp_path)).collect()}
    # Words have a ratio of 0; the five pairs of good texts are twice as frequent in the target, the others aren't there.
    for i, text in rows:
        assert got[i]["log_ratio"] == pytest.approx(0 if text is None else 5 * math.log(1.1 if i % 2 else 0.9), abs=1e-5)
        assert got[i]["n_features"] == (0 if text is None else 11)
    assert sum(r["kept"] for r in got.values()) == round(41 / 2)


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_importance_sample_of_unseen_labels(spark, table):
    docs, labels = (load(spark, f"/root/testdata/{table}", name) for name in ("documents", "labels"))
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    kept = resampling.importance(docs, labels.where(~unseen), Stash(spark, "t")).select("doc_id", "kept").join(labels.where(unseen), "doc_id")
    share = lambda which: kept.where(which).agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert share("quality = 0") <= 0.25 and share("quality = 1 AND toxic = 0") >= 0.75


def test_kth_largest(spark):
    draw = random.Random(1)
    values = [round(draw.gauss(0, 1), 2) for _ in range(3000)] + [-500.0, 12.5, 12.5]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 3, 1500, 3003):
        assert resampling.kth_largest(table, "v", k, few=50) == sorted(values, reverse=True)[k - 1]


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, f"{tmp_path}/r")
    row = lambda op, i, t, source="a", seq=0: (op, i, source, "en", "w", t, seq)
    batch = lambda *rows: spark.createDataFrame(list(rows), token_rollup.CHANGE)
    totals = lambda: {r["source"]: (r["n_docs"], r["n_tokens"]) for r in rollup.totals("source").collect()}
    first = batch(row("insert", 1, 10), row("insert", 2, 5, "b"), row("insert", None, 3, None), row("insert", None, 4, None), row("insert", 3, None))
    assert rollup.commit("one", first) and totals() == {"a": (2, 10), "b": (1, 5), None: (2, 7)}
    assert not rollup.commit("one", first) and totals() == {"a": (2, 10), "b": (1, 5), None: (2, 7)}
    rollup.commit("two", batch(row("revise", 1, 8, "b", 1), row("revise", 1, 99, "b", 0), row("delete", 2, None), row("delete", 77, None)))
    assert totals() == {"a": (1, 0), "b": (1, 8), None: (2, 7)}
    rollup.commit("three", batch(row("insert", 2, 6, "c")))
    assert totals() == {"a": (1, 0), "b": (1, 8), "c": (1, 6), None: (2, 7)}
    assert rollup.commit("empty", batch(row("insert", 1, 1)).limit(0)) and totals()["c"] == (1, 6)


def test_rollup_takes_any_batch_id_and_compacts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_rollup, "COMPACT", 3)
    rollup = token_rollup.Rollup(spark, f"{tmp_path}/r")
    draw, held, loose = random.Random(2), {}, 0
    for n in range(8):
        rows = []
        for i in draw.sample(range(12), 5):
            op, source, tokens = draw.choice(["insert", "revise", "delete"]), draw.choice("ab"), draw.randint(0, 9)
            rows.append((op, i, source, "en", "w", tokens, 0))
            held.pop(i, None)
            if op != "delete":
                held[i] = (source, tokens)
        rows.append(("insert", None, "c", "en", "w", n, 0))
        loose += n
        batch, name = spark.createDataFrame(rows, token_rollup.CHANGE), f"2024/01/{n} ~ ü?*"
        assert rollup.commit(name, batch) and not rollup.commit(name, batch)
    want = {s: (sum(x[0] == s for x in held.values()), sum(x[1] for x in held.values() if x[0] == s)) for s in {x[0] for x in held.values()}} | {"c": (8, loose)}
    assert {r["source"]: (r["n_docs"], r["n_tokens"]) for r in rollup.totals("source").collect()} == want
    assert sorted(rollup._names("base")) == [3, 6] and not rollup.commit("2024/01/0 ~ ü?*", batch)
    with pytest.raises(OSError):
        (tmp_path / "r" / "staged").mkdir()
        rollup._publish(f"{tmp_path}/r/staged", "base=000000003")


def rolled_up(rows, count):
    """Totals in plain Python."""
    out = {}
    for _, text, lang, source, _ in rows:
        lines = (text or "").split("\n")
        if any(len(x) >= 10 for x in lines):
            for version, n in count("\n".join(dict.fromkeys(lines))).items():
                docs, tokens = out.get((source, lang, version), (0, 0))
                out[source, lang, version] = docs + 1, tokens + n
    return out


def test_op6_counts_are_those_of_the_tokenizers(spark, tmp_path):
    import sentencepiece
    from tokenizers import Tokenizer

    from stallkeeper.llm import packing, piece_bpe

    pieces, words = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_path()), Tokenizer.from_file(packing.tokenizer_path())
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", None) for i, t in enumerate(["", None, "short", "some words, that are long enough", "é  日本語 😀 a line of text\n\nx\na line of text", "twice the line\ntwice the line\n" * 40])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in token_rollup.op6_token_rollup(spark, str(tmp_path)).collect()}
    assert got == rolled_up(rows, lambda t: {"piece_bpe_32k": len(pieces.encode(t)), "word_bpe_49k": len(words.encode(t, add_special_tokens=False).ids)})


def test_rollup_of_whole_tables_is_that_of_sql(spark, tmp_path):
    import duckdb

    path = "/root/testdata/sf0.01/documents.parquet"
    counters = {v: token_rollup.by_pattern(p) for v, p in token_rollup.PATTERNS.items()}
    got = token_rollup.roll_up(spark.read.parquet(path), counters, token_rollup.Rollup(spark, f"{tmp_path}/r"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
        want = db.execute(token_rollup.PATTERNS_SQL).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 50


def test_rollup_and_sql_agree_on_nulls(spark, tmp_path):
    import duckdb

    rows = [(1, "a text that is long enough", "en", "s"), (2, None, "en", "s"), (3, "short", "en", "s"), (4, "", None, None), (5, "no source, a long line\nno source, a long line", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    counters = {v: token_rollup.by_pattern(p) for v, p in token_rollup.PATTERNS.items()}
    got = token_rollup.roll_up(spark.read.parquet(f"{tmp_path}/documents.parquet"), counters, token_rollup.Rollup(spark, f"{tmp_path}/r"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = db.execute(token_rollup.PATTERNS_SQL).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and {r[:4] for r in want} >= {("s", "en", "words-1", 1), (None, None, "words-1", 1)}


SMALL = "/root/testdata/sf0.001"


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = load(spark, SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "minhash near-dedup", "suffix-array dedup", "secret scans", "packing"]
    before = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == before
    assert corpus_pipeline.run(spark, SMALL).count() == packed.count()
