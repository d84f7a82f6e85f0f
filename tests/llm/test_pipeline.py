"""The pipeline's stages, each against a brute-force version of its decision."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import groups, near_corpus

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 7}", None if t is None else len(t)) for i, t in texts], SCHEMA)


def test_quality_stage_keeps_all_without_labels(spark, tmp_path):
    docs = documents(spark, list(enumerate(["some words here", None, ""])))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(STAGES["quality classifier"](spark, docs, str(tmp_path)).collect(), key=str) == sorted(docs.collect(), key=str)


def test_near_dedup_stage(spark):
    rows = near_corpus(9)
    kept = STAGES["minhash near-dedup"](spark, documents(spark, rows), "")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, least) in groups(rows).items() if i == least}


def test_suffix_stage(spark):
    draw = random.Random(2)
    prose = lambda n: " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 9))) for _ in range(n))
    passage = prose(60)
    texts = [prose(40) + passage + prose(20) for _ in range(6)] + [prose(90), None, ""]
    got = {r["doc_id"]: r for r in STAGES["suffix-array dedup"](spark, documents(spark, list(enumerate(texts))), "").collect()}
    raw = [(t or "").encode() for t in texts]
    often = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    for i, t in enumerate(raw):
        gone = np.zeros(len(t), bool)
        for at in range(len(t) - 199):
            if often[t[at : at + 200]] > 1:
                gone[at : at + 200] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        assert got[i]["text"] == (None if texts[i] is None else left)
        assert got[i]["n_chars"] == (None if texts[i] is None else len(left))


def test_secret_stage(spark):
    own, copied = "Qw3" * 8, "fedcba9876543210"
    texts = [f"a {copied} b" for _ in range(7)] + [f"é password={'x1' * 8} then {own}!", "clean", None]
    got = {r["doc_id"]: r["text"] for r in STAGES["secret scans"](spark, documents(spark, list(enumerate(texts))), "").collect()}
    assert got == {**{i: f"a {copied} b" for i in range(7)}, 7: "é [secret] then [secret]!", 8: "clean", 9: None}


def test_packing_stage(spark):
    texts = ["one two three, four. " * 300, "", None]
    pieces = STAGES["packing"](spark, documents(spark, list(enumerate(texts))), "").collect()
    for i in range(3):
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert [p["start"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
        assert sum(p["length"] for p in own) == own[0]["doc_tokens"] and all(p["length"] & (p["length"] - 1) == 0 for p in own)


#: Names that columns have inside the operators.
INNER = [
    "row", "own_id", "own_hash", "_id", "_hash", "_first", "_again", "held", "bad", "good", "log_ratio", "draw", "kept", "bucket", "node", "label", "component_id", "text_hash", "n_shingles",
    "d1", "d2", "t1", "t2", "at", "wanted", "whole", "ranges", "left", "n_bytes", "owner", "repository", "rid", "base", "other", "owned", "live", "copied", "new", "_text", "_row", "_bit", "_bits", "a b.c",
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, tmp_path, name):
    text = "some words that stand in each of these rows and no secret at all"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, ""), (3, "other words here, key Zx9Ab1Ab1Ab1Ab1Ab1Ab1Ab1")]
    docs = documents(spark, rows).select("*", *(F.lit("z").alias(n) for n in INNER))
    spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = STAGES[name](spark, docs, str(tmp_path))
    if name == "packing":
        assert got.select("doc_id").distinct().count() == 4
    else:
        assert got.columns == docs.columns and got.where("`a b.c` = 'z' AND row = 'z' AND base = 'z'").count() == got.count()
        assert {r["doc_id"] for r in got.collect()} == {1, 2, 3, None}
        assert got.count() == (5 if name == "minhash near-dedup" else 6)
    assert STAGES[name](spark, docs.limit(0), str(tmp_path)).count() == 0
