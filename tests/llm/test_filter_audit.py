"""The filter audit against SQL and against filters applied one after the other."""

from collections import Counter
from itertools import permutations

import duckdb
import pandas as pd

from stallkeeper.llm import filter_audit as fa

LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, LONG, "a"), (2, LONG, "b"), (2, LONG, "b"), (3, LONG, None), (4, LONG + " $", "a"), (5, None, "a"), (6, "", "b"), (7, "A " * 60, "a"), (8, "A " * 60, "a"),
    (9, "few words", ""), (None, LONG, "a"), (None, "only one", "c"), (None, None, None), (10, "É é é\u000b# " * 30, "b"), (11, "x" * 100_000, "c"), (2, "another text", "b"), (12, LONG.replace(" ", "\t"), "b"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (4, 0, 1), (None, 1, 1), (7, 1, 1), (99, 1, 1), (10, 0, 0)]


def fails(text, doc_id, least):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        "D": any(c in "#$%&*|" for c in text), "E": doc_id is not None and least.get(text, doc_id) < doc_id,
    }


def brute(rows, labels):
    least, good, toxic = {}, {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for part in sorted({s or "" for _, _, s in rows}):
        own = [(d, fails(t or "", d, least)) for d, t, s in rows if (s or "") == part]
        found, shapley = [], Counter()
        for order in permutations("ABCDE"):
            live = own
            for step, f in enumerate(order, 1):
                gone = [x for x in live if x[1][f]]
                live = [x for x in live if not x[1][f]]
                failing = [x for x in own if x[1][f]]
                shapley[f] += len(gone)
                found.append((part, "".join(order), step, len(live), len(gone), len(failing) - len(gone), sum(sum(x[1].values()) == 1 for x in failing), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)))
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in found]
    return sorted(out)


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, mask string, n int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_equals_filters_in_order_and_sql(spark):
    got = sorted(tuple(r) for r in fa.audit(*frames(spark, ROWS, LABELS)).collect())
    assert got == brute(ROWS, LABELS)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(ROWS, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    con.register("labels", pd.DataFrame(LABELS, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    assert sorted(con.execute(fa.OP12_SQL).fetchall()) == got


def test_many_parts(spark):
    """More parts than one product takes, and than one batch holds."""
    rows = [(i, LONG if i % 3 else "few", f"p{i % 45}") for i in range(200)]
    assert sorted(tuple(r) for r in fa.audit(*frames(spark, rows, LABELS)).collect()) == brute(rows, LABELS)


def test_empty(spark):
    docs, labels = frames(spark, ROWS, LABELS)
    assert fa.audit(docs.limit(0), labels).count() == 0
    assert fa.audit(docs, labels.limit(0)).agg({"toxic_lost": "sum"}).first()[0] == 0


def test_matrices_say_each_outcome_once():
    m = fa.outcome_matrices()
    assert all(x.shape == (32, 600) and x.dtype.kind == "i" for x in m.values())
    removed = m["removed"].reshape(32, 120, 5)
    assert (removed.sum(axis=2) == (fa.np.arange(32) > 0)[:, None]).all()
    assert (m["kept"][:, 4::5].sum(axis=1)[1:] == 0).all() and (m["kept"][0] == 1).all()
