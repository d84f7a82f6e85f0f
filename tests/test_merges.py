"""Merges by components against one fold over the whole queue."""

import random

import pytest

from stallkeeper.functions import identity as I
from stallkeeper.operators import merges as M
from stallkeeper.scratch import Scratch

DECISIONS = "pair_key string, left long, right long, verdict string, reviewed boolean, created_at int"


def fold(rows, product, limit):
    """Steps and the tables after them: where variants are, what merged ones went into."""
    product, into, steps, merges = dict(product), {}, [], 0
    for key, left, right, verdict, _, _ in sorted((r for r in rows if r[3] in (I.EXACT, I.VARIANT)), key=lambda r: (not r[4], -1 if r[5] is None else r[5], r[0])):
        if merges >= limit:
            break
        if left not in product or right not in product:
            continue
        a, b = product[left], product[right]
        if a == b:
            steps.append((key, "applied", None, None, None, None))
            continue
        goes, keeps = (right, left) if a < b else (left, right)
        merges += 1
        steps.append((key, "merge" if verdict == I.EXACT else "group", goes, keeps, max(a, b), min(a, b)))
        if verdict == I.EXACT:
            del product[goes]
            into[goes] = keeps
        else:
            product[goes] = min(a, b)
    return steps, product, into


def last(v, into):
    while v in into:
        v = into[v]
    return v


def plan(spark, rows, product, limit):
    variants = spark.createDataFrame([(v, p, f"k{v}") for v, p in product.items()], "variant_id long, product_id long, identity_key string")
    return M.merge_steps(spark.createDataFrame(rows, DECISIONS), variants, Scratch(spark, "t"), limit), variants


@pytest.mark.parametrize(("seed", "limit"), [(1, 1000), (2, 25), (3, 1)])
def test_random_queues_equal_one_fold(spark, seed, limit):
    draw = random.Random(seed)
    product = {v: 500 + v // draw.randint(1, 3) for v in range(60)}
    rows = [(f"{i:03}", draw.randrange(64), draw.randrange(64), draw.choice([I.EXACT, I.VARIANT, I.VARIANT, I.DIFFERENT]), draw.choice([True, False, False, None]), draw.choice([None, *range(9)])) for i in range(150)]
    rows = [(*r[:4], bool(r[4]), r[5]) for r in rows]
    want, where, into = fold(rows, product, limit)
    steps, variants = plan(spark, rows, product, limit)
    got = [tuple(r[c] for c in ("pair_key", "action", "variant_id", "into_variant", "product_id", "into_product")) for r in steps.orderBy("place").collect()]
    assert got == want
    if seed == 2:
        return
    offers = spark.createDataFrame([(1000 + v, v) for v in product], "offer_id long, variant_id long")
    aliases = spark.createDataFrame([("old", 3), ("k5", 7), ("other", 59)], "identity_key string, variant_id long")
    products = spark.createDataFrame([(p, f"n{p}") for p in sorted(set(product.values()))], "product_id long, name string")
    families = spark.createDataFrame([(r[0], f"family {r[0]}" if int(r[0]) % 2 else None) for r in rows], "pair_key string, family string")
    after = M.apply_merges(steps, {"products": products, "variants": variants, "offers": offers, "aliases": aliases}, Scratch(spark, "t"), families)
    assert {r["variant_id"]: r["product_id"] for r in after["variants"].collect()} == where
    assert {r["offer_id"]: r["variant_id"] for r in after["offers"].collect()} == {1000 + v: last(v, into) for v in product}
    held = {"old": 3, "k5": 7, "other": 59} | {f"k{v}": v for v in into}
    assert {r["identity_key"]: r["variant_id"] for r in after["aliases"].collect()} == {k: last(v, into) for k, v in held.items()}
    names = {p: f"n{p}" for p in product.values()}
    for key, action, *_, to in want:
        if action == "group" and int(key) % 2:
            names[to] = f"family {key}"
    left = {r[4] for r in want if r[4]} - set(where.values())
    assert {r["product_id"]: r["name"] for r in after["products"].collect()} == {p: n for p, n in names.items() if p not in left}


def test_merges_fold_in_order(spark):
    rows = [("1:2", 1, 2, I.EXACT, False, 1), ("2:3", 2, 3, I.EXACT, False, 2), ("1:3", 1, 3, I.VARIANT, True, 9), ("3:4", 3, 4, I.VARIANT, False, 3)]
    steps, _ = plan(spark, rows, {1: 10, 2: 20, 3: 30, 4: 30}, 1000)
    # The reviewed grouping comes first; 2:3 names a variant that is gone by then.
    assert [tuple(r)[:6] for r in steps.orderBy("place").collect()] == [("1:3", "group", 3, 1, 30, 10), ("1:2", "merge", 2, 1, 20, 10), ("3:4", "group", 4, 3, 30, 10)]


def test_settled_pairs_do_not_fill_the_queue(spark):
    rows = [(f"{i}:99", i, 99, I.EXACT, True, 0) for i in range(1, 4)] + [("3:4", 3, 4, I.EXACT, True, 1), ("1:2", 1, 2, I.EXACT, False, 5), ("9", 4, 1, I.EXACT, False, 6)]
    assert {tuple(r)[:2] for r in plan(spark, rows, {1: 10, 2: 20, 3: 30, 4: 30}, 1)[0].collect()} == {("3:4", "applied"), ("1:2", "merge")}


def test_empty_queue_and_long_chains(spark):
    assert plan(spark, [("1", 1, 2, I.DIFFERENT, False, 0)], {1: 1, 2: 2}, 9)[0].count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    found = M.components(chain, Scratch(spark, "t")).collect()
    assert len(found) == 201 and {r["component"] for r in found} == {0}
