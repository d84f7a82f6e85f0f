"""Applying merge decisions in order, split by the variants that decisions have in common."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import EXACT, VARIANT
from ..scratch import Scratch
from ..workers import ready


def components(edges: DataFrame, scratch: Scratch, rounds: int = 100) -> DataFrame:
    """(node, component): the least node that each node of the edges (a, b) is connected with.

    Each round takes the least label among neighbours and then that label's own label, so long
    chains take few rounds.
    """
    ways = scratch.put("ways", edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = scratch.put("labels-0", ways.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    for n in range(1, rounds + 1):
        near = ways.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        best = labels.join(near, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("_far"))
        labels = scratch.put(f"labels-{n}", best.join(jump, "component", "left").select("node", "_old", F.least("component", "_far").alias("component")))
        scratch.drop(f"labels-{n - 1}")
        if labels.where("component <> _old").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
    raise RuntimeError(f"components still change after {rounds} rounds")


def order() -> Column:
    """Reviewed decisions first, then the oldest."""
    return F.struct((~F.col("reviewed")).alias("x"), F.col("created_at").alias("y"), F.col("pair_key").alias("z"))


STEPS = "pair_key string, action string, variant_id long, into_variant long, product_id long, into_product long"


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decisions come by component and in order; what is remembered is where the component's variants are now."""
    component, product, gone = None, {}, set()
    for frame in frames:
        steps = []
        for key, comp, left, right, verdict, left_product, right_product in frame.itertuples(index=False):
            if comp != component:
                component, product, gone = comp, {}, set()
            if left in gone or right in gone:
                continue
            a, b = product.get(left, left_product), product.get(right, right_product)
            if a == b:
                steps.append((key, "applied", None, None, None, None))
                continue
            target = min(a, b)
            goes, keeps = (right, left) if a == target else (left, right)
            steps.append((key, "merge" if verdict == EXACT else "group", goes, keeps, max(a, b), target))
            if verdict == EXACT:
                gone.add(goes)
            else:
                product[goes] = target
        found = pd.DataFrame(steps, columns=[c.split()[0] for c in STEPS.split(", ")])
        yield found.astype({c: "Int64" for c in ("variant_id", "into_variant", "product_id", "into_product")})


def merge_steps(decisions: DataFrame, variants: DataFrame, scratch: Scratch, limit: int = 1000) -> DataFrame:
    """What applying decisions in order does: pair_key, action, and the variant and product that go into others.

    ``decisions`` are those that may be applied (see ``safe_to_apply``): pair_key (distinct),
    left, right, verdict, reviewed, created_at; ``variants`` has variant_id and product_id. An
    exact match merges the variant of the younger product into the other one, another match
    moves it to the older product; a decision on a variant that is gone does nothing and has
    no row, one within a product is applied as it is. No more than ``limit`` merges are made,
    and nothing after the last of them.

    Only decisions that share a variant depend on one another, so components are read in order
    apart from each other; a task remembers the variants of one component, not its decisions.
    """
    ready(scratch.spark)
    known = lambda n: variants.select(F.col("variant_id").alias(n), F.col("product_id").alias(f"{n}_product"))
    usable = decisions.where(F.col("verdict").isin(EXACT, VARIANT)).select("pair_key", "left", "right", "verdict", F.coalesce("reviewed", F.lit(False)).alias("reviewed"), "created_at")
    queue = scratch.put("queue", usable.join(known("left"), "left").join(known("right"), "right"))
    component = components(queue.select(F.col("left").alias("a"), F.col("right").alias("b")), scratch)
    dealt = queue.join(component.withColumnRenamed("node", "left"), "left").withColumn("_order", order())
    sorted_ = dealt.repartition("component").sortWithinPartitions("component", "_order")
    steps = sorted_.select("pair_key", "component", "left", "right", "verdict", "left_product", "right_product").mapInPandas(_fold, STEPS)
    steps = scratch.put("steps", steps.join(queue.select("pair_key", "reviewed", "created_at"), "pair_key").withColumn("_order", order()))
    merges = steps.where("action <> 'applied'").select("_order").orderBy("_order").limit(limit)
    cut = merges.agg(F.count(F.lit(1)).alias("n"), F.max("_order").alias("last"))
    # One row: the place of the last merge.
    return steps.join(F.broadcast(cut), (F.col("n") < limit) | (F.col("_order") <= F.col("last"))).drop("n", "last", "reviewed", "created_at").withColumnRenamed("_order", "place")


def final_variants(steps: DataFrame, scratch: Scratch, rounds: int = 64) -> DataFrame:
    """(variant_id, final): where each merged variant's offers end up, through variants that were merged later."""
    into = scratch.put("into-0", steps.where("action = 'merge'").select("variant_id", F.col("into_variant").alias("final")))
    for n in range(1, rounds + 1):
        far = into.select(F.col("variant_id").alias("final"), F.col("final").alias("_far"))
        moved = scratch.put(f"into-{n}", into.join(far, "final", "left").select("variant_id", F.coalesce("_far", "final").alias("final"), F.col("_far").isNotNull().alias("_moved")))
        scratch.drop(f"into-{n - 1}")
        into = moved.select("variant_id", "final")
        if moved.where("_moved").isEmpty():
            return into
    raise RuntimeError("merges go in circles")


def apply_merges(steps: DataFrame, tables: dict[str, DataFrame], scratch: Scratch, families: DataFrame | None = None) -> dict[str, DataFrame]:
    """The catalog tables after the steps: products, variants, offers and aliases.

    A merged variant's offers and aliases go to the one that stays, and its key becomes an alias
    of it. Products that the steps leave without variants go. ``families`` (pair_key, family)
    has the name that a decision's listing gives its family: the last one that joins a product
    names it.
    """
    final = scratch.put("final", final_variants(steps, scratch))
    moves = steps.where("action = 'group'").groupBy("variant_id").agg(F.max_by("into_product", "place").alias("_product"))
    variants, offers, aliases = tables["variants"], tables["offers"], tables["aliases"]
    stay = variants.join(final, "variant_id", "left_anti").join(moves, "variant_id", "left").withColumn("product_id", F.coalesce("_product", "product_id")).select(*variants.columns)
    moved = lambda rows: rows.join(final, "variant_id", "left").withColumn("variant_id", F.coalesce("final", "variant_id")).select(*rows.columns)
    fresh = variants.join(final, "variant_id").select("identity_key", F.col("final").alias("variant_id"))
    kept = moved(aliases).join(fresh.select("identity_key"), "identity_key", "left_anti")
    left = steps.where("product_id IS NOT NULL").select("product_id").distinct().join(stay.select("product_id").distinct(), "product_id", "left_anti")
    products = tables["products"].join(left, "product_id", "left_anti")
    if families is not None:
        named = steps.where("action = 'group'").join(families.where("family IS NOT NULL"), "pair_key").groupBy(F.col("into_product").alias("product_id")).agg(F.max_by("family", "place").alias("_name"))
        products = products.join(named, "product_id", "left").withColumn("name", F.coalesce("_name", "name")).select(*tables["products"].columns)
    return {"products": products, "variants": stay, "offers": moved(offers), "aliases": kept.unionByName(fresh.select(*aliases.columns))}
