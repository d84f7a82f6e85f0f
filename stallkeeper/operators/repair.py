"""Data repairs as rewrites with a log, and their undoing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Product ids whose counts one window adds up.
GROUP = 1 << 16


def recategorize(products: DataFrame, offers: DataFrame, title: Column, has: str, lacks: str, category: Column, new: str) -> DataFrame:
    """Products of a category move to another if some offer's title has one pattern and not the other."""
    hit = offers.where(title.rlike(has) & ~title.rlike(lacks)).select("product_id").distinct()
    moved = products.where(category).join(hit, "product_id", "left_semi").select("product_id", F.lit(new).alias("_new"))
    return products.join(moved, "product_id", "left").withColumn("category", F.coalesce("_new", "category")).drop("_new")


def overbroad_products(variants: DataFrame) -> DataFrame:
    return variants.groupBy("product_id").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")


def split_products(variants: DataFrame, wide: DataFrame, first_new_id: int) -> DataFrame:
    """Log of a split: the least variant keeps the product, each other one gets a new id in the order of variants.

    New ids are dense: counts of each product, summed up within groups of ids and then over
    the groups, give where its ids begin, so that no window holds all products.
    """
    order = Window.partitionBy("product_id").orderBy("variant_id")
    ranked = variants.join(wide.select("product_id"), "product_id", "left_semi").withColumn("place", F.row_number().over(order))
    counts = wide.select("product_id", (F.col("variants") - 1).alias("extra"))
    before = lambda w: F.coalesce(F.sum("extra").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = counts.withColumn("group", F.floor(F.col("product_id") / GROUP))
    groups = grouped.groupBy("group").agg(F.sum("extra").alias("extra")).select("group", before(Window.orderBy("group")).alias("first"))
    inside = grouped.select("group", "product_id", before(Window.partitionBy("group").orderBy("product_id")).alias("own"))
    starts = inside.join(groups, "group").select("product_id", (F.col("first") + F.col("own")).alias("start"))
    moved = ranked.where("place > 1").join(starts, "product_id")
    return moved.select("variant_id", F.col("product_id").alias("old_product_id"), (F.lit(first_new_id) + F.col("start") + F.col("place") - 2).alias("new_product_id"))


def longest_names(offers: DataFrame) -> DataFrame:
    """Each variant's longest title; blank ones don't count."""
    named = offers.withColumn("title", F.nullif(F.trim("title"), F.lit("")))
    key = F.struct(F.coalesce(-F.length("title"), F.lit(1)), "offer_id", "title")
    return named.groupBy("variant_id").agg(F.min_by(F.struct("title"), key)["title"].alias("title"))


def apply_log(rows: DataFrame, log: DataFrame, key: str, column: str, to: str) -> DataFrame:
    """Rewrites a column where the log names the row: ``to`` is new_… to repair and old_… to undo."""
    return rows.join(log.select(key, F.col(to).alias("_to")), key, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def family_name(title: Column, pattern: str) -> Column:
    """The first group of a case-insensitive match, else null."""
    return F.nullif(F.regexp_extract(title, "(?i)" + pattern, 1), F.lit(""))
