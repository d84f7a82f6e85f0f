"""From raw listings to one validated row for each product or offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.listing import (
    MONEY, MOST_MONEY, absolute_image, canonical_url, condition, gtin_is_valid, identity_key, join_url, parse_number, parse_price, parse_stock,
    price_state, refined_category, source_key,
)
from ..functions.text import collapse, normalize_brand
from ..schemas import CATEGORIES, CONDITIONS
from ..workers import ready


def category_priority(spark) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(CATEGORIES)], "category string, rank int")


def broadcast_if_few(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """Hints a broadcast only for a table whose rows were counted and are few; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def normalize_listings(raw: DataFrame, url_rules: DataFrame, marketplaces: tuple[str, ...] = ()) -> DataFrame:
    """Typed listings with ``reject_reason``: null for valid rows, else the first rule that failed.

    ``url_rules`` has a row for each provider: provider, base, hosts, host, path_rule and kept
    (see ``canonical_url``); it is a dimension of a few rows. Only providers in
    ``marketplaces`` may name a seller.
    """
    ready(raw.sparkSession)
    joined = raw.join(broadcast_if_few(url_rules), "provider", "left")
    # In columns of their own, as Python functions can't stand inside array expressions.
    joined = joined.withColumns({"_url": join_url(F.col("base"), F.col("product_url")), "_image": join_url(F.col("base"), F.col("image_url"))})
    name = collapse(F.col("name"))
    url, why_url = canonical_url(F.col("_url"), F.col("hosts"), F.col("host"), F.col("path_rule"), F.col("kept"))
    number = parse_number(F.col("price"))
    price, status = price_state(number.try_cast("decimal(38,2)"), F.col("price_status"))
    state = condition(name, F.col("condition"))
    why = (
        F.when(name.isNull(), "missing product name").when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "unmapped category")
        .when(F.col("host").isNull(), "unknown provider").when(why_url.isNotNull(), why_url)
        .when(F.coalesce(F.nullif("currency", F.lit("")), F.lit("EGP")) != "EGP", "unsupported currency").when(price > F.lit(MOST_MONEY).cast("decimal(12,2)"), "price out of range")
        .when(~state.isin(*CONDITIONS), "invalid condition")
        .when(F.nullif("seller_id", F.lit("")).isNotNull() & ~F.col("provider").isin(*marketplaces), "unexpected marketplace seller")
    )
    key = source_key(F.col("provider_product_id"), url, F.col("provider_variant_id"), F.col("variant"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return joined.select(
        "provider", name.alias("name"), refined_category(name, F.col("category")).alias("category"), normalize_brand(F.col("brand")).alias("brand"),
        price.try_cast(MONEY).alias("price"), status.alias("price_status"), parse_price(F.col("old_price")).alias("old_price"), F.lit("EGP").alias("currency"),
        parse_stock(F.col("in_stock")).alias("in_stock"), state.alias("condition"), url.alias("product_url"), absolute_image(F.col("_image")).alias("image_url"),
        F.coalesce("depth", F.lit(0)).alias("depth"), blank("sku").alias("sku"), blank("model_number").alias("model_number"), blank("manufacturer_part_number").alias("mpn"),
        F.coalesce(blank("gtin"), F.when(gtin_is_valid(F.trim("sku")), F.trim("sku"))).alias("gtin"), F.nullif("seller_id", F.lit("")).alias("seller_id"), "warranty",
        F.col("provider_product_id"), F.col("provider_variant_id"), "variant", "specifications", key.alias("source_key"),
        identity_key(F.col("provider"), key).alias("identity_key"), "seq", why.alias("reject_reason"),
    )


def accepted(listings: DataFrame) -> DataFrame:
    return listings.where("reject_reason IS NULL").drop("reject_reason")


def reject_report(listings: DataFrame, examples: int = 20) -> DataFrame:
    """Rejected rows by reason with the first few by arrival; lists stay short, as only the first are collected."""
    order = Window.partitionBy("reject_reason").orderBy("seq")
    rejected = listings.where("reject_reason IS NOT NULL").withColumn("_rank", F.row_number().over(order))
    totals = rejected.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rejected"))
    shown = rejected.where(F.col("_rank") <= examples).groupBy("reject_reason").agg(F.array_sort(F.collect_list(F.struct("_rank", "name"))).alias("examples"))
    return totals.join(shown, "reject_reason").withColumn("examples", F.transform("examples", lambda e: e["name"]))


def dedup_by_priority(listings: DataFrame, priority: DataFrame, key: str, depth: Column, ties: list[Column]) -> DataFrame:
    """One row for each key: deepest path, then first category in priority, then known price and stock, then name and brand."""
    ranked = listings.join(broadcast_if_few(priority), "category")
    order = Window.partitionBy(key).orderBy(
        depth.desc(), F.col("rank").asc(), F.col("price").isNull().asc(), F.col("in_stock").isNull().asc(), F.col("name").asc(), F.coalesce("brand", F.lit("")).asc(), *ties
    )
    return ranked.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "rank")


def sample_per_category(rows: DataFrame, key: str, n: int) -> DataFrame:
    order = Window.partitionBy("category").orderBy(key)
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def last_write_wins(rows: DataFrame, key: str, seq: Column, *ties: Column) -> DataFrame:
    order = Window.partitionBy(key).orderBy(seq.desc(), *ties)
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def preview(rows: DataFrame, key: str, n: int = 5) -> DataFrame:
    """For each canonical category its rows and a few samples as JSON; empty categories too."""
    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("rows"))
    some = sample_per_category(rows, key, n).groupBy("category").agg(F.to_json(F.array_sort(F.collect_list(F.struct("position", key, "name")))).alias("samples"))
    every = category_priority(rows.sparkSession).select("category")
    return every.join(counts, "category", "left").join(some, "category", "left").select("category", F.coalesce("rows", F.lit(0)).alias("rows"), "samples")
