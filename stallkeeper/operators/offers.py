"""Trusted and current offers, the best offer of each product, and the read model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DIRECT, FRESH_DAYS, WITH_MARKETPLACE


def is_trusted() -> Column:
    """A direct retailer's offer, or one of an approved seller on a mixed marketplace."""
    approved = F.coalesce(F.array_contains("approved_sellers", F.col("seller_id")), F.lit(False))
    return (F.col("trust") == DIRECT) | ((F.col("trust") == WITH_MARKETPLACE) & approved)


def is_current(as_of: Column, days: int = FRESH_DAYS) -> Column:
    """The provider's last crawl did not fail and the offer was seen within the horizon, its end included."""
    alive = ~F.col("last_crawl_status").eqNullSafe("failed")
    return alive & F.coalesce(F.col("last_seen_at") >= as_of - F.make_interval(days=F.lit(days)), F.lit(False))


def trusted_offers(offers: DataFrame, providers: DataFrame, as_of: Column, days: int = FRESH_DAYS) -> DataFrame:
    """Offers of trusted providers with ``is_current``; the one scan that all of the read model shares."""
    joined = offers.join(providers, "provider_id").where(is_trusted())
    return joined.withColumn("is_current", is_current(as_of, days)).drop("trust", "approved_sellers", "last_crawl_status")


def is_known() -> Column:
    return F.coalesce(F.col("price_status") == "known", F.lit(False))


def is_buyable() -> Column:
    return F.coalesce(F.col("in_stock"), F.lit(False)) & is_known() & F.coalesce(F.col("condition") == "new", F.lit(False))


def offer_rank() -> list[Column]:
    """Keys of which a product's best offer has the least: yes before no, cheap before dear, late before early, known before unknown."""
    known_new = is_known() & F.coalesce(F.col("condition") == "new", F.lit(False))
    shown = F.when(F.col("is_current"), F.col("price"))
    return [
        ~F.col("is_current"), ~is_buyable(), ~known_new, ~is_known(), shown.isNull(), shown,
        F.col("last_seen_at").isNull(), -F.unix_micros(F.col("last_seen_at").cast("timestamp")), F.col("price").isNull(), F.col("price"), F.col("offer_id"),
    ]


def best_offers(trusted: DataFrame, tie_break: list[Column] = ()) -> DataFrame:
    """One row for each product: its best trusted offer with the price and stock states shown to readers.

    A price is shown only while current; a known price that is not is the last one seen.
    """
    # The least of the rank keys is found by aggregation, so what a popular product's offers add up to is folded before it moves.
    keys = F.struct(*(k.alias(f"k{i}") for i, k in enumerate([*offer_rank(), *tie_break])))
    shown = [c for c in trusted.columns if c not in ("product_id", "seller_id")]
    best = trusted.groupBy("product_id").agg(F.min_by(F.struct(*shown), keys).alias("best")).select("product_id", "best.*")
    current = F.col("is_current")
    return best.select(
        "product_id", "offer_id", "variant_id", "provider_id", "provider_name", "condition", "currency", "last_seen_at",
        F.when(current, F.col("price")).alias("price"),
        F.when(current, F.col("price_status")).when(is_known(), "stale").otherwise("not_found").alias("price_status"),
        F.when(~current & is_known(), F.col("price")).alias("last_seen_price"),
        (current & F.coalesce("in_stock", F.lit(False))).alias("in_stock"),
        (current & F.col("in_stock").isNotNull()).alias("stock_known"), *(c for c in ("url", "image_url") if c in trusted.columns),
    )


def read_model(products: DataFrame, variants: DataFrame, trusted: DataFrame, tie_break: list[Column] = ()) -> DataFrame:
    """Products that have a trusted offer, with their best one and what their other offers add up to."""
    current = F.col("is_current")
    offered = trusted.groupBy("product_id").agg(
        F.array_sort(F.collect_set(F.when(current, F.col("provider_id")))).alias("provider_ids"), F.count_if(current).alias("offer_count")
    )
    counted = variants.groupBy("product_id").agg(F.count(F.lit(1)).alias("variant_count"))
    return (
        products.join(best_offers(trusted, tie_break), "product_id").join(offered, "product_id").join(counted, "product_id", "left")
        .withColumn("variant_count", F.coalesce("variant_count", F.lit(0)))
    )


def offers_of(trusted: DataFrame, product_ids: list[int] | None = None, tie_break: list[Column] = ()) -> DataFrame:
    """All trusted offers of products (by default of all) in the order they are shown, with that order as ``position``."""
    order = Window.partitionBy("product_id").orderBy(F.col("is_current").desc(), is_buyable().desc(), F.col("price").asc_nulls_last(), "offer_id", *tie_break)
    some = trusted if product_ids is None else trusted.where(F.col("product_id").isin(product_ids))
    return some.withColumn("position", F.row_number().over(order))


def displayed_offer(offers: DataFrame) -> DataFrame:
    """The offer shown for each variant: the first (by position) that meets the earliest of four wishes; none without a known price."""
    current, known, new = F.col("is_current"), is_known(), F.coalesce(F.col("condition") == "new", F.lit(False))
    wish = F.when(current & is_buyable(), 0).when(current & known & new, 1).when(current & known, 2).when(known, 3)
    first = Window.partitionBy("variant_id").orderBy("_wish", "position")
    return offers.withColumn("_wish", wish).where("_wish IS NOT NULL").withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank", "_wish")


def facet_providers(providers: DataFrame) -> DataFrame:
    return providers.where(F.col("trust").isin(DIRECT, WITH_MARKETPLACE)).select("provider_id", "provider_name").orderBy("provider_name")


def semantic_text() -> Column:
    """What a product is, in words: its name, category and, if it has one, its brand."""
    brand = F.nullif(F.trim("brand"), F.lit(""))
    return F.concat_ws("\n", F.trim("name"), F.concat(F.lit("Category: "), F.trim("category")), F.concat(F.lit("Brand: "), brand))


def search_document(model: DataFrame) -> DataFrame:
    """The read model as documents for search: prices as numbers, unknown stock as null, times in seconds.

    Links, images and times of making are there if the model has them.
    """
    has = lambda *names: [c for c in names if c in model.columns]
    return model.select(
        F.col("product_id").alias("id"), "name", "category", "brand", *has("category_id", "brand_id"), "provider_id", "provider_name", "provider_ids", "variant_count", "offer_count",
        F.round(F.col("price").cast("double"), 2).alias("price"), F.round(F.col("last_seen_price").cast("double"), 2).alias("last_seen_price"), "price_status", "currency", F.col("variant_id").alias("product_variant_id"),
        F.when(F.col("stock_known"), F.col("in_stock")).alias("in_stock"), "condition", F.unix_timestamp("last_seen_at").alias("last_seen_at"), semantic_text().alias("semantic_text"),
        *(F.col(c).alias({"url": "canonical_product_url"}.get(c, c)) for c in has("url", "image_url")), *(F.unix_timestamp(c).alias(c) for c in has("created_at", "updated_at")),
    )


def api_product(documents: DataFrame) -> DataFrame:
    """Documents as readers of the API get them: nested names, prices as text, times as timestamps."""
    money = lambda c: F.format_string("%.2f", c)
    status = F.coalesce("price_status", F.when(F.col("price").isNotNull(), "known").otherwise("not_found"))
    has = lambda *names: [c for c in names if c in documents.columns]
    known = lambda name, *parts: F.struct(*(F.col(c).alias(a) for c, a in parts if c in documents.columns)).alias(name)
    return documents.select(
        "id", "name", known("category", ("category_id", "id"), ("category", "slug")), F.when(F.col("brand").isNotNull(), known("brand", ("brand_id", "id"), ("brand", "name"))).alias("brand"),
        F.struct(F.col("provider_id").alias("id"), F.col("provider_name").alias("name")).alias("provider"), F.size("provider_ids").alias("provider_count"), "variant_count", "offer_count",
        money(F.col("price")).alias("price"), money(F.col("last_seen_price")).alias("last_seen_price"), status.alias("price_status"), "in_stock", "condition",
        F.when(F.col("last_seen_at") > 0, F.timestamp_seconds("last_seen_at")).alias("last_seen_at"), *has("currency", "product_variant_id", "image_url", "canonical_product_url"),
        *(F.timestamp_seconds(c).alias(c) for c in has("created_at", "updated_at")),
    )
