"""Record layouts and fixed domain values."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _MAP = T.StringType(), T.MapType(T.StringType(), T.StringType())

#: A listing as a reader emits it; everything but the name may be missing.
RAW_LISTING = T.StructType(
    [T.StructField(n, _TEXT) for n in ("provider", "name", "category", "product_url")]
    + [T.StructField("depth", T.IntegerType())]
    + [T.StructField(n, _TEXT) for n in (
        "brand", "image_url", "sku", "model_number", "manufacturer_part_number", "gtin", "seller_id", "warranty", "price", "old_price",
        "in_stock", "currency", "price_status", "condition", "provider_product_id", "provider_variant_id",
    )]
    + [T.StructField("variant", _MAP), T.StructField("specifications", _MAP), T.StructField("seq", T.LongType())]
)

# Fixed values that results depend on.

#: Canonical categories in priority order.
CATEGORIES = (
    "cpu", "gpu", "motherboard", "ram", "ssd", "hdd", "case", "power_supply", "cooling",
    "monitor", "accessories", "laptops", "mobile_phones", "headphones", "headsets",
    "earphones", "true_wireless_earbuds",
)
#: Categories whose listings are matched across providers: all of them.
MATCHED = CATEGORIES
AUDIO = ("headphones", "headsets", "earphones", "true_wireless_earbuds")
CONDITIONS = ("new", "used", "refurbished", "unknown")
#: Trust classes whose offers count: own stock, and own stock beside approved sellers.
DIRECT, WITH_MARKETPLACE = "VERIFIED_DIRECT_RETAILER", "VERIFIED_DIRECT_WITH_MARKETPLACE"
#: Guards: share of rows that one sync may delete; least products of a crawl.
DELETE_FRACTION, LEAST_PRODUCTS = 0.35, 10
#: Guards on known prices: least rows on both sides, prior share, absolute and relative drop.
COVERAGE_ROWS, COVERAGE_PRIOR, COVERAGE_DROP, COVERAGE_RELATIVE = 100, 0.5, 0.20, 0.30
FRESH_DAYS = 9
SCORE_FLOOR, TOP_CANDIDATES, BLOCK_CAP, ALIAS_TITLES = 0.45, 4, 100, 8
RULE_VERSION = 1
#: Search weights: lexical over name, category, brand, provider; hybrid over name, brand, semantic text; share of the vector rank.
LEXICAL_WEIGHTS = {"name": 8, "category": 4, "brand": 2, "provider": 1}
HYBRID_WEIGHTS = {"name": 6, "brand": 2, "semantic_text": 3}
VECTOR_SHARE = 0.35
PAGE_LIMIT, PAGE_LIMIT_MOST = 10, 100
