"""What readers of the catalog are shown, as column expressions over documents and offers."""

from __future__ import annotations

from urllib.parse import urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F

from .listing import url_part


def variant_label(options: Column, title: Column, family: Column, sku: Column, variant_id: Column) -> Column:
    """A variant's options, else what its title adds to the family's name, else the title, the SKU or a number."""
    configured = F.nullif(F.array_join(F.filter(F.map_values(options), lambda v: F.coalesce(v, F.lit("")) != ""), " · "), F.lit(""))
    named = F.nullif(F.trim(title), F.lit(""))
    at = F.call_function("locate", F.lower(family), F.lower(named))
    rest = F.trim(F.regexp_replace(F.call_function("substring", named, at + F.length(family)), r"^[\s·|,–—-]+", ""))
    return F.coalesce(configured, F.when(at > 0, F.nullif(rest, F.lit(""))), named, sku, F.concat(F.lit("Variant "), variant_id))


def shown_price(price: Column, currency: Column) -> Column:
    return F.when(price > 0, F.concat(F.format_string("%.2f ", price), currency)).otherwise("Price not found")


def _stale() -> Column:
    return F.coalesce(F.col("price_status") == "stale", F.lit(False))


def card_store() -> Column:
    several = F.size(F.coalesce("provider_ids", F.array().cast("array<bigint>")))
    name = F.col("provider_name")
    return F.when(_stale() & name.isNotNull(), F.concat(F.lit("Last seen at "), name)).when(several > 1, F.concat(several, F.lit(" verified retailers"))).otherwise(F.coalesce(name, F.lit("Store listing")))


def card_stock() -> Column:
    return F.when(_stale(), "Price unverified").when(F.col("in_stock"), "In stock").when(~F.col("in_stock"), "Out of stock").otherwise("Stock unknown")


def card_price_note() -> Column:
    state = F.col("condition")
    return (
        F.when(_stale(), "Last seen price · not verified now").when(~F.coalesce(F.col("price_status") == "known", F.lit(False)), "Price unavailable")
        .when(F.col("variant_count") > 1, "From · lowest available configuration").when(state != "new", F.concat(state, F.lit(" listed price")))
        .when(F.col("in_stock"), "Lowest in-stock price").when(~F.col("in_stock"), "Listed price · out of stock").otherwise("Listed price · stock unconfirmed")
    )


def struck_price(price: Column, old_price: Column, is_current: Column, currency: Column) -> Column:
    """The old price, if the offer is current and it was higher."""
    return F.when(F.coalesce(is_current & (old_price > price), F.lit(False)), shown_price(old_price, currency))


def external_url(url: Column) -> Column:
    return F.when(F.lower(url_part(url, "PROTOCOL")).isin("http", "https"), url)


def query_string(filters: dict[str, str], page: int, limit: int) -> str:
    """A request's query: page, limit and what isn't empty; the text without blanks around it."""
    some = {k: v.strip() if k == "q" else v for k, v in filters.items()}
    return urlencode({"page": page, "limit": limit} | {k: v for k, v in some.items() if v != ""})
