"""Prices, stock, condition, category, identifiers and URLs of raw listings as column expressions."""

from __future__ import annotations

from functools import reduce
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import AUDIO
from .text import DIGITS

MONEY = "decimal(12,2)"
MOST_MONEY = "9999999999.99"

# Words of stock texts in the order they are looked for.
STOCK_WORDS = (
    (False, ("outofstock",)),
    (True, ("instock",)),
    (False, ("out of stock", "not in stock", "sold out", "unavailable", "not available")),
    (True, ("in stock", "available")),
)
# Title patterns of audio types, drives and conditions.
OVER_EAR, EAR_BUDS = r"airpods max|over[- ]ear|on[- ]ear|headphones?", r"in[- ]ear|earbuds?|tws|true wireless"
HEADSET, HEADSET_LOOSE = r"gaming headset|gaming headphone|headset|boom mic", r"headset|gaming headphone"
TRUE_WIRELESS = r"airpods(?! max)|earbuds?|tws|true wireless|studio buds|solo buds"
EARPHONE = r"earpods|wired earphone|in[- ]ear|earphones?|neckband|necklace"
ACCESSORY = r"(?i)\b(stand|holder|mount|case|cover|adapter|cable|protector)\b"
DRIVE_ACCESSORY = r"(?i)\b(?:mounting kit|drive enclosure|drive caddy)\b"
SOLID_STATE, HARD_DISK = r"(?i)\bssd\b|solid[ -]state (?:drive|disk)|\bnvme\b", r"(?i)\bhdd\b|hard[ -]disk|mechanical hard[ -]drive"
HARD_DRIVE = r"(?i)hard[ -]drive"
REFURBISHED, USED = r"(?i)\b(refurbished|renewed|open[ -]?box)\b", r"(?i)\b(used|pre[ -]?owned)\b"
PRICE_HINTS = ("not_found", "price_on_request")


def parse_number(text: Column) -> Column:
    """The first number of a text as text, thousands commas taken out and two decimals at most; null without one."""
    plain = F.translate(F.translate(text, DIGITS, "0123456789" * 2), ",", "")
    return F.nullif(F.regexp_extract(plain, r"\d+(?:\.\d{1,2})?", 0), F.lit(""))


def parse_price(text: Column) -> Column:
    """A price text as money; null without a number or beyond what fits."""
    return parse_number(text).try_cast(MONEY)


def parse_stock(text: Column) -> Column:
    """True, false or unknown by the first words found."""
    low = F.lower(text)
    cases = [(reduce(Column.__or__, (low.contains(w) for w in words)), value) for value, words in STOCK_WORDS]
    return reduce(lambda rest, case: F.when(case[0], F.lit(case[1])).otherwise(rest), reversed(cases), F.lit(None).cast("boolean"))


def price_state(price: Column, hint: Column) -> tuple[Column, Column]:
    """(price, status): prices of 2 and less are placeholders; without a price only some hints hold."""
    shown = F.when(price > 2, price)
    status = F.when(price <= 2, "placeholder").when(price.isNotNull(), "known").when(hint.isin(*PRICE_HINTS), hint).otherwise("not_found")
    return shown, status


def condition(name: Column, given: Column) -> Column:
    given = F.nullif(given, F.lit(""))
    return F.when(given.isNotNull(), given).when(name.rlike(REFURBISHED), "refurbished").when(name.rlike(USED), "used").otherwise("new")


def audio_type(name: Column, proposed: Column) -> Column:
    name = F.lower(name)
    over = name.rlike(OVER_EAR) & ~name.rlike(EAR_BUDS)
    return (
        F.when(over & name.rlike(HEADSET), "headsets").when(over, "headphones").when(name.rlike(HEADSET_LOOSE), "headsets")
        .when(name.rlike(TRUE_WIRELESS), "true_wireless_earbuds").when(name.rlike(EARPHONE), "earphones").otherwise(proposed)
    )


def storage_type(name: Column, proposed: Column) -> Column:
    solid, disk = name.rlike(SOLID_STATE), name.rlike(HARD_DISK)
    found = (
        F.when(name.rlike(DRIVE_ACCESSORY), "accessories").when(solid & ~disk, "ssd").when(disk & ~solid, "hdd")
        .when(name.rlike(HARD_DRIVE) & ~solid, "hdd").otherwise(proposed)
    )
    return F.when(proposed.isin("ssd", "hdd"), found).otherwise(proposed)


def refined_category(name: Column, proposed: Column) -> Column:
    """The proposed category corrected by what the title says."""
    loose = (proposed == "accessories") & ~name.rlike(ACCESSORY)
    return F.when(proposed.isin(*AUDIO) | loose, audio_type(name, proposed)).otherwise(storage_type(name, proposed))


def gtin_is_valid(text: Column, swapped_weights: bool = False) -> Column:
    """Length and check digit. ``swapped_weights`` gives the digit next to the check digit weight 1, as older data had it."""
    digits = F.transform(F.split(F.reverse(text), ""), lambda d: d.try_cast("int"))
    odd = 1 if swapped_weights else 3
    body = F.slice(digits, 2, 13)
    total = F.aggregate(F.transform(body, lambda d, i: d * F.when(i % 2 == 0, odd).otherwise(4 - odd)), F.lit(0), lambda s, x: s + x)
    shaped = F.coalesce(text.rlike(r"^([0-9]{8}|[0-9]{12}|[0-9]{13}|[0-9]{14})$"), F.lit(False))
    return F.when(shaped, (10 - total % 10) % 10 == F.get(digits, F.lit(0))).otherwise(False)


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, url: pd.Series) -> pd.Series:
    """A reference resolved against its page; Spark has no function for it. Null where either can't be read."""

    def one(b: str | None, u: str | None) -> str | None:
        if u is None or not u.strip():
            return None
        try:
            return urljoin(b or "", u.strip())
        except ValueError:
            return None

    return pd.Series([one(b, u) for b, u in zip(base, url, strict=True)], dtype="object")


def url_part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def canonical_url(url: Column, hosts: Column, host: Column, path_rule: Column, kept: Column) -> tuple[Column, Column]:
    """(canonical URL, why not) of an absolute URL by its provider's rule.

    ``hosts`` are the allowed hosts (array), ``host`` the canonical one, ``path_rule`` a
    pattern that product paths match and ``kept`` the parameters that name a product (array),
    which must all be there if there are any. Scheme and fragment don't matter and a trailing
    slash goes.
    """
    scheme, found = F.lower(url_part(url, "PROTOCOL")), F.lower(url_part(url, "HOST"))
    path = F.coalesce(F.nullif(F.regexp_replace(F.coalesce(url_part(url, "PATH"), F.lit("")), "/+$", ""), F.lit("")), F.lit("/"))
    query_text = F.concat(F.lit("&"), F.coalesce(url_part(url, "QUERY"), F.lit("")))
    value = lambda k: F.call_function("regexp_extract", query_text, F.concat(F.lit("&"), k, F.lit("=([^&]+)")), F.lit(1))
    missing = F.exists(kept, lambda k: value(k) == "")
    query = F.array_join(F.transform(kept, lambda k: F.concat(k, F.lit("="), value(k))), "&")
    why = (
        F.when(url.isNull() | (F.trim(url) == ""), "missing product URL").when(~F.coalesce(scheme.isin("http", "https") & found.isNotNull(), F.lit(False)), "invalid product URL")
        .when(~F.coalesce(F.array_contains(hosts, found), F.lit(False)), "offsite product URL").when(~F.coalesce(F.rlike(path, path_rule), F.lit(True)), "not a product page")
        .when(F.coalesce(missing, F.lit(False)), "product URL lacks its id")
    )
    whole = F.concat(F.lit("https://"), host, path, F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(why.isNull(), whole), why


def absolute_image(url: Column) -> Column:
    """An image's URL without its fragment; null unless http or https."""
    return F.when(F.lower(url_part(url, "PROTOCOL")).isin("http", "https"), F.regexp_replace(url, "#.*$", ""))


def minor_units(amount: Column, decimals: Column) -> Column:
    """A price in minor units (0 to 3 decimals) as money; null if either is no such number."""
    whole = amount.try_cast("decimal(18,0)")
    scaled = whole / F.pow(F.lit(10), decimals).cast("decimal(4,0)")
    return F.when(decimals.between(0, 3) & (whole >= 0), scaled.try_cast(MONEY))


def money_text(price: Column) -> Column:
    return F.format_string("%.2f", price)


def sorted_json(options: Column) -> Column:
    """A map as JSON with sorted keys, for stable keys."""
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(options)))), F.lit("{}"))


def source_key(provider_product_id: Column, product_url: Column, provider_variant_id: Column, variant: Column) -> Column:
    return F.concat_ws(":", F.coalesce(provider_product_id, product_url), F.coalesce(provider_variant_id, sorted_json(variant)))


def identity_key(provider: Column, key: Column) -> Column:
    return F.concat_ws(":", F.lit("source"), provider, key)
