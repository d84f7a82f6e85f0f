"""Folding, normalizing and tokenizing of titles as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Storefront spellings that keep a model's anchors, words that say nothing, and brand spellings.
ARABIC = (
    ("برو ماكس", "pro max"), ("برو", "pro"), ("آيفون", "iphone"), ("أيفون", "iphone"),
    ("ايفون", "iphone"), ("جالاكسي", "galaxy"), ("جيجابايت", "gb"), ("تيرابايت", "tb"),
)
STOP_WORDS = (
    "new", "original", "with", "for", "the", "and", "gaming", "wireless", "black", "white", "blue", "red",
    "silver", "egp", "warranty", "years", "year", "gb", "tb", "hz", "inch", "ssd", "ram",
)
BRANDS = {
    "g.skill": "G.Skill", "g skill": "G.Skill", "asus": "ASUS", "amd": "AMD", "intel": "Intel", "msi": "MSI",
    "gigabyte": "Gigabyte", "kingston": "Kingston", "addlink": "Addlink", "cooler master": "Cooler Master", "nvidia": "NVIDIA",
}
DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"


def _compatible(text: str | None) -> str | None:
    """NFKC, full case folding and ASCII for all decimal digits, which Spark has no function for."""
    if text is None or text.isascii():
        return text if text is None else text.lower()
    folded = unicodedata.normalize("NFKC", text).casefold()
    return "".join(str(unicodedata.digit(c)) if c.isdecimal() else c for c in folded)


@F.pandas_udf(T.StringType())
def compatibility_form(text: pd.Series) -> pd.Series:
    return text.map(_compatible)


@F.pandas_udf(T.ArrayType(T.StringType()))
def compatibility_forms(texts: pd.Series) -> pd.Series:
    """All texts of a row at once, so that a row crosses to Python once."""
    return texts.map(lambda row: None if row is None else [_compatible(x) for x in row])


def _anchors(text: Column) -> Column:
    for arabic, latin in ARABIC:
        text = F.replace(text, F.lit(arabic), F.lit(latin))
    return F.translate(text, DIGITS, "0123456789" * 2)


def fold(text: Column) -> Column:
    """Lower case, Latin anchors and ASCII digits; a null is empty. Stays in the JVM."""
    return _anchors(F.lower(F.coalesce(text, F.lit(""))))


def fold_fully(text: Column) -> Column:
    """Like fold, after compatibility normalization (width variants, ligatures, sharp s)."""
    return _anchors(compatibility_form(F.coalesce(text, F.lit(""))))


def fold_all(texts: Column) -> Column:
    """Like fold_fully for an array; nulls stay null."""
    return F.transform(compatibility_forms(texts), lambda x: F.when(x.isNotNull(), _anchors(x)))


def normalized(folded: Column) -> Column:
    """Words of a-z and 0-9 with one space between them."""
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def search_words(folded: Column) -> Column:
    """The words of a text as search knows them: runs of letters, marks and digits of any script."""
    return F.filter(F.split(F.regexp_replace(folded, r"[^\p{L}\p{M}\p{N}]+", " "), " "), lambda w: w != "")


def identifier(folded: Column) -> Column:
    """An identifier without marks; null if nothing is left."""
    return F.nullif(F.regexp_replace(folded, "[^a-z0-9]+", ""), F.lit(""))


def title_tokens(normal: Column) -> Column:
    """The distinct words of three letters or more that say something, sorted."""
    words = F.filter(F.split(normal, " "), lambda w: F.length(w) >= 3)
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP_WORDS))))


def collapse(text: Column) -> Column:
    """One space for each run of white space, none at the ends; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def normalize_brand(brand: Column) -> Column:
    """The brand's usual spelling, else lower case; null if blank."""
    low = F.lower(collapse(brand))
    spelled = F.create_map(*(F.lit(x) for pair in BRANDS.items() for x in pair))
    return F.coalesce(F.element_at(spelled, low), low)


# How compact model numbers are taken apart and CPU suffixes are put back.
QUERY_RULES = (
    (r"(?i)\b([a-z]{2,})([0-9]{3,5})(ti|xt)\b", "$1 $2 $3"),
    (r"(?i)\b([a-z]{2,})([0-9]{3,5}[a-z]{0,5})\b", "$1 $2"),
    (r"(?i)\b((?:ryzen(?:\s+[3579])?|(?:core\s+)?i[3579])\s+)([0-9]{4,5})\s+(kf|x|f|k)\b", "$1$2$3"),
)


def search_query(query: Column) -> Column:
    """A query with compact model numbers taken apart and CPU suffixes put back."""
    query = F.trim(query)
    for pattern, by in QUERY_RULES:
        query = F.regexp_replace(query, pattern, by)
    return query


def request_words(query: str) -> str:
    """The words of one request as they are searched for, in any script; made where the request comes in."""
    query = _compatible(query.strip())
    for arabic, latin in ARABIC:
        query = query.replace(arabic, latin)
    for pattern, by in QUERY_RULES:
        query = re.sub(pattern, by.replace("$", "\\"), query, flags=re.ASCII)
    return " ".join("".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in query).split())
