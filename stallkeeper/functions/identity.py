"""What two listings say about being the same product, as column expressions.

A listing's evidence is a struct of category, brand, mpn, gtin, model_number (in identifier
form, brand in normal form), attrs (map) and tokens (array); see ``evidence``. Texts come in
folded (see ``text.fold_fully``), which is done once, before patterns look at them; folding
what is folded changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, identifier, normalized, title_tokens

# Patterns of attributes by category, matched case-insensitively in the folded options and title; group 1 is the value.
COLOURS = r"\b(black|blue|gold|gray|green|grey|pink|purple|red|silver|white)\b"
_SIZE = r"\d+(?:\.\d+)?\s*(?:tb|gb)"
_DRIVE = {"capacity": rf"\b({_SIZE})\b", "interface": r"\b(nvme|sata|pcie\s*[345](?:\.0)?)\b", "form_factor": r"\b(m\.?2|2\.?5|3\.?5)\b"}
_AUDIO = {"generation": r"\b(\d(?:st|nd|rd|th)?\s*gen(?:eration)?)\b", "color": COLOURS}
PATTERNS: dict[str, dict[str, str]] = {
    "cpu": {
        "cpu_model": r"\b((?:ryzen\s*[3579]\s*|core\s*(?:i[3579]|ultra\s*[3579])\s*[- ]?|threadripper\s*|athlon\s*|pentium\s*)[a-z0-9-]{3,})\b",
        "package": r"\b(tray|box|boxed|mpk|oem)\b",
    },
    "gpu": {
        "chip": r"\b((?:rtx|gtx|rx|arc)\s*[a-z]?\s*\d{3,4}\s*(?:ti|super|xt|xtx)?)\b",
        "vram": r"\b(\d{1,2})\s*g(?:b)?\b",
        "board_family": r"\b(rog\s+strix|tuf\s+gaming|gaming\s+x\s+trio|gaming\s+trio|gaming\s+oc|windforce|eagle|low\s+profile|ventus|suprim|aero|prime|dual|pulse|nitro\+?|hellhound|red\s+devil|phantom\s+gaming|steel\s+legend|taichi|twin\s+edge|trinity)\b",
        "board_revision": r"\b(v[2-9]|rev(?:ision)?\s*[2-9](?:\.\d)?)\b",
        "edition": r"\b(oc|non oc|white|b[tf]{2}|evo)\b",
    },
    "motherboard": {"chipset": r"\b((?:b|x|z|h|a)\s*\d{3,4}\s*e?)\b", "socket": r"\b((?:lga|am)\s*\d{1,4})\b"},
    "ram": {
        "generation": r"\b(ddr[345])\b",
        "speed": r"\b(?:ddr[345][ -]?)?(\d{4,5})\s*(?:mhz|mt/s|mtps)?\b",
        "latency": r"\b(cl\s*\d{2})\b",
        "kit": r"\b(\d\s*[x×]\s*\d{1,3}\s*gb)\b",
        "capacity": r"\b(\d{1,3}\s*gb)\b",
        "rgb": r"\b(rgb|argb)\b",
    },
    "ssd": _DRIVE,
    "hdd": _DRIVE,
    "mobile_phones": {
        "generation": r"\b(iphone\s*\d{1,2}\s*(?:pro\s*max|pro|plus|mini)?|galaxy\s*[asz]\s*\d{1,3}\s*(?:ultra|plus|fe)?)\b",
        "network": r"\b(4g|5g)\b",
        "color": COLOURS,
    },
    "laptops": {
        "cpu": r"\b((?:i[3579]-?\d{4,5}[a-z]{0,2}|ryzen\s*[3579]\s*\d{4}[a-z]{0,2}|core\s*ultra\s*[3579]\s*\d{3}[a-z]{0,2}))\b",
        "gpu": r"\b((?:rtx|gtx|rx)\s*\d{3,4}\s*(?:ti|super|xt)?)\b",
        "ram": r"\b(\d{1,3}\s*gb)\s*(?:ram|ddr[345])\b",
        "storage": rf"\b({_SIZE})\s*(?:ssd|hdd|nvme)\b",
        "display": r"\b(\d{2,3}(?:\.\d)?\s*(?:inch|\"))\b",
    },
    "monitor": {"size": r"\b(\d{2}(?:\.\d)?\s*(?:inch|\"))\b", "refresh": r"\b(\d{2,3}\s*hz)\b", "resolution": r"\b(4k|qhd|fhd|\d{4}\s*[x×]\s*\d{3,4})\b"},
    "power_supply": {"wattage": r"\b(\d{3,4}\s*w)\b"},
    "cooling": {"radiator": r"\b(120|240|280|360|420)\s*mm\b", "kind": r"\b(aio|liquid|air)\b"},
    "headphones": _AUDIO, "headsets": _AUDIO, "earphones": _AUDIO, "true_wireless_earbuds": _AUDIO,
}
#: Attributes that must not differ, by category: those with patterns, and a phone's storage.
CRITICAL = {c: sorted(p) for c, p in PATTERNS.items()} | {"mobile_phones": ["color", "generation", "network", "storage"]}
SPEC_FIELDS = (
    "model", "model_number", "manufacturer_model_number", "cpu", "gpu", "ram", "storage", "capacity",
    "speed", "latency", "generation", "wattage", "refresh", "resolution",
)
PHONE_VARIANT, PHONE_GATE = ("storage", "color", "mpn", "gtin"), ("storage", "color", "mpn", "gtin", "model_number")
CPU_VARIANT, CPU_GATE = ("package", "mpn", "gtin"), ("package", "mpn", "gtin", "model_number")
EXACT, VARIANT, DIFFERENT, UNCERTAIN = "same_exact_variant", "same_product_different_variant", "different_product", "uncertain"
REVIEWER, MODEL = "human", "model"


def _compact(found: Column) -> Column:
    return F.nullif(F.regexp_replace(fold(found), "[^a-z0-9]+", ""), F.lit(""))


def _first(text: Column, pattern: str) -> Column:
    return _compact(F.regexp_extract(text, "(?i)" + pattern, 1))


def _largest_storage(text: Column) -> Column:
    """The largest size from 64 GB on."""
    sizes = F.regexp_extract_all(text, F.lit(r"(?i)\b(\d+(?:\.\d+)?)\s*(?:tb|gb)\b"), F.lit(0))

    def sized(s: Column) -> Column:
        number = F.regexp_extract(s, r"\d+(?:\.\d+)?", 0).cast("double")
        return F.struct((number * F.when(F.lower(s).contains("tb"), 1024).otherwise(1)).alias("gb"), normalized(fold(F.regexp_replace(s, r"\s+", ""))).alias("label"))

    return F.array_max(F.filter(F.transform(sizes, sized), lambda x: x["gb"] >= 64))["label"]


def attributes(category: Column, title: Column, variant: Column, specs: Column) -> Column:
    """A map of what options, title and specifications say; options come before the title, specifications override."""
    options = F.coalesce(F.array_join(F.map_values(variant), " "), F.lit(""))
    text = fold(F.concat_ws(" ", options, title))
    fields = sorted({f for p in PATTERNS.values() for f in p} | {"storage"})
    entries = []
    for field in fields:
        own = [(c, p[field]) for c, p in PATTERNS.items() if field in p]
        by_pattern: dict[str, list[str]] = {}
        for c, p in own:
            by_pattern.setdefault(p, []).append(c)
        value = reduce(lambda rest, one: F.when(category.isin(*one[1]), _first(text, one[0])).otherwise(rest), by_pattern.items(), F.lit(None).cast("string"))
        if field == "storage":
            explicit = F.filter(F.map_entries(variant), lambda e: normalized(fold(e["key"])).isin("storage", "capacity"))
            named = F.when(F.size(explicit) > 0, F.try_element_at(F.array_compact(F.transform(explicit, lambda e: _first(fold(e["value"]), rf"\b({_SIZE})\b"))), F.lit(-1)))
            value = F.when(category == "mobile_phones", F.coalesce(named, _largest_storage(text))).otherwise(value)
        if field == "package":
            value = F.when(value == "boxed", "box").otherwise(value)
        entries.append(F.struct(F.lit(field).alias("key"), value.alias("value")))
    found = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    given = F.transform(
        F.coalesce(F.map_entries(specs), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: F.struct(F.replace(normalized(fold(e["key"])), F.lit(" "), F.lit("_")).alias("key"), normalized(fold(e["value"])).alias("value")),
    )
    given = F.filter(given, lambda e: e["key"].isin(*SPEC_FIELDS))
    names = F.transform(given, lambda e: e["key"])
    kept = F.filter(found, lambda e: ~F.array_contains(names, e["key"]))
    unique = F.filter(given, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"]))
    return F.map_from_entries(F.concat(kept, unique))


def evidence(category: Column, brand: Column, title: Column, mpn: Column, gtin: Column, model_number: Column, variant: Column, specs: Column) -> Column:
    form = lambda c: identifier(fold(c))
    return F.struct(
        category.alias("category"), F.nullif(normalized(fold(brand)), F.lit("")).alias("brand"), form(mpn).alias("mpn"), form(gtin).alias("gtin"),
        form(model_number).alias("model_number"), attributes(category, title, variant, specs).alias("attrs"), title_tokens(normalized(fold(title))).alias("tokens"), title.alias("title"),
    )


def _differ(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(False))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def conflicts(a: Column, b: Column) -> Column:
    """Sorted names of what both sides state and differ in; a different category or brand stands alone."""
    ids = [F.when(_differ(a[f], b[f]), F.lit(f)) for f in ("mpn", "gtin", "model_number")]
    by_category = F.create_map(*(x for c, fields in CRITICAL.items() for x in (F.lit(c), F.array(*map(F.lit, fields)))))
    critical = F.filter(F.coalesce(F.element_at(by_category, a["category"]), F.array().cast("array<string>")), lambda f: _differ(F.element_at(a["attrs"], f), F.element_at(b["attrs"], f)))
    rest = F.array_sort(F.concat(F.array_compact(F.array(*ids)), critical))
    return F.when(~a["category"].eqNullSafe(b["category"]), F.array(F.lit("category"))).when(_differ(a["brand"], b["brand"]), F.array(F.lit("brand"))).otherwise(rest)


def evidence_class(e: Column) -> Column:
    """A number that two pieces of evidence share if nothing tells them apart."""
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries(e["attrs"])), lambda x: F.concat_ws("\u0002", x["key"], x["value"])), "\u0001")
    # A hash passes over nulls, so it must not be told apart by place alone which field is null.
    filled = [F.coalesce(F.concat(F.lit("="), e[c]), F.lit("")) for c in ("category", "brand", "mpn", "gtin", "model_number")]
    return F.xxhash64(*filled, attrs)


def retitled(e: Column, title: Column) -> Column:
    """The same evidence under another title, whose attributes and tokens come as a struct."""
    return F.struct(*(e[f].alias(f) for f in ("category", "brand", "mpn", "gtin", "model_number")), title["attrs"].alias("attrs"), title["tokens"].alias("tokens"))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def shared_attribute(a: Column, b: Column, *fields: str) -> Column:
    return reduce(Column.__or__, (_same(F.element_at(a["attrs"], F.lit(f)), F.element_at(b["attrs"], F.lit(f))) for f in fields))


def candidate_score(a: Column, b: Column) -> Column:
    """0 to 1: equal identifiers settle it, else Jaccard of title words, raised by a shared code or model."""
    comparable = _same(a["category"], b["category"]) & _same(a["brand"], b["brand"])
    code = F.exists(F.array_intersect(a["tokens"], b["tokens"]), lambda t: (F.length(t) >= 4) & t.rlike("[0-9]") & t.rlike("[a-z]"))
    raised = F.when(code | shared_attribute(a, b, "cpu_model", "generation", "chip"), 0.5).otherwise(0.0)
    words = F.when((F.size(a["tokens"]) > 0) & (F.size(b["tokens"]) > 0), F.greatest(jaccard(a["tokens"], b["tokens"]), raised)).otherwise(0.0)
    return F.when(~comparable, 0.0).when(_same(a["gtin"], b["gtin"]) | _same(a["mpn"], b["mpn"]), 1.0).otherwise(words)


def _subset(names: Column, allowed: tuple[str, ...]) -> Column:
    return F.size(F.array_except(names, F.array(*map(F.lit, allowed)))) == 0


def _equal_maps(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))


def _full_cpu(a: Column, b: Column) -> Column:
    return _same(a["category"], F.lit("cpu")) & F.element_at(a["attrs"], F.lit("cpu_model")).isNotNull() & _equal_maps(a["attrs"], b["attrs"])


def _family(a: Column, b: Column, category: str, field: str, names: Column, allowed: tuple[str, ...]) -> Column:
    alike = _same(a["category"], F.lit(category)) & _same(b["category"], F.lit(category)) & _same(a["brand"], b["brand"])
    return alike & shared_attribute(a, b, field) & _subset(names, allowed)


def verdict(a: Column, b: Column, names: Column) -> Column:
    """What the evidence settles; ``names`` are the pair's conflicts."""
    some = F.size(names) > 0
    family = _family(a, b, "mobile_phones", "generation", names, PHONE_VARIANT) | _family(a, b, "cpu", "cpu_model", names, CPU_VARIANT)
    return (
        F.when(some & family, VARIANT).when(some, DIFFERENT).when(a["brand"].isNull() | b["brand"].isNull(), UNCERTAIN)
        .when(_same(a["gtin"], b["gtin"]) | _same(a["mpn"], b["mpn"]) | _full_cpu(a, b), EXACT).otherwise(UNCERTAIN)
    )


def safe_to_apply(a: Column, b: Column, names: Column, decided: Column, method: Column, reviewed: Column) -> Column:
    """Whether a stored decision may change the catalog."""
    free = F.size(names) == 0
    family = _family(a, b, "mobile_phones", "generation", names, PHONE_GATE) | _family(a, b, "cpu", "cpu_model", names, CPU_GATE)
    proof = _same(a["gtin"], b["gtin"]) | _same(a["mpn"], b["mpn"]) | _full_cpu(a, b)
    exact = free & (_same(method, F.lit(REVIEWER)) | F.coalesce(reviewed, F.lit(False)) | _same(method, F.lit(MODEL)) | proof)
    return F.when(decided == VARIANT, family).when(decided == EXACT, exact).otherwise(False)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(":", F.least(a, b), F.greatest(a, b))


def signature(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 256)


def phone_family(category: Column, title: Column) -> Column:
    """A phone's family as shown: iPhone and Galaxy lines; null for others."""
    name = normalized(fold(title))
    apple, other = r"\biphone\s*(\d{1,2})(?:\s*(pro\s*max|pro|plus|mini|e))?\b", r"\bgalaxy\s*([asz])\s*(\d{1,3})(?:\s*(ultra|plus|fe))?\b"
    part = lambda pattern, i: F.regexp_extract(name, pattern, i)
    spaced = F.initcap(F.when(part(apple, 2) == "promax", "pro max").otherwise(part(apple, 2)))
    tail = F.when(part(other, 3) == "fe", "FE").otherwise(F.initcap(part(other, 3)))
    iphone = F.rtrim(F.concat_ws(" ", F.lit("iPhone"), part(apple, 1), spaced))
    galaxy = F.rtrim(F.concat_ws(" ", F.concat(F.lit("Samsung Galaxy "), F.upper(part(other, 1)), part(other, 2)), tail))
    return F.when(category == "mobile_phones", F.when(name.rlike(apple), iphone).when(name.rlike(other), galaxy))
