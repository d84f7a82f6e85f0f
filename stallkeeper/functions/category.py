"""Categories of shop pages by their paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each shop's last path segment, and what a path or its beginning, stands for.
SEGMENTS = {
    "elnekhely": {
        "processors": "cpu", "graphics-card": "gpu", "motherboards": "motherboard", "ram": "ram", "ssd": "ssd", "hdd": "hdd",
        "cases": "case", "power-supply": "power_supply", "fans-coolers": "cooling",
    },
    "elbadr": {
        "cpu": "cpu", "vga": "gpu", "motherboard": "motherboard", "ram": "ram", "ssd": "ssd", "hdd": "hdd",
        "cases": "case", "power-supply": "power_supply", "cooling": "cooling",
    },
    "maximum": {
        "processors": "cpu", "graphic-card": "gpu", "motherboards": "motherboard", "memory": "ram", "ssd": "ssd", "hard-disks": "hdd",
        "cases": "case", "power-supply": "power_supply", "fans-pc-cooling": "cooling",
    },
}
# Fixed values: (pattern of the whole path, category); earlier rules hold first, before segments.
PATHS = {
    "elnekhely": (("^/monitors$", "monitor"), ("^/accessories$", "accessories"), ("^/laptop$", "laptops")),
    "elbadr": (("^(/accessories)?/headphones$", "headphones"), ("^/laptop$", "laptops"), ("^/monitors(/|$)", "monitor"), ("^/accessories(/|$)", "accessories")),
    "maximum": (("^/monitors(/|$)", "monitor"), ("^/accessories-1(/|$)|/(keyboard-mouse|headphones-speakers)$", "accessories")),
}
# The leaves of category trees.
LEAVES = {
    "Intel CPU": "cpu", "AMD CPU": "cpu", "Intel Motherboard": "motherboard", "AMD Motherboard": "motherboard", "PC Memory": "ram", "Laptop Memory": "ram",
    "Nvidia GeForce": "gpu", "AMD RADEON": "gpu", "AIR Cooler": "cooling", "Liquid Cooler": "cooling", "Fans": "cooling", "Mini Tower": "case", "Mid Tower": "case",
    "Full Tower": "case", "Non modular": "power_supply", "Sime modular": "power_supply", "Full modular": "power_supply", "Internal SSD": "ssd", "Internal HDD": "hdd",
}
# Roots that are a category by themselves, and roots whose leaves are.
ROOTS, PART_ROOTS = {"Laptops": "laptops", "Monitor": "monitor", "Accessories": "accessories"}, ("Hardware Components", "Storage")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def by_path(provider: Column, path: Column) -> Column:
    """A shop's category by URL path; null if it has none."""
    path = F.regexp_replace(F.lower(path), "/+$", "")
    last = F.element_at(F.split(path, "/"), -1)

    def own(shop: str) -> Column:
        rules = reduce(lambda rest, rule: F.when(path.rlike(rule[0]), rule[1]).otherwise(rest), reversed(PATHS[shop]), F.lit(None).cast("string"))
        return F.coalesce(rules, _lookup(SEGMENTS[shop], last))

    return reduce(lambda rest, shop: F.when(provider == shop, own(shop)).otherwise(rest), SEGMENTS, F.lit(None).cast("string"))


def by_tree(path: Column) -> Column:
    """A category by its path of names (array) in the shop's tree; null if it has none."""
    first, last = F.get(path, F.lit(0)), F.try_element_at(path, F.lit(-1))
    headphones = ((last == "Headphone") & (first == "Accessories")) | (last == "Studio Headphones")
    laptops = first == "Laptops"
    return (
        F.when(laptops & (F.size(path) > 1), None).when(headphones, "headphones").when(first.isin(*ROOTS) & (F.size(path) == 1), _lookup(ROOTS, first))
        .when(first.isin(*PART_ROOTS), _lookup(LEAVES, last))
    )
